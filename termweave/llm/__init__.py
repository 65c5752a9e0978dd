"""Training-data operators: toxicity, mixing, secrets, media, fingerprints, BPE, dedup, licences, joins, shards."""
