"""Column builders: bit arithmetic on mask words, label codecs, exact phases."""
