"""The pipeline's stages against brute force over a small table."""

import hashlib
import re

import corpus_pipeline as P
from termweave.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    out = [docs]
    for _, stage in P.STAGES:
        out.append(spark.createDataFrame((d := stage(spark, out[-1], SF)).collect(), d.schema))
    toxic, lines, near, mixed, tokens = out[1:]
    assert all(d.columns == docs.columns for d in out[1:5])
    assert set(r.doc_id for r in toxic.collect()) <= set(r.doc_id for r in docs.collect()) and toxic.count() > 0.8 * docs.count()
    assert lines.count() == toxic.count()
    kept = {r.doc_id for r in near.collect()}
    rows = {r.doc_id: (r.text or "").lower().split() for r in lines.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in rows.items()}
    ids = sorted(sets)
    low = {i: i for i in ids}
    for _ in range(20):  # the smallest id spreads along links
        for i in ids:
            for j in ids:
                if j < i and sets[i] and 10 * (both := len(sets[i] & sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[i] == low[low[i]] for i in ids):
            break
    assert kept == {i for i in ids if low[i] == i}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = {r.doc_id: size(r.text) for r in near.collect()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= kept and max(copies.values()) <= 3
    assert abs(sum(copies[i] * words[i] for i in copies) - sum(words.values())) < 0.1 * sum(words.values())
    own = bpe.tokenizer(bpe.default_path())
    text = {r.doc_id: r.text for r in mixed.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count() and all(own.decode(r.ids) == text[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def near(spark, rows):
    table = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], COLUMNS)
    return sorted(((r.doc_id, r.text, r.source) for r in P.near_duplicates(spark, table, SF).collect()), key=repr)


def test_only_copies_go(spark):
    """Rows may share an id, or have none: a row goes only if it is itself a copy."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    both = a + " " + b
    assert near(spark, [(1, b, "s"), (2, a, "s"), (2, b, "s"), (3, both, "s")]) == sorted([(1, b, "s"), (2, a, "s"), (3, both, "s")], key=repr)
    (one,) = near(spark, [(5, a, "s"), (5, a + " x", "s")])  # near copies that share an id
    assert one[0] == 5
    assert near(spark, [(None, a, "s"), (7, a, "s"), (None, b, "s")]) == sorted([(7, a, "s"), (None, b, "s")], key=repr)
    assert near(spark, [(8, a, "t"), (8, a, "s"), (8, a, None)]) == [(8, a, None)]  # equal in id and text: the smallest by the rest
    assert near(spark, [(1, None, "s"), (2, "", "s"), (3, " ", "s"), (1, None, "s")]) == sorted([(1, None, "s"), (2, "", "s"), (3, " ", "s")], key=repr)
    assert near(spark, []) == []


def test_empty_and_repeated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.limit(8)
    once = None
    for table in (docs.limit(0), few, few.union(few)):
        d = table.withColumn("score", table.n_chars).withColumn("n_lines", table.n_chars).withColumn("_key", table.n_chars)  # names that the code uses
        for name, stage in P.STAGES:
            d = stage(spark, d, SF)
            d = spark.createDataFrame(d.collect(), d.schema)
            if name == "ngram_jaccard_join":
                left = {(r.doc_id, r.text) for r in d.collect()}
                assert len(left) == d.count()  # repeats are gone
        if table.count() == 0:
            assert d.count() == 0
        elif once is None:
            once = left
    assert left == once  # repeated rows change nothing before the mix


def test_tokens_are_decoded(spark):
    """The last stage makes the round trip: ids, and the digest of what they decode to."""
    texts = {1: "a line\nand  two", 2: "", 3: None, 4: "\u4e2d\u6587 \U0001f600 na\u00efve", 5: "<|endoftext|> x"}
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], COLUMNS)
    own = bpe.tokenizer(bpe.default_path())
    rows = P.tokens(spark, table, SF).collect()
    assert len(rows) == 5 and all(r.n_tokens == len(r.ids) and own.decode(r.ids) == (texts[r.doc_id] or "") for r in rows)
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)
