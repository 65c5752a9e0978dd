"""SimHash fingerprints of documents, and permuted block tables that find all fingerprints within a Hamming radius.

Terms are five-word shingles (A-Z lower-cased), weighted by how often they occur; each term's 64-bit hash votes with its
weight for or against every bit. A text of one to four words is a single term; one without words has fingerprint 0.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, shingle_hashes, small_side

SHINGLE = 5
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in chunks(texts, 1_000_000):
        terms, at = shingle_hashes(texts[a:b], k)
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            continue
        bits = np.unpackbits(terms.astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32) * 2 - np.diff(at)[some, None]
        out[a + some] = np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _rows(ids, texts: list[str], following: list[str], own: np.ndarray, nxt: np.ndarray) -> dict:
    changed = [edited(t, n).encode() for t, n in zip(texts, following, strict=True)]
    other = fingerprints(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": [f"{int(x):016x}" for x in own], "edited_fingerprint": [f"{int(x):016x}" for x in other],
        "near_edited": likeness(own, other), "near_next": likeness(own, nxt),
    }


def edit_sensitivity(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness, in the order of descending ids.

    Rows are dealt by id range and read in order; each carries over to the next. The last row of a partition meets the
    first of the next one in a second step over two rows a partition. Null text counts as empty; null ids come last; rows
    of one id follow by the hash of their text. A table of one row is its own next; an empty one gives an empty result.
    Other columns aren't read. Memory: one Arrow batch.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = f"{_OUT}, pid int, head boolean, text string"

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.string()]
        pid, last = TaskContext.get().partitionId(), None

        def made(columns: dict, size: int):
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                own = fingerprints([t.encode() for t in texts])
                if last is None:
                    yield made({"doc_id": ids[:1], "pid": [pid], "head": [True], "text": texts[:1]}, 1)
                else:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate(([last[2]], own))
                if len(ids) > 1:
                    yield made(_rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), len(ids) - 1)
                last = ids[-1], texts[-1], own[-1]
        if last is not None:
            yield made({"doc_id": [last[0]], "pid": [pid], "head": [False], "text": [last[1]]}, 1)

    stored = scratch.table(placed.mapInArrow(run, schema))
    ends = stored.filter("pid is not null")  # two rows a partition
    heads, tails = ends.filter("head").select(F.col("pid").alias("hp"), F.col("text").alias("next")), ends.filter("not head").select("pid", "doc_id", "text")
    turn = heads.select("hp").select("hp", F.coalesce(F.lead("hp").over(Window.orderBy("hp")), F.min("hp").over(Window.orderBy("hp"))).alias("np"))
    pairs = tails.join(turn, tails.pid == turn.hp).drop("hp").join(heads, F.col("np") == F.col("hp")).select("doc_id", "text", "next")

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own, nxt = fingerprints([t.encode() for t in texts]), fingerprints([t.encode() for t in following])
            got = _rows(batch.column(0).to_pylist(), texts, following, own, nxt)
            got["doc_id"] = pa.array(got["doc_id"], pa.int64())
            yield pa.RecordBatch.from_pydict(got)

    return stored.filter("pid is null").select(*[x.split()[0] for x in _OUT.split(", ")]).unionByName(pairs.mapInArrow(meet, _OUT))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint long (the 64 bits, signed) for each row; null text as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fingerprint long")


def block_keys(bits: Column, radius: int, blocks: int) -> Column:
    """One key for each permuted table: the table's number and the `blocks - radius` blocks it puts first.

    Two fingerprints within the radius differ in at most `radius` blocks, so they agree on all the others in one table.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tables = combinations(range(blocks), blocks - radius)
    return F.array(*[F.struct(F.lit(t).alias("table"), bits.bitwiseAND(F.lit(signed(sum(masks[i] for i in keep)))).alias("key")) for t, keep in enumerate(tables)])


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """q_fingerprint, fingerprint, distance: all pairs of different values of `fingerprint` within the radius.

    Both sides are reduced to distinct fingerprints first, so copies cost nothing; join back for ids. Null fingerprints
    and fingerprints equal to the query give no pair. Queries are a stated set; each meets the index once a table.
    """
    q = queries.select(F.col("fingerprint").alias("q_fingerprint")).na.drop().distinct()
    q = small_side(q.select("q_fingerprint", F.explode(block_keys(F.col("q_fingerprint"), radius, blocks)).alias("k")).select("q_fingerprint", "k.table", "k.key"))
    x = index.select("fingerprint").na.drop().distinct()
    x = x.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), radius, blocks)).alias("k")).select("fingerprint", "k.table", "k.key")
    gap = F.bit_count(F.col("q_fingerprint").bitwiseXOR(F.col("fingerprint"))).cast("int")
    return q.join(x, ["table", "key"]).select("q_fingerprint", "fingerprint", gap.alias("distance")).filter((F.col("distance") <= radius) & (F.col("distance") > 0)).distinct()


def neighbours(found: DataFrame, every: int = 20, radius: int = 3, blocks: int = 6) -> DataFrame:
    """found (doc_id, fingerprint as 16 hexadecimal digits, ...) with n_near: for each id divisible by `every`, how many other
    fingerprints of the whole table lie within the radius; null for other ids and null ones.
    """
    bits = F.conv("fingerprint", 16, -10).cast("long")
    known = found.select("doc_id", bits.alias("fingerprint"))
    near = within_radius(known.filter(F.col("doc_id") % every == 0), known, radius, blocks)
    near = Scratch(found.sparkSession, "neighbours").table(near.groupBy("q_fingerprint").agg(F.count("*").alias("n")))
    asked = F.when(F.col("doc_id") % every == 0, bits)
    return found.withColumn("asked", asked).join(small_side(near), F.col("asked") == F.col("q_fingerprint"), "left").withColumn("n_near", F.when(F.col("asked").isNotNull(), F.coalesce("n", F.lit(0)))).drop("asked", "q_fingerprint", "n")


def op5_simhash_edits(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and n_near, how many others of the whole table lie within three
    bits, for the ids divisible by 20 (the queries of the block tables). Cases as edit_sensitivity.

    Fingerprints are no SQL; tests/llm compares them with votes bit by bit, and n_near with all pairs.
    """
    found = Scratch(spark, "fingerprints").table(edit_sensitivity(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return neighbours(found)
