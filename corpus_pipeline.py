"""The corpus pipeline: five stages over `documents`, each writing Parquet that the next one reads.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its decisions take effect. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.bpe import encode_documents
from termweave.llm.common import Scratch
from termweave.llm.linededup import dedup_lines
from termweave.llm.metricjoin import jaccard_groups
from termweave.llm.mixing import mix_sources
from termweave.llm.toxicity import fit, score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicate documents: five-word shingles, similarity 80 / 100 or more.
SHINGLE_WORDS, SIMILARITY_NUM, SIMILARITY_DEN = 5, 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines over all documents one stays; n_chars follows the text, documents stay even if emptied."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: the first by id (null last), then by text hash.

    A document is known by its id and its text: rows that share an id but not the text are documents of their own, and only
    the one found to be a copy goes. Of rows equal in both, one stays, the smallest by the other columns. Documents without
    words are similar to nothing and stay.
    """
    scratch = Scratch(spark, "nearduplicates")
    th = F.xxhash64("text")
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id", th).count().filter("count > 1").limit(1).count():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        one = docs.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
        docs = scratch.table(one.select(*[F.col(c) if c not in rest else F.col(f"rest.{c}") for c in COLUMNS]))
    found = scratch.table(jaccard_groups(docs, words=SHINGLE_WORDS, num=SIMILARITY_NUM, den=SIMILARITY_DEN).filter("root is not null"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    stays = scratch.table(found.groupBy("root").agg(F.min(row).alias("stays"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    gone = scratch.table(found.join(stays, "root").filter(row != F.col("stays")).select(F.col("doc_id").alias("_gone"), F.col("th").alias("_th")))
    return docs.join(gone, F.expr("doc_id <=> _gone and xxhash64(text) = _th"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are rows of their own. No two rows of docs are equal in id and text."""
    keyed = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))  # rows of one id may differ in text
    copies = mix_sources(keyed, id_col="_key").filter("copies > 0").select(F.col("doc_id").alias("_key"), "copies")
    mixed = keyed.join(copies, "_key")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded_sha256: token ids of every row, as training reads them, decoded again for a digest."""
    coded = encode_documents(docs.withColumn("_key", F.struct("doc_id", "source")), id_col="_key")
    return coded.select("doc_id.doc_id", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("mix_sources", mixture), ("bpe_encoding", tokens)]

#: The learned score of the first stage is no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages leave, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
