"""What the training-data operators share: durable intermediate tables, global ranks, word and shingle hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import remove, removed_at_exit, shared_dir

#: Rows of 16-byte keys (a few tens of MB as a hash table) up to which a counted side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 300_000


class Scratch:
    """Intermediate tables as Parquet under the shared folder: they cut lineage and outlive any executor.

    What isn't dropped before goes when the driver ends, for lazy results read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        removed_at_exit(spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later plan reads."""
        remove(self.spark, df._scratch_path)

    def sweep(self) -> None:
        """Frees the shuffle files of finished steps: Spark deletes them once the driver has collected their plans.

        Only a hint: results don't depend on it, but without it the disk holds finished shuffles until the driver next
        collects its garbage by itself.
        """
        self.spark._jvm.System.gc()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (a stored table), broadcast if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ranked(scratch: Scratch, df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """A stored copy of df (a stored table) with its 0-based rank by `order`, a total order up to rows that are equal.

    Rows are dealt by range and sorted in place; only the row count of each partition is gathered to make offsets, so
    no task holds more than its range and the ranks don't depend on where the ranges were cut.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_pid", F.spark_partition_id()).withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    stored = scratch.table(placed)
    sizes = stored.groupBy("_pid").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    return stored.join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_loc")).drop("_pid", "_loc", "_before")


def uniform(*cols) -> F.Column:
    """A number in [0, 1) that depends only on the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


#: Longs in the filters that pick rows before a shuffle: 4 MB, whatever the input.
BITMAP = 1 << 19


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """One row, `bits`: 64 * BITMAP bits, of which those of the keys are set. Its size is fixed; full, it lets all rows by."""
    words = keys.groupBy(F.pmod(key, F.lit(64 * BITMAP)).alias("b")).agg(F.lit(1).alias("one")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    filled = keys.sparkSession.range(BITMAP).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def hit(key: F.Column, bits: F.Column) -> F.Column:
    """Whether a key's bit is set."""
    b = F.pmod(key, F.lit(64 * BITMAP))
    return F.call_function("shiftrightunsigned", F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


# ---- word and shingle hashes in numpy ------------------------------------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_VALUE[_SPACE] = 0
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of all texts, and where each text's words begin."""
    global _POW, _INV
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    if len(_POW) <= len(data):
        n = len(data) + len(data) // 4 + 1
        _POW, _INV = _powers(_B, n), _powers(pow(_B, -1, 1 << 64), n)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _POW[: len(data)])))
    hashes = mix64((total[end] - total[start]) * _INV[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, at)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles, repeats included, and where each text's begin.

    A text of fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    count = np.diff(at)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(n)))
    if not len(words):
        return np.zeros(0, np.uint64), out_at
    factor = _powers(0xD1342543DE82EF95, k + 1)[1:]
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    full = sum(padded[j : len(words) + j] * factor[j] for j in range(k))
    first = np.repeat(at[:-1] - out_at[:-1], n) + np.arange(out_at[-1])
    out = full[first]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[out_at[i]] = (words[at[i] : at[i + 1]] * factor[: count[i]]).sum() + np.uint64(int(count[i]))
    return mix64(out), out_at


def chunks(texts: list, limit: int = 1_000_000):
    """Runs (from, to) of texts of about `limit` bytes in all, one at least: bounds the memory of vectorised work."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column's values as UTF-8, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
