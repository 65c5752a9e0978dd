"""How the smaller side of a pair computation reaches the larger one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("auto", "broadcast", "shuffle")
#: Rows of a side (five to some dozens of longs each) up to which `auto` broadcasts it.
BROADCAST_TERMS = 200_000
#: Pairs of a task, if the sizes of both sides are known; right rows that a left row meets at a time.
TASK_PAIRS, BLOCK = 8_000_000, 512


def paired(left: DataFrame, right: DataFrame, n_right: int, strategy: str = "auto", n_left: int | None = None) -> DataFrame:
    """All pairs: the right side is broadcast if its known size is small (or that is forced), else both are dealt as blocks.

    With n_left, tasks get TASK_PAIRS pairs each: a side's own files may be few, and so would tasks be.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "broadcast" and n_right > 20 * BROADCAST_TERMS:
        raise RuntimeError("a broadcast was forced, but that side is too large for it")
    tasks = -(-(n_left or 0) * n_right // TASK_PAIRS)
    if strategy == "broadcast" or strategy == "auto" and n_right <= BROADCAST_TERMS:
        return left.crossJoin(F.broadcast(right)) if tasks < 2 else _in_blocks(left, right, n_right, min(tasks, n_left))
    if tasks > 1:
        across = max(1, min(n_right, round((tasks * n_right / n_left) ** 0.5)))
        left, right = left.repartition(max(1, min(n_left, tasks // across))), right.repartition(across)
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def _in_blocks(left: DataFrame, right: DataFrame, n_right: int, tasks: int) -> DataFrame:
    """All pairs in so many tasks, each a range of the left rows, by all columns but the first, the id, before that.

    A task takes the right side block by block and in a block its left rows in order. So left rows of equal masks have the
    same short run of right ids one after the other, which Parquet's pages compress to a few bits a pair; the ids of a whole
    side in a row are longer than a page. A block is one row, an array of neighbours by id: the join meets a block at once,
    and ids made of both sides, as a product's, follow each other.
    """
    blocks = -(-n_right // BLOCK)
    ids, masks = left.columns[0], left.columns[1:]
    dealt = left.repartitionByRange(tasks, *masks, ids).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Catalyst drops a sort below a join, unless something between them depends on the partition.
    dealt = dealt.sortWithinPartitions("_at", *masks, ids).withColumn("_at", F.when(F.spark_partition_id() >= 0, F.col("_at")))
    # One partition, whose row numbers are dense: this side is small enough to be broadcast.
    placed = right.repartition(1).sortWithinPartitions(right.columns[0]).withColumn("_block", F.least(F.floor(F.monotonically_increasing_id() / BLOCK), F.lit(blocks - 1)).cast("int"))
    blocked = placed.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct(*right.columns))).alias("_rows"))
    return dealt.join(F.broadcast(blocked), F.col("_at") == F.col("_block")).select(*left.columns, F.inline("_rows"))


def counted(df: DataFrame, limit: int = BROADCAST_TERMS) -> int:
    """Rows of df, or limit + 1 if there are more."""
    return df.limit(limit + 1).count()
