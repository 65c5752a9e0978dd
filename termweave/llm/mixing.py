"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target number of words; each of its documents an expected number of copies, target / source size.
The whole part is taken as it is. The fractional parts are rounded in pairs: mass (probability times words) moves at
random between two documents until one probability is 0 or 1, which keeps every expectation and the source's expected
words exactly. The pairing is a reduction tree of blocks of 32 neighbours by size: a block folds into one residual,
residuals form the blocks of the next level, and one residual a source is left, rounded to the nearer end. So a source's
taken words differ from its target by at most half of one document's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, uniform

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK = 32
_EPS = 1e-9
_DONE = "array<struct<r:bigint,id:bigint,w:bigint,x:int>>"
_STATE = f"struct<r:bigint,id:bigint,w:bigint,p:double,done:{_DONE}>"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(scratch: Scratch, base: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, n, target: shares of all words by the weights, repeated over the sources by code point.

    The largest factor lam with sum(min(cap, lam * weight)) = all words is found by rounds of resharing; a round reads
    one row a source and brings two sums to the driver.
    """
    sources = scratch.table(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.table(ranked(scratch, sources, order).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeat)))
    total, weighed = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    lam = (total or 0) / (weighed or 1.0)
    while True:
        full = F.col("cap") <= F.lit(lam) * F.col("weight")
        caps, free = sources.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free or (following := ((total or 0) - caps) / free) <= lam * (1 + 1e-15):
            break
        lam = following
    return sources.select("source", "source_size", "n", F.least("cap", F.lit(lam) * F.col("weight")).alias("target"))


def _unit(e: Column, p: Column, done: Column) -> Column:
    return F.struct(e["r"].alias("r"), e["id"].alias("id"), e["w"].alias("w"), p.alias("p"), done.alias("done")).cast(_STATE)


def _settled(e: Column, x: Column) -> Column:
    return F.array(F.struct(e["r"].alias("r"), e["id"].alias("id"), e["w"].alias("w"), x.cast("int").alias("x"))).cast(_DONE)


def _pair(acc: Column, e: Column, seed: int, level: int) -> Column:
    """One pivotal step: settles one of the two units and carries the other."""
    up, down = (1 - acc["p"]) * acc["w"], acc["p"] * acc["w"]
    e_up, e_down = (1 - e["p"]) * e["w"], e["p"] * e["w"]
    moves = F.array(F.struct(F.least(up, e_down).alias("a"), F.least(down, e_up).alias("b"), uniform(F.lit(seed), F.lit(level), acc["r"], acc["id"], e["r"]).alias("u")))

    def step(m: Column) -> Column:
        gain = m["u"] * (m["a"] + m["b"]) < m["b"]  # acc gains a, or loses b: the expected change is 0
        acc_settled = F.when(gain, up <= e_down).otherwise(down <= e_up)
        acc_p = F.when(gain, acc["p"] + m["a"] / acc["w"]).otherwise(acc["p"] - m["b"] / acc["w"])
        e_p = F.when(gain, e["p"] - m["a"] / e["w"]).otherwise(e["p"] + m["b"] / e["w"])
        return F.when(acc_settled, _unit(e, e_p, F.concat(acc["done"], _settled(acc, gain)))).otherwise(_unit(acc, acc_p, F.concat(acc["done"], _settled(e, ~gain))))

    whole = (acc["p"] < _EPS) | (acc["p"] > 1 - _EPS)
    return (
        F.when(acc["id"].isNull() & acc["w"].isNull(), _unit(e, e["p"], acc["done"]))
        .when(whole, _unit(e, e["p"], F.concat(acc["done"], _settled(acc, acc["p"] > 0.5))))
        .otherwise(F.element_at(F.transform(moves, step), 1))
    )


def _fold(units: DataFrame, level: int, seed: int) -> DataFrame:
    """source, target, source_size, base, g and the folded state of each block of at most BLOCK units."""
    empty = F.lit(None).cast(_STATE)
    start = F.struct(empty["r"].alias("r"), empty["id"].alias("id"), empty["w"].alias("w"), empty["p"].alias("p"), F.array().cast(_DONE).alias("done")).cast(_STATE)
    keys = ["source", "source_size", "target", "base"]
    grouped = units.groupBy(*keys, F.shiftright("g", 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("g", "r", "id", "w", "p"))).alias("us"))
    return grouped.select(*keys, "g", F.aggregate("us", start, lambda acc, e: _pair(acc, e, seed, level)).alias("s"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies (0 to max_repeat), taken = size * copies.

    Null source: a source of its own, last. Null or empty text: size 0, no copies. Repeated rows (and null ids) count one
    by one; rows of equal id, size and source are interchangeable. An empty table gives an empty result. Other columns are
    not read. Reruns agree: ranks and draws depend on the rows alone.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.table(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    targets = scratch.table(source_targets(scratch, base, weights, max_repeat))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64(F.lit(seed), "id").asc(), F.col("id").asc()]
    rows = scratch.table(ranked(scratch, base, order))
    starts = rows.groupBy("source").agg(F.min("rank").alias("start"))
    info = targets.join(starts.withColumnRenamed("source", "s2"), F.expr("source <=> s2")).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    info = info.withColumn("base", F.floor(ratio + _EPS).cast("int")).withColumn("frac", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    rows = rows.join(info.withColumnRenamed("source", "s2"), F.expr("source <=> s2")).drop("s2", "n")
    rows = rows.select("id", "source", "size", "source_size", "target", "base", F.when(F.col("frac") < _EPS, 0.0).otherwise(F.col("frac")).alias("p"), (F.col("rank") - F.col("start")).alias("g"))
    rows = scratch.table(rows)

    def out(df: DataFrame, id_, size, extra) -> DataFrame:
        copies = F.when(size == 0, F.lit(0)).otherwise(F.col("base") + extra).cast("int")
        return df.select(id_.alias("doc_id"), "source", size.alias("size"), "source_size", "target", copies.alias("copies")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))

    loose = (F.col("p") == 0) | (F.col("size") == 0)
    parts = [out(rows.filter(loose), F.col("id"), F.col("size"), F.lit(0))]
    units = rows.filter(~loose).select("source", "source_size", "target", "base", F.col("g").alias("g"), F.col("g").alias("r"), "id", F.col("size").alias("w"), "p")
    left, level = targets.agg(F.max("n")).first()[0] or 0, 0
    while left:
        folded = scratch.table(_fold(units, level, seed))
        done = folded.select("source", "source_size", "target", "base", F.explode("s.done").alias("d"))
        parts.append(out(done, F.col("d.id"), F.col("d.w"), F.col("d.x")))
        units = folded.select("source", "source_size", "target", "base", "g", "s.r", "s.id", "s.w", "s.p")
        left, level = (left + BLOCK - 1) // BLOCK if left > 1 else 0, level + 1
        if left <= 1:
            break
    if level:
        parts.append(out(units, F.col("id"), F.col("w"), (F.col("p") >= 0.5).cast("int")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; cases as mix_sources.

    The draws are no SQL; tests/llm checks sizes, targets and limits against fractions and the mean over seeds.
    """
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
