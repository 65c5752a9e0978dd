"""Distributed union-find over links: alternating large-star and small-star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links (16 bytes each) up to which a round is one task: dealing so few costs more than joining them.
FEW = 100_000


def connected(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable): one row for each node of the links (a, b).

    Every round groups by node for a minimum only (combined before the shuffle) and joins it back, so a node with very
    many links needs no task of its own: the join's hot keys can be split. Rounds are about the logarithm of the longest
    chain. Links from a node to itself and null ends are left out; without links the result is empty. A round over FEW
    counted links or less is the same plan in one partition, without exchanges.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.table(edges)
    state = _mark(edges)
    dealt = (lambda df: df.coalesce(1)) if state[0] <= FEW else (lambda df: df)  # rounds don't add links
    while state[0]:
        alone = dealt(edges)
        both = dealt(alone.union(alone.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large)
        below = dealt(large)
        lowest = below.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt(below.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest)).distinct()
        scratch.drop(edges)
        edges = scratch.table(small)
        scratch.drop(large)
        if state[0] > FEW:
            scratch.sweep()
        before, state = state, _mark(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(dealt(edges).select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
