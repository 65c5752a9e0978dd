"""The commutation relation of two operator sums as a lazy theta join, and its reductions.

Counts and degrees depend on the masks alone, so each side is reduced to distinct masks with multiplicities first and the
dense matrix is never made: work is the product of distinct masks, not of terms. Only dense or per-pair results are guarded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..plans import guards
from ..plans.ranks import running_sum
from ..plans.strategy import BROADCAST_TERMS, paired
from .algebra import renamed


class CommutationRelation:
    """lhs against rhs; `qubitwise=True` asks for compatibility at every qubit instead."""

    def __init__(self, lhs, rhs, *, qubitwise: bool = False, strategy: str = "auto"):
        guards.same_width(lhs, rhs)
        self.lhs, self.rhs, self.strategy = lhs, rhs, strategy
        self.test = (bits.qubitwise_compatible if qubitwise else bits.commutes)(lhs.num_qubits)
        self.keys = bits.mask_columns(lhs.num_qubits)

    @property
    def shape(self) -> tuple[int, int]:
        return self.lhs.num_terms, self.rhs.num_terms

    @property
    def num_entries(self) -> int:
        return self.shape[0] * self.shape[1]

    def guard(self, limit: int) -> None:
        guards.checked_product(*self.shape, limit, "max_commutation_matrix_entries")

    def pairs(self) -> DataFrame:
        """lhs_id, rhs_id, commutes for every pair; guard() it first."""
        left, right = (renamed(x.df.select("term_id", *self.keys), p) for x, p in ((self.lhs, "l_"), (self.rhs, "r_")))
        return paired(left, right, self.rhs.num_terms, self.strategy, self.lhs.num_terms).select(F.col("l_term_id").alias("lhs_id"), F.col("r_term_id").alias("rhs_id"), self.test.alias("commutes"))

    def edges(self) -> DataFrame:
        """row_id, col_id of the pairs that don't commute; of a self relation one triangle is computed and mirrored."""
        if self.lhs is not self.rhs:
            return self.pairs().filter(~F.col("commutes")).select(F.col("lhs_id").alias("row_id"), F.col("rhs_id").alias("col_id"))
        left, right = (renamed(self.lhs.df.select("term_id", *self.keys), p) for p in ("l_", "r_"))
        half = paired(left, right, self.rhs.num_terms, self.strategy, self.lhs.num_terms).filter((F.col("l_term_id") < F.col("r_term_id")) & ~self.test).select("l_term_id", "r_term_id")
        both = F.explode(F.array(F.struct(F.col("l_term_id").alias("a"), F.col("r_term_id").alias("b")), F.struct(F.col("r_term_id").alias("a"), F.col("l_term_id").alias("b")))).alias("e")
        return half.select(both).select(F.col("e.a").alias("row_id"), F.col("e.b").alias("col_id"))

    def _distinct(self, side, prefix: str) -> DataFrame:
        return renamed(side.df.groupBy(*self.keys).agg(F.count("*").alias("n")).filter("n > 0"), prefix)

    def _met(self) -> DataFrame:
        right = self._distinct(self.rhs, "r_")
        # There are 4^n masks at most: counting is left out where that is few.
        most = 4**self.lhs.num_qubits
        return paired(self._distinct(self.lhs, "l_"), right, most if most <= BROADCAST_TERMS else min(most, self.rhs.num_terms), self.strategy)

    def total(self, commuting: bool = True) -> DataFrame:
        """One row, `n`: pairs that commute (or don't)."""
        hit = self.test if commuting else ~self.test
        return self._met().agg(F.coalesce(F.sum(F.when(hit, F.col("l_n") * F.col("r_n"))), F.lit(0)).cast("long").alias("n"))

    def counts(self, axis: int, commuting: bool = True) -> DataFrame:
        """id, n for each row (axis 1) or column (axis 0), zeros included."""
        guards.axis(axis)
        own, other, side = ("l_", "r_", self.lhs) if axis == 1 else ("r_", "l_", self.rhs)
        hit = self.test if commuting else ~self.test
        per_key = self._met().groupBy(*[own + k for k in self.keys]).agg(F.sum(F.when(hit, F.col(other + "n")).otherwise(0)).alias("n"))
        ids = side.df.select("term_id", *[F.col(k).alias(own + k) for k in self.keys])
        joined = ids.join(per_key, [own + k for k in self.keys], "left") if self.keys else ids.crossJoin(F.broadcast(per_key))
        return joined.select(F.col("term_id").alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def count_commuting(self, axis=None):
        """An int (axis None), or a uint64 array by row (1) or column (0)."""
        return self._values(axis, True)

    def conflict_degrees(self, axis=None):
        """The complement of count_commuting."""
        return self._values(axis, False)

    def _values(self, axis, commuting: bool):
        guards.axis(axis)
        if axis is None:
            return int(self.total(commuting).first()[0])
        return self.counts(axis, commuting).orderBy("id").select("n").toArrow().column(0).to_numpy().astype(np.uint64)

    def both_degrees(self, commuting: bool = False) -> DataFrame:
        """axis, id, n: the degrees of all rows (axis 1) and columns (axis 0); the masks meet once for both."""
        hit = self.test if commuting else ~self.test
        sides = [[f"{p}{k}" for k in self.keys] for p in ("l_", "r_")]
        if not self.keys:
            return self.counts(1, commuting).select(F.lit(1).alias("axis"), "id", "n").union(self.counts(0, commuting).select(F.lit(0), "id", "n"))
        sums = [F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(to) for n, to in (("r_n", "by_l"), ("l_n", "by_r"))]
        met = self._met().groupingSets([[F.col(c) for c in s] for s in sides], *[F.col(c) for s in sides for c in s]).agg(F.grouping(sides[0][0]).alias("axis"), *sums)
        out = None
        for axis, own, side, n in ((1, sides[0], self.lhs, "by_l"), (0, sides[1], self.rhs, "by_r")):
            ids = side.df.select("term_id", *[F.col(k).alias(o) for k, o in zip(self.keys, own, strict=True)])
            per_key = met.filter(F.col("axis") == 1 - axis).select(*own, F.col(n).alias("n"))
            got = ids.join(per_key, own, "left").select(F.lit(axis).alias("axis"), F.col("term_id").alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            out = got if out is None else out.union(got)
        return out

    def to_arrow(self):
        """The edges as an Arrow table."""
        return self.edges().toArrow()

    def row_offsets(self) -> DataFrame:
        """row_id, start: exclusive running sum of the conflict degrees by row, over ranges of rows."""
        degrees = self.counts(1, False).select(F.col("id").alias("row_id"), "n")
        return running_sum(degrees, F.col("row_id"), "n", "start").select("row_id", "start")

    def csr(self, limit: int = guards.MAX_PAIR_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
        """row_offsets (rows + 1; [0] if a side is empty) and ascending col_indices; at most `limit` of these."""
        rows, cols = self.shape
        if not rows or not cols:
            return np.zeros(1, np.uint64), np.zeros(0, np.uint64)
        degrees = self.conflict_degrees(1)
        guards.checked_product(int(degrees.sum()), 1, limit, "limit")
        listed = self.edges().orderBy("row_id", "col_id").select("col_id").toArrow().column(0).to_numpy()
        return np.concatenate(([0], np.cumsum(degrees))).astype(np.uint64), listed.astype(np.uint64)

    def top_conflicts(self, k: int, axis: int = 1) -> DataFrame:
        """id, n of the k rows (axis 1) or columns with most conflicts; ties to the lower id."""
        return self.counts(axis, False).orderBy(F.desc("n"), "id").limit(k)

    def grouping_summary(self, k: int) -> dict:
        """Total conflicts, and the top k rows and columns as (id, degree)."""
        top = lambda axis: [(r.id, r.n) for r in self.top_conflicts(k, axis).collect()]
        return {"total": self.conflict_degrees(), "rows": top(1), "cols": top(0)}

    def to_numpy(self, limit: int = guards.MAX_PAIR_ENTRIES):
        """A bool for 1 x 1, a vector if exactly one side has one term, else a matrix."""
        self.guard(limit)
        rows, cols = self.shape
        got = self.pairs().orderBy("lhs_id", "rhs_id").select("commutes").toPandas()["commutes"].to_numpy(bool)
        if rows == 1 and cols == 1:
            return bool(got[0])
        return got if rows == 1 or cols == 1 else got.reshape(rows, cols)

    def into(self, out: np.ndarray) -> np.ndarray:
        """Fills a one-dimensional bool array of num_entries, row by row."""
        if not isinstance(out, np.ndarray) or out.dtype != np.bool_:
            raise TypeError("out must be a bool array")
        if out.ndim != 1 or out.size != self.num_entries:
            raise ValueError("out must be one-dimensional with one place for each entry")
        self.guard(guards.MAX_PAIR_ENTRIES)
        out[:] = self.pairs().orderBy("lhs_id", "rhs_id").select("commutes").toPandas()["commutes"].to_numpy(bool)
        return out
