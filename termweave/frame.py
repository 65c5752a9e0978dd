"""OperatorFrame: a sum of Pauli strings as a DataFrame of terms. Everything is lazy but what returns Python values."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, codec
from .operators import algebra, expect, grouping
from .operators.commute import CommutationRelation
from .plans import guards
from .plans.ranks import dense_ids
from .plans.storage import stored
from .sources import adapters, tables


class OperatorFrame:
    """df: term_id, x0, z0, x1, z1, ..., re, im; num_terms is counted when first asked for, unless it is known."""

    def __init__(self, df: DataFrame, num_qubits: int, num_terms: int | None = None, span: int | None = None):
        self.df, self.num_qubits, self._num_terms, self._span = df, guards.qubits(num_qubits), num_terms, span

    # -- sources --

    @classmethod
    def zeros(cls, spark: SparkSession, num_qubits: int, num_terms: int = 0) -> OperatorFrame:
        return cls(tables.zeros(spark, num_qubits, num_terms), num_qubits, num_terms)

    @classmethod
    def empty(cls, spark: SparkSession, num_qubits: int) -> OperatorFrame:
        return cls.zeros(spark, num_qubits)

    @classmethod
    def from_labels(cls, spark: SparkSession, labels, coeffs=None) -> OperatorFrame:
        return cls(*tables.from_labels(spark, labels, coeffs))

    @classmethod
    def from_sparse_list(cls, spark: SparkSession, terms, num_qubits: int) -> OperatorFrame:
        return cls(*tables.from_sparse_list(spark, terms, num_qubits))

    @classmethod
    def from_df(cls, df: DataFrame, num_qubits: int, **columns) -> OperatorFrame:
        return cls(tables.from_df(df, num_qubits, **columns), num_qubits)

    @classmethod
    def from_qiskit(cls, spark: SparkSession, op) -> OperatorFrame:
        labels, coeffs, n = adapters.qiskit_terms(op)
        return cls.from_labels(spark, labels, coeffs) if labels else cls.empty(spark, n)

    @classmethod
    def from_openfermion(cls, spark: SparkSession, op, num_qubits: int | None = None) -> OperatorFrame:
        return cls.from_sparse_list(spark, *adapters.openfermion_terms(op, num_qubits))

    # -- metadata --

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def words(self) -> int:
        return bits.words_for(self.num_qubits)

    @property
    def num_terms(self) -> int:
        if self._num_terms is None:
            self._num_terms = self.df.count()
        return self._num_terms

    @property
    def id_span(self) -> int:
        """One above the largest term_id: the ids of a DataFrame of one's own needn't be dense."""
        if self._span is None:
            n, top = self.df.agg(F.count("*"), F.max("term_id")).first()
            self._num_terms, self._span = n, 0 if top is None else top + 1
        return self._span

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> OperatorFrame:
        """Keeps the terms on the executors."""
        return OperatorFrame(self.df.persist(level), self.num_qubits, self._num_terms)

    def unpersist(self) -> OperatorFrame:
        return OperatorFrame(self.df.unpersist(), self.num_qubits, self._num_terms)

    # -- sinks --

    def labels_df(self) -> DataFrame:
        return self.df.select("term_id", codec.label_of_masks(self.num_qubits).alias("label"), "re", "im")

    def sparse_df(self) -> DataFrame:
        letters, qubits = codec.sparse_of_label(F.col("label"))
        return self.labels_df().select("term_id", letters.alias("local"), qubits.alias("qubits"), "re", "im")

    def to_labels(self) -> tuple[list[str], np.ndarray]:
        rows = self.labels_df().orderBy("term_id").collect()
        return [r.label for r in rows], np.array([complex(r.re, r.im) for r in rows], np.complex128)

    def to_sparse_list(self) -> list[tuple[str, list[int], complex]]:
        return [(r.local, list(r.qubits), complex(r.re, r.im)) for r in self.sparse_df().orderBy("term_id").collect()]

    def to_arrow(self):
        return self.df.toArrow()

    def to_qiskit(self):
        labels, coeffs = self.to_labels()
        return adapters.to_qiskit(labels, coeffs, self.num_qubits)

    def to_openfermion(self):
        return adapters.to_openfermion(self.to_sparse_list())

    # -- algebra --

    def __add__(self, other: OperatorFrame) -> OperatorFrame:
        if not isinstance(other, OperatorFrame):
            return NotImplemented
        guards.same_width(self, other)
        span = self.id_span
        total = self.num_terms + other._num_terms if other._num_terms is not None else None
        return OperatorFrame(algebra.concatenated(self.df, other.df, span), self.num_qubits, total)

    def __mul__(self, c) -> OperatorFrame:
        return OperatorFrame(algebra.scaled(self.df, guards.coefficient(c)), self.num_qubits, self._num_terms)

    __rmul__ = __mul__

    def simplify(self, atol: float = 1e-12, rtol: float = 0.0, *, deterministic: bool = False, exact: bool = False, numbered: bool = True) -> OperatorFrame:
        """Merged terms in canonical order; numbered=False leaves the order (and the sort) out. Kinds of sums: see merged()."""
        out = algebra.simplified(self.df, self.num_qubits, atol, rtol, deterministic, exact)
        if not numbered:
            out = out.withColumn("term_id", F.monotonically_increasing_id())
        elif self.words:
            out = dense_ids(out, bits.canonical_order(self.num_qubits))
        else:
            out = out.withColumn("term_id", F.lit(0).cast("long"))
        return OperatorFrame(out.select("term_id", *bits.mask_columns(self.num_qubits), "re", "im"), self.num_qubits)

    def sort(self, by_weight: bool = False) -> OperatorFrame:
        """Canonical order, or by weight first; an extension, ties by term_id."""
        order = [*([bits.weight(self.num_qubits)] if by_weight else []), *bits.canonical_order(self.num_qubits), F.col("term_id")]
        named = self.df.select(*[o.alias(f"_k{i}") for i, o in enumerate(order)], *bits.mask_columns(self.num_qubits), "re", "im")
        out = dense_ids(named, [F.col(f"_k{i}") for i in range(len(order))])
        return OperatorFrame(out.select("term_id", *bits.mask_columns(self.num_qubits), "re", "im"), self.num_qubits, self._num_terms)

    def matmul(self, other: OperatorFrame, simplify: bool = True, max_intermediate_terms: int = guards.MAX_PRODUCT_TERMS, strategy: str = "auto") -> OperatorFrame:
        """The product; `other` acts first. With simplify, both sides are merged before the pairs are made."""
        guards.same_width(self, other)
        n = guards.checked_product(self.num_terms, other.num_terms, max_intermediate_terms, "max_intermediate_terms")
        if not simplify:
            return OperatorFrame(algebra.product(self.df, other.df, self.num_qubits, other.num_terms, strategy, other.id_span, self.num_terms), self.num_qubits, n)
        left, right = (algebra.merged(x.df, self.num_qubits).withColumn("term_id", F.lit(0).cast("long")) for x in (self, other))
        return OperatorFrame(algebra.product(left, right, self.num_qubits, min(4**self.num_qubits, other.num_terms), strategy), self.num_qubits).simplify()

    def __matmul__(self, other: OperatorFrame) -> OperatorFrame:
        return self.matmul(other) if isinstance(other, OperatorFrame) else NotImplemented

    # -- commutation and grouping --

    def relation(self, other: OperatorFrame, *, qubitwise: bool = False, strategy: str = "auto") -> CommutationRelation:
        """The lazy relation: counts, degrees, edges, top-k and dense forms."""
        return CommutationRelation(self, other, qubitwise=qubitwise, strategy=strategy)

    def commutes_with(self, other: OperatorFrame, max_commutation_matrix_entries: int = guards.MAX_PAIR_ENTRIES, output: np.ndarray | None = None):
        """A bool, a vector or a matrix; with output, a one-dimensional bool array that is filled row by row and returned."""
        relation = self.relation(other)
        return relation.to_numpy(max_commutation_matrix_entries) if output is None else relation.into(output)

    def group_df(self, mode: str = "qwc", strategy: str = "largest_first", max_terms_for_graph: int = 50_000) -> DataFrame:
        return grouping.grouped(self.df, self.num_qubits, mode, strategy, max_terms_for_graph)

    def group_commuting(self, mode: str = "qwc", strategy: str = "largest_first", max_terms_for_graph: int = 50_000) -> list[OperatorFrame]:
        """One frame for each group, in order; [] without terms. The grouped terms are stored once; only sizes reach the driver."""
        rows = stored(self.group_df(mode, strategy, max_terms_for_graph), "groups")
        sizes = rows.groupBy("group_id").count().orderBy("group_id").collect()
        terms = lambda g: rows.filter(F.col("group_id") == g).select(F.col("pos_in_group").cast("long").alias("term_id"), *bits.mask_columns(self.num_qubits), "re", "im")
        return [OperatorFrame(terms(g), self.num_qubits, n) for g, n in sizes]

    # -- expectation values --

    def expectation_statevector(self, psi) -> complex:
        """psi: a contiguous one-dimensional complex64 or complex128 array of length 2**num_qubits, not normalised here."""
        if not isinstance(psi, np.ndarray):
            raise TypeError("psi must be a NumPy array")
        if psi.dtype not in (np.complex64, np.complex128):
            raise TypeError("psi must be complex64 or complex128")
        if psi.ndim != 1:
            raise ValueError("psi must be one-dimensional")
        if not psi.flags.c_contiguous:
            raise TypeError("psi must be contiguous")
        if self.num_qubits > expect.MAX_QUBITS:
            raise ValueError(f"num_qubits must be at most {expect.MAX_QUBITS}")
        if len(psi) != 1 << self.num_qubits:
            raise ValueError("psi must have length 2**num_qubits")
        if not self.words:
            c = self.df.agg(F.coalesce(F.sum("re"), F.lit(0.0)), F.coalesce(F.sum("im"), F.lit(0.0))).first()
            return complex(*c) * float(abs(psi[0]) ** 2)
        import pandas as pd

        v = psi.astype(np.complex128)
        state = self.spark.createDataFrame(pd.DataFrame({"basis": np.arange(len(v)), "re": v.real, "im": v.imag}), "basis long, re double, im double")
        got = expect.statevector_expectation(self.df, state).first()
        return complex(got.re, got.im) if got is not None else 0j

    def expectation_statevector_df(self, psi: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Batched: psi has keys, basis, re, im; one row for each state."""
        return expect.statevector_expectation(self.df, psi, keys)

    def expectation_z_counts(self, counts: dict) -> complex:
        rows = []
        for b, n in counts.items():
            if isinstance(n, bool) or not isinstance(n, (int, float, np.number)):
                raise ValueError("counts must be numeric")
            if not isinstance(b, str):
                raise TypeError("bitstrings must be strings")
            rows.append((b, float(n)))
        if self.df.filter(~bits.is_diagonal(self.num_qubits)).limit(1).count():
            raise ValueError("Z counts need a diagonal operator")
        if any(math.isnan(n) or math.isinf(n) for _, n in rows if not n < 0):
            if any(n < 0 for _, n in rows):
                raise ValueError("counts must be non-negative")
            raise ValueError("counts must be finite")
        hist = self.spark.createDataFrame(rows, "bitstring string, cnt double")
        expect.check_histogram(hist, self.num_qubits)
        if not self.words:
            c = self.df.agg(F.coalesce(F.sum("re"), F.lit(0.0)), F.coalesce(F.sum("im"), F.lit(0.0))).first()
            return complex(*c)
        got = expect.z_counts_expectation(self.df, hist, self.num_qubits).first()
        return complex(got.re, got.im)

    def expectation_z_counts_df(self, hist: DataFrame) -> DataFrame:
        return expect.z_counts_expectation(self.df, hist, self.num_qubits)
