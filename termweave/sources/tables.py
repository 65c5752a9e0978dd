"""Term tables from Python lists and from DataFrames, as (DataFrame, num_qubits, num_terms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, codec
from ..plans import guards
from ..plans.ranks import dense_ids


def term_schema(num_qubits: int) -> str:
    return ", ".join(["term_id long", *[f"{c} long" for c in bits.mask_columns(num_qubits)], "re double", "im double"])


def zeros(spark: SparkSession, num_qubits: int, num_terms: int = 0) -> DataFrame:
    """num_terms identity terms with coefficient 0."""
    masks = [F.lit(0).cast("long").alias(c) for c in bits.mask_columns(guards.qubits(num_qubits))]
    if num_terms < 0:
        raise ValueError("num_terms must be non-negative")
    return spark.range(num_terms).select(F.col("id").alias("term_id"), *masks, F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))


def coefficients(given, n: int) -> list[complex]:
    """None: all 1; a scalar: for one label only; else n numbers."""
    if given is None:
        return [1.0 + 0j] * n
    if isinstance(given, (int, float, complex)) or not hasattr(given, "__iter__"):
        if n != 1:
            raise ValueError("a scalar coefficient needs exactly one label")
        return [guards.coefficient(given)]
    out = [guards.coefficient(c) for c in given]
    if len(out) != n:
        raise ValueError(f"{len(out)} coefficients for {n} terms")
    return out


def check_labels(labels) -> list[str]:
    if isinstance(labels, (str, bytes)):
        raise ValueError("labels must be an iterable of strings, not a single string")
    labels = list(labels)
    if not labels:
        raise ValueError("labels must not be empty; use empty() for no terms")
    for s in labels:
        if not isinstance(s, str):
            raise ValueError("a label must be a string")
        if len(s) != len(labels[0]):
            raise ValueError("labels must have equal lengths")
        if s.strip("IXYZ"):
            raise ValueError(f"a label has a character outside IXYZ: {s!r}")
    return labels


def from_labels(spark: SparkSession, labels, coeffs=None) -> tuple[DataFrame, int, int]:
    labels = check_labels(labels)
    values = coefficients(coeffs, len(labels))
    rows = [(i, s, c.real, c.imag) for i, (s, c) in enumerate(zip(labels, values, strict=True))]
    return parsed(spark.createDataFrame(rows, "term_id long, label string, re double, im double"), len(labels[0])), len(labels[0]), len(rows)


def parsed(df: DataFrame, num_qubits: int, label: str = "label") -> DataFrame:
    """Masks of a column of labels of one length; raises when run if a label is none."""
    ok = F.col(label).rlike(f"^[IXYZ]{{{num_qubits}}}$")
    checked = F.when(ok, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("not a label of num_qubits characters IXYZ: "), F.coalesce(label, F.lit("null")))).cast("string"))
    masks = codec.masks_of_label(F.col("_l"), num_qubits)
    return df.withColumn("_l", checked).select("term_id", *[masks[c].alias(c) for c in bits.mask_columns(num_qubits)], "re", "im")


def check_sparse(terms, num_qubits: int) -> list[tuple[int, list[tuple[str, int]], complex]]:
    out = []
    for i, (local, qubits, c) in enumerate(terms):
        qubits = [int(q) for q in qubits]
        if len(local) != len(qubits):
            raise ValueError("letters and qubits of a term must have equal lengths")
        if set(local) - set("IXYZ"):
            raise ValueError(f"a term has a character outside IXYZ: {local!r}")
        if any(q < 0 or q >= num_qubits for q in qubits):
            raise ValueError("a qubit is out of range")
        if len(set(qubits)) != len(qubits):
            raise ValueError("a term has a duplicate qubit")
        out.append((i, list(zip(local, qubits, strict=True)), guards.coefficient(c)))
    return out


def from_sparse_list(spark: SparkSession, terms, num_qubits: int) -> tuple[DataFrame, int, int]:
    guards.qubits(num_qubits)
    rows = [(i, "".join(p for p, _ in at), [q for _, q in at], c.real, c.imag) for i, at, c in check_sparse(terms, num_qubits)]
    df = spark.createDataFrame(rows, "term_id long, local string, qubits array<long>, re double, im double")
    return sparse_parsed(df, num_qubits), num_qubits, len(rows)


def sparse_parsed(df: DataFrame, num_qubits: int) -> DataFrame:
    """Masks of (term_id, local, qubits, re, im): a fold over each term's own letters, without a shuffle.

    Letters beside no qubit, unknown letters, duplicate and out-of-range qubits raise when the plan runs.
    """
    letters = F.filter(F.split("local", ""), lambda c: c != "")
    bad = (F.size(letters) != F.size("qubits")) | (F.size(F.array_distinct("qubits")) != F.size("qubits")) | ~F.col("local").rlike("^[IXYZ]*$")
    bad = bad | F.exists("qubits", lambda q: (q < 0) | (q >= num_qubits))
    checked = F.when(~bad, F.arrays_zip(letters.alias("c"), F.col("qubits").alias("q"))).otherwise(F.raise_error(F.lit("a sparse term is malformed")).cast("array<struct<c:string,q:bigint>>"))
    columns = []
    for c in bits.mask_columns(num_qubits):
        w, on = int(c[1:]), ("X", "Y") if c[0] == "x" else ("Z", "Y")
        own = lambda s: (s["q"] >= bits.WORD * w) & (s["q"] < bits.WORD * (w + 1)) & s["c"].isin(*on)  # noqa: B023, E731
        columns.append(F.aggregate(F.filter("_at", own), F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["q"].cast("int") % bits.WORD))).alias(c))
    return df.withColumn("_at", checked).select("term_id", *columns, "re", "im")


def from_df(df: DataFrame, num_qubits: int, *, label: str | None = None, masks: dict[str, Column] | None = None, re: Column, im: Column | None = None, order_by: list[Column] | None = None, term_id: Column | None = None) -> DataFrame:
    """A term table over any DataFrame, e.g. a Parquet scan: masks or a label column, coefficients, and an order.

    term_id: a unique integer column; else order_by: a unique sort key from which dense ids are made.
    """
    if (label is None) == (masks is None):
        raise ValueError("give either label or masks")
    if (order_by is None) == (term_id is None):
        raise ValueError("give either order_by, a unique sort key, or term_id")
    if masks is not None:
        src = df.select(*[masks.get(c, F.lit(0)).cast("long").alias(c) for c in bits.mask_columns(num_qubits)], *[k.alias(f"_o{i}") for i, k in enumerate(order_by or [])], *([term_id.cast("long").alias("term_id")] if term_id is not None else []), re.cast("double").alias("re"), (im if im is not None else F.lit(0.0)).cast("double").alias("im"))
    else:
        src = df.select(F.col(label).alias("label"), *[k.alias(f"_o{i}") for i, k in enumerate(order_by or [])], *([term_id.cast("long").alias("term_id")] if term_id is not None else []), re.cast("double").alias("re"), (im if im is not None else F.lit(0.0)).cast("double").alias("im"))
    if term_id is None:
        src = dense_ids(src, [F.col(f"_o{i}") for i in range(len(order_by))]).drop(*[f"_o{i}" for i in range(len(order_by))])
    return parsed(src, num_qubits) if label is not None else src.select("term_id", *bits.mask_columns(num_qubits), "re", "im")
