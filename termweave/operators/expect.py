"""Expectation values over statevectors (equi-joins on computed basis states) and Z-basis histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..plans.strategy import counted, paired

MAX_QUBITS = 63


def _sign(x: Column) -> Column:
    return F.lit(1) - 2 * F.bit_count(x).bitwiseAND(F.lit(1)).cast("int")


def statevector_terms(terms: DataFrame, psi: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, x0, z0, value: real expectation of each distinct mask pair in each state.

    psi: keys, basis, re, im. Terms are merged by mask first. The pairing psi[b], psi[b ^ x] is made once for each distinct
    x, over the half of the basis without x's lowest bit (doubled), and reused for every z. The distinct x are counted: few
    are broadcast, more are dealt as blocks; what is joined by equality is left to AQE.
    """
    keys = keys or []
    masks = terms.select("x0", "z0").distinct()
    flips = masks.select("x0").distinct().withColumn("_low", F.col("x0").bitwiseAND(-F.col("x0")))
    right = psi.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("basis").alias("_b"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    left = paired(psi, flips, counted(flips)).filter(F.col("basis").bitwiseAND(F.col("_low")) == 0).withColumn("_to", F.col("basis").bitwiseXOR(F.col("x0")))
    on = [F.col("_to") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    met = left.join(right, on)
    real = (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")) * F.when(F.col("x0") == 0, 1.0).otherwise(2.0)
    imag = (F.col("_re") * F.col("im") - F.col("_im") * F.col("re")) * F.when(F.col("x0") == 0, 1.0).otherwise(2.0)
    overlap = met.select(*keys, "x0", "basis", real.alias("p"), imag.alias("q"))
    signed = overlap.join(masks, "x0")
    k = F.bit_count(F.col("x0").bitwiseAND(F.col("z0"))).bitwiseAND(F.lit(3))
    part = F.when(k == 0, F.col("p")).when(k == 1, -F.col("q")).when(k == 2, -F.col("p")).otherwise(F.col("q"))
    return signed.groupBy(*keys, "x0", "z0").agg(F.sum(part * _sign(F.col("z0").bitwiseAND(F.col("basis")))).alias("value"))


def statevector_expectation(terms: DataFrame, psi: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, re, im: sum of coefficient times value; no row for states that no term meets."""
    merged = terms.groupBy("x0", "z0").agg(F.sum("re").alias("c_re"), F.sum("im").alias("c_im"))
    values = statevector_terms(terms, psi, keys).join(merged, ["x0", "z0"])
    return values.groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.col("value") * F.col("c_re")), F.lit(0.0)).alias("re"), F.coalesce(F.sum(F.col("value") * F.col("c_im")), F.lit(0.0)).alias("im"))


def packed_bitstrings(hist: DataFrame, num_qubits: int) -> DataFrame:
    """b0, b1, ... and cnt of a histogram (bitstring, cnt); the right-most character is qubit 0."""
    columns = []
    for w in range(bits.words_for(num_qubits)):
        n = min(bits.WORD, num_qubits - bits.WORD * w)
        piece = F.substring("bitstring", max(0, num_qubits - bits.WORD * (w + 1)) + 1, n)
        columns.append(F.conv(piece, 2, -10).cast("long").alias(f"b{w}"))
    return hist.select(*columns, F.col("cnt").cast("double").alias("cnt"))


def z_counts_expectation(terms: DataFrame, hist: DataFrame, num_qubits: int) -> DataFrame:
    """One row, re and im: the signed mean of each diagonal term over the histogram, times its coefficient, summed."""
    zs = [f"z{w}" for w in range(bits.words_for(num_qubits))]
    merged = terms.groupBy(*zs).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    rows = packed_bitstrings(hist, num_qubits)
    rows = rows.groupBy(*[c for c in rows.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))
    parity = F.lit(0)
    for w, z in enumerate(zs):
        parity = parity + F.bit_count(F.col(z).bitwiseAND(F.col(f"b{w}")))
    sign = F.lit(1) - 2 * parity.bitwiseAND(F.lit(1)).cast("int")
    means = paired(merged, rows, counted(rows)).groupBy(*zs, "re", "im").agg((F.sum(sign * F.col("cnt")) / F.sum("cnt")).alias("m"))
    return means.agg(F.coalesce(F.sum(F.col("m") * F.col("re")), F.lit(0.0)).alias("re"), F.coalesce(F.sum(F.col("m") * F.col("im")), F.lit(0.0)).alias("im"))


def check_histogram(hist: DataFrame, num_qubits: int) -> None:
    """ValueError for negative or non-finite counts, a total of 0, and wrong lengths or characters, in this order."""
    c = F.col("cnt").cast("double")
    bad = hist.agg(F.max((c < 0).cast("int")), F.max((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int")), F.sum(c), F.max((F.length("bitstring") != num_qubits).cast("int")), F.max((~F.col("bitstring").rlike("^[01]*$")).cast("int"))).first()
    if bad[0]:
        raise ValueError("counts must be non-negative")
    if bad[1]:
        raise ValueError("counts must be finite")
    if not bad[2]:
        raise ValueError("the total count must be positive")
    if bad[3]:
        raise ValueError("a bitstring's length must be num_qubits")
    if bad[4]:
        raise ValueError("bitstrings must consist of 0 or 1")
