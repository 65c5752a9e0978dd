"""Sum, scaling, simplification and product of operator sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..plans import guards
from ..plans.strategy import paired


#: Coefficients that are whole multiples of 2^-32 below 2^31 can be summed exactly, in any order.
FIXED = float(1 << 32)


def _exact_sum(c: str) -> Column:
    """The sum of a column as whole numbers of 2^-32; an error for a value that isn't one."""
    units = F.col(c) * F.lit(FIXED)
    whole = (F.rint(units) == units) & (F.abs(units) < F.lit(2.0**63))
    told = F.raise_error(F.concat(F.lit("exact sums need multiples of 2^-32 below 2^31, not "), F.col(c).cast("string"))).cast("decimal(20,0)")
    return F.sum(F.when(whole, units.cast("decimal(20,0)")).otherwise(told)).cast("double") / F.lit(FIXED) + F.lit(0.0)


def merged(df: DataFrame, num_qubits: int, deterministic: bool = False, exact: bool = False) -> DataFrame:
    """One row for each key with its summed coefficient; no row for an empty table, also without key columns.

    Fast sums follow Spark's order; deterministic=True adds in the order of term_id within each key, for bit-stable results,
    and gathers a key's terms for that. exact=True sums fixed-point coefficients as decimals: bit-stable too, combined
    before the shuffle, whatever a key's number of terms.
    """
    keys = bits.mask_columns(num_qubits)
    packed = 0 < num_qubits <= bits.PACKED  # one key column instead of two

    def total(c: str) -> Column:
        if exact:
            return _exact_sum(c)
        if not deterministic:
            return F.sum(c) + F.lit(0.0)
        items = F.transform(F.array_sort(F.collect_list(F.struct("term_id", c))), lambda t: t[c])
        return F.aggregate(items, F.lit(0.0), lambda a, b: a + b) + F.lit(0.0)

    out = df.groupBy(*([bits.packed_key(num_qubits).alias("_key")] if packed else keys)).agg(total("re").alias("re"), total("im").alias("im"), F.count("*").alias("_n"))
    return out.filter("_n > 0").select(*(bits.unpacked("_key", num_qubits) if packed else keys), "re", "im")


def simplified(df: DataFrame, num_qubits: int, atol: float = 1e-12, rtol: float = 0.0, deterministic: bool = False, exact: bool = False) -> DataFrame:
    """Merged terms with |sum| > atol + rtol * (largest |coefficient| before merging); NaN sums are dropped.

    The scan for the largest coefficient is left out when rtol is 0. With rtol > 0 an infinite coefficient leaves nothing.
    """
    guards.tolerances(atol, rtol)
    size = F.hypot("re", "im")
    out = merged(df, num_qubits, deterministic, exact)
    if rtol:
        largest = df.agg(F.coalesce(F.max(F.when(~F.isnan(size), size)), F.lit(0.0)).alias("_top"))
        out = out.crossJoin(F.broadcast(largest)).filter(~F.isnan(size) & (size > F.lit(float(atol)) + F.lit(float(rtol)) * F.col("_top"))).drop("_top")
    else:
        out = out.filter(~F.isnan(size) & (size > F.lit(float(atol))))
    return out


def scaled(df: DataFrame, c: complex) -> DataFrame:
    a, b = F.lit(c.real), F.lit(c.imag)
    return df.withColumns({"re": F.col("re") * a - F.col("im") * b + F.lit(0.0), "im": F.col("re") * b + F.col("im") * a + F.lit(0.0)})


def concatenated(left: DataFrame, right: DataFrame, span: int) -> DataFrame:
    """The terms of both; ids of the right side move by `span`, one above the largest id of the left."""
    return left.unionByName(right.withColumn("term_id", F.col("term_id") + F.lit(span)))


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def product(left: DataFrame, right: DataFrame, num_qubits: int, n_right: int, strategy: str = "auto", span: int | None = None, n_left: int | None = None) -> DataFrame:
    """Every left term times every right one, the left outermost; term_id is dense when both sides' are.

    span: one above the right side's largest id; n_right unless given. n_left, if known, lets the work be dealt evenly.
    """
    pairs = paired(renamed(left, "l_"), renamed(right, "r_"), n_right, strategy, n_left)
    re = F.col("l_re") * F.col("r_re") - F.col("l_im") * F.col("r_im")
    im = F.col("l_re") * F.col("r_im") + F.col("l_im") * F.col("r_re")
    masks = [F.col(f"l_{c}").bitwiseXOR(F.col(f"r_{c}")).alias(c) for c in bits.mask_columns(num_qubits)]
    ids = (F.col("l_term_id") * F.lit(n_right if span is None else span) + F.col("r_term_id")).alias("term_id")
    raw = pairs.select(ids, *masks, re.alias("re"), im.alias("im"), bits.product_phase(num_qubits).alias("_k"))
    real, imag = bits.turned(F.col("re"), F.col("im"), F.col("_k"))
    return raw.select("term_id", *bits.mask_columns(num_qubits), real.alias("re"), imag.alias("im"))
