"""Running simplification and running Z-basis means over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..operators.expect import packed_bitstrings


def running_terms(stream: DataFrame, num_qubits: int) -> DataFrame:
    """Merged coefficients by key of a stream of terms, for update or complete mode.

    The drop threshold isn't monotone under new data, so it is applied by the reader: see significant().
    """
    return stream.groupBy(*bits.mask_columns(num_qubits)).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def windowed_terms(stream: DataFrame, num_qubits: int, time: str, window: str, late: str) -> DataFrame:
    """The same in event-time windows, with a watermark that bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *bits.mask_columns(num_qubits)).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def significant(batch: DataFrame, atol: float = 1e-12) -> DataFrame:
    """What simplify() would keep of a batch of running sums, with rtol = 0."""
    size = F.hypot("re", "im")
    return batch.filter(~F.isnan(size) & (size > F.lit(float(atol))))


def running_histogram(stream: DataFrame, num_qubits: int) -> DataFrame:
    """Running counts by basis state of a stream (bitstring, cnt)."""
    packed = packed_bitstrings(stream, num_qubits)
    return packed.groupBy(*[c for c in packed.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))
