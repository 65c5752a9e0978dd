"""Driver-side checks; their texts name the argument at fault."""

from __future__ import annotations

import math

MAX_PRODUCT_TERMS = 50_000_000
MAX_PAIR_ENTRIES = 100_000_000
_SIZE_LIMIT = 1 << 64


def checked_product(a: int, b: int, limit: int, name: str) -> int:
    """a * b, at most `limit`."""
    if a * b >= _SIZE_LIMIT:
        raise ValueError(f"{a} x {b} overflows the size type; see {name}")
    if a * b > limit:
        raise ValueError(f"{a} x {b} = {a * b} is above {name}={limit}")
    return a * b


def qubits(n) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("num_qubits must be an integer")
    if n < 0:
        raise ValueError("num_qubits must be non-negative")
    return n


def same_width(a, b) -> None:
    if a.num_qubits != b.num_qubits:
        raise ValueError(f"operands must have the same num_qubits, not {a.num_qubits} and {b.num_qubits}")
    if a.df.sparkSession is not b.df.sparkSession and a.df.sparkSession != b.df.sparkSession:
        raise ValueError("operands must belong to one SparkSession")


def tolerances(*values: float) -> None:
    for v in values:
        if not math.isfinite(v):
            raise ValueError("tolerances must be non-negative finite numbers")
        if v < 0:
            raise ValueError("tolerances must be non-negative")


def coefficient(c) -> complex:
    try:
        if isinstance(c, (str, bytes)):
            raise TypeError
        return complex(c)
    except (TypeError, ValueError):
        raise ValueError(f"a coefficient must be numeric, not {c!r}") from None


def axis(value) -> None:
    if value not in (None, 0, 1):
        raise ValueError("axis must be None, 0, or 1")
