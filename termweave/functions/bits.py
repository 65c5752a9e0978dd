"""Columns over the mask words of one or two terms; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64
#: Qubits up to which both masks of a term fit one non-negative number.
PACKED = 31
SIGN = -(1 << 63)


def words_for(num_qubits: int) -> int:
    """Mask words of so many qubits; none for zero."""
    return -(-num_qubits // WORD)


def mask_columns(num_qubits: int, prefix: str = "") -> list[str]:
    """x0, z0, x1, z1, ...: also the canonical key, word by word."""
    return [f"{prefix}{m}{w}" for w in range(words_for(num_qubits)) for m in "xz"]


def canonical_order(num_qubits: int, prefix: str = "") -> list[Column]:
    """Sort keys that order the words as unsigned numbers."""
    return [F.col(c).bitwiseXOR(F.lit(SIGN)) for c in mask_columns(num_qubits, prefix)]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def _per_word(num_qubits: int, f: Callable[[int], Column]) -> list[Column]:
    return [f(w) for w in range(words_for(num_qubits))]


def packed_key(num_qubits: int, prefix: str = "") -> Column:
    """x0 above z0 in one number, for up to PACKED qubits; its order is the canonical one."""
    return F.shiftleft(f"{prefix}x0", num_qubits).bitwiseOR(F.col(f"{prefix}z0"))


def unpacked(key: str, num_qubits: int) -> list[Column]:
    """x0 and z0 of a packed key."""
    return [F.shiftright(key, num_qubits).alias("x0"), F.col(key).bitwiseAND(F.lit((1 << num_qubits) - 1)).alias("z0")]


def weight(num_qubits: int, prefix: str = "") -> Column:
    """Qubits that a term acts on."""
    return _sum(_per_word(num_qubits, lambda w: F.bit_count(F.col(f"{prefix}x{w}").bitwiseOR(F.col(f"{prefix}z{w}"))))).cast("int")


def y_count(num_qubits: int, prefix: str = "") -> Column:
    return _sum(_per_word(num_qubits, lambda w: F.bit_count(F.col(f"{prefix}x{w}").bitwiseAND(F.col(f"{prefix}z{w}"))))).cast("int")


def is_diagonal(num_qubits: int, prefix: str = "") -> Column:
    """Neither X nor Y anywhere."""
    return reduce(lambda a, b: a & b, _per_word(num_qubits, lambda w: F.col(f"{prefix}x{w}") == 0), F.lit(True))


def _clash(w: int, a: str, b: str) -> Column:
    return F.col(f"{a}x{w}").bitwiseAND(F.col(f"{b}z{w}")).bitwiseXOR(F.col(f"{a}z{w}").bitwiseAND(F.col(f"{b}x{w}")))


def commutes(num_qubits: int, a: str = "l_", b: str = "r_") -> Column:
    """Whether two terms commute: an even number of qubits where they clash."""
    return _sum(_per_word(num_qubits, lambda w: F.bit_count(_clash(w, a, b)))).bitwiseAND(F.lit(1)) == 0


def qubitwise_compatible(num_qubits: int, a: str = "l_", b: str = "r_") -> Column:
    """Whether two terms commute at every qubit."""
    return reduce(lambda p, q: p & q, _per_word(num_qubits, lambda w: _clash(w, a, b) == 0), F.lit(True))


def product_phase(num_qubits: int, a: str = "l_", b: str = "r_") -> Column:
    """k (0 to 3) such that the product of two terms carries i**k; the right one acts first."""

    def part(w: int) -> Column:
        ax, az, bx, bz = (F.col(f"{p}{m}{w}") for p in (a, b) for m in "xz")
        own = F.bit_count(ax.bitwiseXOR(bx).bitwiseAND(az.bitwiseXOR(bz)))
        return own - F.bit_count(ax.bitwiseAND(az)) - F.bit_count(bx.bitwiseAND(bz)) + 2 * F.bit_count(ax.bitwiseAND(bz))

    return _sum(_per_word(num_qubits, part)).bitwiseAND(F.lit(3))


def turned(re: Column, im: Column, k: Column) -> tuple[Column, Column]:
    """(re + i im) * i**k by swapping parts, without multiplication; +0.0 clears the sign of zeros."""
    real = F.when(k == 0, re).when(k == 1, -im).when(k == 2, -re).otherwise(im)
    imag = F.when(k == 0, im).when(k == 1, re).when(k == 2, -im).otherwise(-re)
    return real + F.lit(0.0), imag + F.lit(0.0)
