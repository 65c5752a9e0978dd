"""Labels over I, X, Y, Z (the right-most character is qubit 0) to mask words and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import WORD, words_for

#: A phase prefix of a label and its exponent of i.
PHASES = {"": 0, "+": 0, "i": 1, "+i": 1, "-": 2, "-i": 3}


def masks_of_label(label: Column, num_qubits: int) -> dict[str, Column]:
    """x0, z0, ... of labels of one known length."""
    out = {}
    for w in range(words_for(num_qubits)):
        high = max(0, num_qubits - WORD * (w + 1))
        piece = F.substring(label, high + 1, min(WORD, num_qubits - WORD * w))
        for name, bits in (("x", "0110"), ("z", "0011")):
            out[f"{name}{w}"] = F.conv(F.translate(piece, "IXYZ", bits), 2, -10).cast("long")
    return out


def _bit(name: str, q: int) -> Column:
    return F.shiftrightunsigned(F.col(f"{name}{q // WORD}"), q % WORD).bitwiseAND(F.lit(1)).cast("int")


def label_of_masks(num_qubits: int) -> Column:
    """The dense label of a term; built word by word from binary digits, so its size doesn't grow with the qubits."""
    parts = []
    for w in reversed(range(words_for(num_qubits))):
        n = min(WORD, num_qubits - WORD * w)
        digits = lambda c: F.lpad(F.bin(c), n, "0")  # noqa: B023, E731
        pairs = F.zip_with(F.split(digits(F.col(f"x{w}")), ""), F.split(F.translate(digits(F.col(f"z{w}")), "01", "ab"), ""), lambda a, b: F.concat(a, b))
        parts.append(F.array_join(F.transform(pairs, lambda p: F.when(p == "0a", "I").when(p == "1a", "X").when(p == "1b", "Y").otherwise("Z")), ""))
    return F.concat(*parts) if parts else F.lit("")


def sparse_of_label(label: Column) -> tuple[Column, Column]:
    """(letters, qubits) of a label without its I, by ascending qubit."""
    chars = F.filter(F.split(F.reverse(label), ""), lambda c: c != "")
    at = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.cast("long").alias("q"))), lambda s: s["c"] != "I")
    return F.array_join(F.transform(at, lambda s: s["c"]), ""), F.transform(at, lambda s: s["q"])


def phase_and_label(label: Column) -> tuple[Column, Column]:
    """Exponent of i of the prefix, and the bare label; null for what isn't one."""
    pattern = r"^(-i|\+i|i|-|\+)?([IXYZ]*)$"
    prefix, bare = F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2)
    k = F.lit(None).cast("int")
    for text, value in PHASES.items():
        k = F.when(label.rlike(pattern) & (prefix == text), value).otherwise(k)
    return k, F.when(label.rlike(pattern), bare)
