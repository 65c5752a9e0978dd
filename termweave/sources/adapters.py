"""Duck-typed adapters for the operator objects of two circuit libraries; each is imported only when it is needed."""

from __future__ import annotations

import re

from ..functions.codec import PHASES
from ..plans import guards

_PHASED = re.compile(r"(-i|\+i|i|-|\+)?([IXYZ]*)")


def unphased(label: str, c: complex) -> tuple[str, complex]:
    """The bare label and the coefficient with the prefix folded in."""
    m = _PHASED.fullmatch(label)
    if not m:
        raise ValueError(f"not a label: {label!r}")
    k = PHASES[m[1] or ""]
    return m[2], (c, complex(-c.imag, c.real), -c, complex(c.imag, -c.real))[k]


def _library(name: str, hint: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError:
        raise ImportError(f"{name} isn't installed; {hint}") from None


def qiskit_terms(op) -> tuple[list[str], list[complex], int]:
    """Labels, coefficients and width of a SparsePauliOp."""
    kind = _library("qiskit.quantum_info", "install qiskit to convert its operators").SparsePauliOp
    if not isinstance(op, kind):
        raise TypeError("expected a SparsePauliOp")
    pairs = [unphased(s, complex(c)) for s, c in zip(op.paulis.to_labels(), op.coeffs, strict=True)]
    return [p for p, _ in pairs], [c for _, c in pairs], int(op.num_qubits)


def to_qiskit(labels: list[str], coeffs, num_qubits: int):
    info = _library("qiskit.quantum_info", "install qiskit to convert to its operators")
    if not labels:
        return info.SparsePauliOp(info.PauliList(["I" * num_qubits]), [0])[:0] if num_qubits else info.SparsePauliOp([""], [0])
    return info.SparsePauliOp(labels, coeffs)


def openfermion_terms(op, num_qubits: int | None = None) -> tuple[list[tuple[str, list[int], complex]], int]:
    """Sparse terms and width (the highest qubit + 1 unless given) of a QubitOperator."""
    kind = _library("openfermion", "install openfermion to convert its operators").QubitOperator
    if not isinstance(op, kind):
        raise TypeError("expected a QubitOperator")
    if num_qubits is not None:
        guards.qubits(num_qubits)
    least = max((q + 1 for term in op.terms for q, _ in term), default=0)
    if num_qubits is not None and num_qubits < least:
        raise ValueError("num_qubits is too small for the operator's qubits")
    return [("".join(p for _, p in t), [q for q, _ in t], complex(c)) for t, c in op.terms.items()], least if num_qubits is None else num_qubits


def to_openfermion(sparse: list[tuple[str, list[int], complex]]):
    kind = _library("openfermion", "install openfermion to convert to its operators").QubitOperator
    out = kind()
    for letters, qubits, c in sparse:
        out += kind(tuple((q, p) for p, q in zip(letters, qubits, strict=True)), c)
    return out
