"""Greedy first-fit grouping into commuting sets.

The fold is serial by definition: every term goes, in order, to the first group that takes it. Equal masks follow each
other and always share a group, so only distinct masks are folded, and the ids are joined back; one task holds the
distinct masks, not the terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

MODES, STRATEGIES = ("qwc", "full"), ("largest_first",)
MAX_GRAPH_ENTRIES = 10_000_000


def first_fit(x: np.ndarray, z: np.ndarray, full: bool, graph: bool) -> np.ndarray:
    """Group numbers of terms (rows of mask words) in order; a term is tried on all groups at once.

    graph: conflicts are computed once for all pairs. Work is the number of terms times that of groups (qwc) or terms (full).
    """
    out, used = np.zeros(len(x), np.int64), 0
    if full:
        odd = lambda i, upto: (np.bitwise_count((x[i] & z[:upto]) ^ (z[i] & x[:upto])).sum(axis=-1) & 1).astype(bool)
        conflicts = [odd(i, len(x)) for i in range(len(x))] if graph else None
        for i in range(len(x)):
            closed = np.zeros(used + 1, bool)  # groups with a member that conflicts; the one past the last never has
            closed[out[:i][conflicts[i][:i] if graph else odd(i, i)]] = True
            out[i] = int(closed.argmin())
            used = max(used, out[i] + 1)
        return out
    xs, zs = np.zeros((16, x.shape[1]), x.dtype), np.zeros((16, x.shape[1]), x.dtype)  # joined masks of the groups
    for i in range(len(x)):
        if used == len(xs):
            xs, zs = (np.concatenate((a, np.zeros_like(a))) for a in (xs, zs))
        g = out[i] = int(((x[i] & zs[: used + 1]) ^ (z[i] & xs[: used + 1])).any(axis=1).argmin())  # an unused group takes all
        used = max(used, g + 1)
        xs[g] |= x[i]
        zs[g] |= z[i]
    return out


def grouped(df: DataFrame, num_qubits: int, mode: str = "qwc", strategy: str = "largest_first", max_terms_for_graph: int = 50_000) -> DataFrame:
    """The terms with group_id and pos_in_group: by weight descending, canonical key, term_id."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    keys = bits.mask_columns(num_qubits)
    if not keys:
        numbered = df.withColumn("group_id", F.lit(0))
    else:
        distinct = df.select(*keys).distinct().withColumn("_one", F.lit(1))
        schema = ", ".join(f"{k} long" for k in keys) + ", group_id int"

        def fold(rows):
            x, z = (rows[[k for k in keys if k[0] == m]].to_numpy(np.int64).view(np.uint64) for m in "xz")
            size = np.bitwise_count(x | z).sum(axis=1).astype(np.int64)
            words = [w for i in range(x.shape[1]) for w in (x[:, i], z[:, i])]
            order = np.lexsort([*words[::-1], -size])
            out = rows[keys].iloc[order].copy()
            graph = len(rows) <= max_terms_for_graph and len(rows) ** 2 <= MAX_GRAPH_ENTRIES
            out["group_id"] = first_fit(x[order], z[order], mode == "full", graph).astype("int32")
            return out

        numbered = df.join(distinct.groupBy("_one").applyInPandas(fold, schema), keys)
    order = Window.partitionBy("group_id").orderBy(bits.weight(num_qubits).desc(), *bits.canonical_order(num_qubits), "term_id")
    return numbered.withColumn("pos_in_group", (F.row_number().over(order) - 1).cast("int"))
