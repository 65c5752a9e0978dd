"""Exact Jaccard join of shingle sets, by metric-space regions, Voronoi cells of pivots and triangle-inequality windows.

The Jaccard distance d is a metric, but unrelated documents all lie at distance 1 from every document pivot, so Voronoi
regions of document pivots alone would have to replicate every document into every region. Regions are therefore opened
by set pivots first: slices of the shingle universe. With |x| <= |y| <= u and similarity >= s, the sets differ in at most
t = floor(2u (1 - s) / (1 + s)) shingles, so of t + 1 + slack slices by shingle hash more than `slack` are equal, one of
them not empty. Each document stands in the regions of its slices, and is replicated over the border of its size class
by the window |x| >= s |y|. This keeps every link.

In a region the smallest document is the first pivot and meets every other one. Documents within the threshold e of the
pivot are linked to it, and so are in one component without meeting each other. A region of more than REGION documents
that isn't joined by that is cut again: up to PIVOTS of the documents outside the pivot's component become pivots, every
document goes to the cell of its nearest pivot, and into each other cell whose pivot is at most 2e farther (if x and y
link and y lies nearest to q, then d(x, q) <= d(y, q) + e <= d(y, p) + e <= d(x, p) + 2e). Cells are regions and are cut
in the same way, until they are small or a cut no longer halves the pairs that may meet: where all lies within 2e of all
pivots, cells would only repeat their region.

A final region is cut into rings by distance from its pivot; by the triangle inequality a link spans at most e, so each
ring takes over a window of that width from below, and joins by itself; the innermost ball needs no join of its own.
Documents that are known to be in the pivot's component needn't meet each other; the others meet all of their ring, block
by block where it is large, which is quadratic only in documents that are near to each other and yet not linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, chunks, hit, mix64, shingle_hashes, small_side, utf8
from .components import connected

#: Documents of a ring that meet in one block, and shingles that are compared at a time: bounds a group's memory.
BLOCK, COLUMNS = 512, 16_384
#: Documents of a region that isn't cut again, and pivots that cut a larger one.
REGION, PIVOTS = 1024, 16
#: Region keys that are reduced together before their shuffle.
PIECE = 1 << 20


def size_classes(top: int, ratio: float = 1.25) -> list[int]:
    """Lowest sizes of the classes up to the one that holds `top`, and the next."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def slice_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Region keys of a sorted set of distinct 64-bit hashes, for similarity num / den."""
    n = len(shingles)
    lows = size_classes(n * den // num + 1)
    out = []
    for c in range(len(lows) - 1):
        u = lows[c + 1] - 1
        if u < n or lows[c] * num > n * den:
            continue  # not its own class, and no y of that class can have it as the smaller partner
        t = 2 * u * (den - num) // (den + num)
        if t == 0:
            continue  # only equal sets link
        slack = max(2, (t + 1) // 8)
        k = t + 1 + slack
        place = (((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(place, np.arange(k + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(shingles))))
        full = edge[1:] > edge[:-1]
        keep = full if (~full).sum() <= slack else np.ones(k, bool)
        out.append(mix64((sums[edge[1:]] - sums[edge[:-1]]) + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * 1_000_003 + 1))[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(texts: list[bytes], k: int):
    """The sorted distinct shingle hashes of each text."""
    for a, b in chunks(texts):
        hashes, at = shingle_hashes(texts[a:b], k)
        for i in range(b - a):
            yield np.unique(hashes[at[i] : at[i + 1]])


def profiles(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, th, n_shingles, node (64 bits that stand for the set; null for an empty one), keys of each row of (doc_id, text, th)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, node, keys = [], [], []
                for s in _sets(utf8(part.column(1)), words):
                    n.append(len(s))
                    node.append(_mark(s))
                    keys.append(slice_keys(s, num, den).view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in keys]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), keys], ["doc_id", "th", "n_shingles", "node", "keys"])

    return docs.mapInArrow(run, "doc_id long, th long, n_shingles long, node long, keys array<long>")


def _mark(s: np.ndarray) -> int | None:
    """64 bits that stand for a set; None for an empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None


def reduced_entries(prof: DataFrame) -> DataFrame:
    """key, node of the keys of (node, keys): for each PIECE of keys, the smallest and the largest node of every key.

    So a hot key is reduced before the shuffle in fixed memory; a hash table of a task's keys, nearly all of them distinct,
    would spill to disk instead.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column(0).fill_null(0).to_numpy()  # sets without a node have no keys
            flat, ends = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()[1:] - batch.column(1).offsets[0].as_py()
            for low in range(0, len(flat), PIECE):
                key = flat[low : low + PIECE]
                of = node[np.searchsorted(ends, np.arange(low, low + len(key)), side="right")]
                order = np.argsort(key)
                key, of = key[order], of[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                key, least, most = key[first], np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)
                wide = least != most
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((key, key[wide]))), pa.array(np.concatenate((least, most[wide])))], ["key", "node"])

    return prof.select("node", "keys").mapInArrow(run, "key long, node long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node (what stands for the set), shingles array<long> of each row of (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(_sets(utf8(batch.slice(at, 256).column(1)), words))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_mark(s) for s in sets], pa.int64()), lists], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def shared_counts(sets: list[np.ndarray], n_left: int, split: int) -> np.ndarray:
    """Sizes of the intersections of the first n_left sets with those from `split` on; memory is bounded by COLUMNS shingles."""
    n = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n_left, len(sets) - split), np.int64)
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[row[at], column[at] - low] = 1
        shared += (grid[:n_left] @ grid[split:].T).astype(np.int64)
    return shared


def block_links(ids: np.ndarray, sets: list[np.ndarray], split: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what is linked in a block, a spanning forest: at most one for each document.

    split: of the first so many documents with the others; 0: of all documents among themselves.
    """
    if len(ids) < 2:
        return []
    n, n_left = np.array([len(s) for s in sets], np.int64), split or len(ids)
    shared = shared_counts(sets, n_left, split)
    linked = shared * den >= num * (n[:n_left, None] + n[None, split:] - shared)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(i), find(j + split)
        if a != b:
            root[b] = a
            out.append((int(ids[i]), int(ids[j + split])))
    return out


def _assigned(regions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """region, n, b, pivots, gaps (the distance to each), cells and linked (bits by pivot) of regions (region, b, front, n).

    Pivots: the first document outside the old pivot's component of each of PIVOTS groups by hash, those that lie farther than
    the window from each other. Members meet the pivots
    of their region in blocks of about BLOCK, so no task holds a region.
    """
    picks = regions.filter("front").groupBy("region", "n", F.pmod(F.xxhash64("b"), F.lit(PIVOTS)).alias("g")).agg(F.min("b").alias("node"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = regions.select("region", F.pmod(F.xxhash64(F.lit(1), "b"), blocks).cast("int").alias("block"), F.col("b").alias("node"), F.lit(1).alias("kind"), "n")
    pivots = picks.select("region", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "node", F.lit(0).alias("kind"), "n")
    margin = 2 * (1 - num / den) * 1.000001

    def assign(group):
        import pandas as pd

        group = group.sort_values(["kind", "node"])
        ids, k = group["node"].to_numpy(), int((group["kind"] == 0).sum())
        if not 0 < k < len(ids):
            return pd.DataFrame({"region": [], "n": [], "b": [], "pivots": [], "gaps": [], "cells": [], "linked": []})
        held = [np.asarray(s) for s in group["shingles"]]
        apart: list[int] = []  # the same in every block: one whose cell another would repeat is no pivot
        for i in range(k):
            if all(1 - len(both := np.intersect1d(held[i], held[j])) / (len(held[i]) + len(held[j]) - len(both)) > margin for j in apart):
                apart.append(i)
        ids, held = np.concatenate((ids[apart], ids[k:])), [held[i] for i in apart] + held[k:]
        first, k = k, len(apart)
        size = np.array([len(s) for s in held], np.int64)
        shared = shared_counts(held, k, k)
        either = size[:k, None] + size[None, k:] - shared
        gap = 1 - shared / either
        bit = 1 << np.arange(k)[:, None]
        near = ((gap <= gap.min(axis=0) + margin) & (ids[:k, None] != ids[None, k:])) * bit
        linked = ((shared * den >= num * either) & (ids[:k, None] != ids[None, k:])) * bit
        out = {"region": group["region"].iloc[first:], "n": group["n"].iloc[first:], "b": ids[k:], "pivots": [ids[:k]] * (len(ids) - k), "gaps": list(gap.T), "cells": near.sum(axis=0), "linked": linked.sum(axis=0)}
        return pd.DataFrame(out)

    kind = "region long, n long, b long, pivots array<long>, gaps array<double>, cells int, linked int"
    return members.unionByName(pivots).join(sets, "node").groupBy("region", "block").applyInPandas(assign, kind)


def _by_pivot(assigned: DataFrame, bits: str) -> DataFrame:
    """region, a (pivot), b, linked, gap for each of the pivots that `bits` names."""
    has = lambda of, i: F.getbit(F.col(of).cast("long"), i) == 1
    told = F.transform(F.col("pivots"), lambda p, i: F.struct(p.alias("a"), F.get("gaps", i).alias("gap"), has("linked", i).alias("linked"), has(bits, i).alias("told")))
    return assigned.select("region", "b", F.explode(F.filter(told, lambda x: x["told"])).alias("x")).select("region", "x.a", "b", "x.linked", "x.gap")


def _shrinks(assigned: DataFrame) -> DataFrame:
    """Regions whose cells have at most half of their pairs between them; others are better joined as they are."""
    cells = [F.sum(F.getbit(F.col("cells").cast("long"), F.lit(i)).cast("double")) for i in range(PIVOTS)]
    work = sum([c * c for c in cells[1:]], cells[0] * cells[0])
    return assigned.groupBy("region").agg(work.alias("work"), F.max("n").cast("double").alias("n")).filter("work <= 0.5 * n * n").select("region")


def _distances(scratch: Scratch, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with `linked` and `gap`, the distance."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return scratch.table(both.select("a", "b", (F.col("i") * den >= (F.col("t") - F.col("i")) * num).alias("linked"), (1 - F.col("i") / (F.col("t") - F.col("i"))).alias("gap")))


def _ring_links(rings: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside rings (pivot: the region, ring, node, front, inner): documents outside the pivot's component (front) with each
    other and with those inside it. Rings without inner documents (all from the window below) are covered by the one below.

    Both parts are dealt to blocks of about BLOCK documents by hash; a group is a pair of blocks, the first one of the front.
    """
    sized = rings.groupBy("pivot", "ring").agg(*[F.ceil(F.sum(F.col("front").cast("int") if f else (~F.col("front")).cast("int")) / BLOCK).cast("int").alias(n) for n, f in (("fronts", True), ("belows", False))], F.max("inner").alias("some"))
    dealt = rings.join(sized.filter("fronts > 0 and some").drop("some"), ["pivot", "ring"])
    spot = F.pmod(F.xxhash64("node"), F.when(F.col("front"), F.col("fronts")).otherwise(F.col("belows"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("front"), spot).otherwise(F.col("fronts") + spot))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    two = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    of_front = F.concat(F.transform(every(F.col("fronts")), lambda o: two(F.least(o, F.col("block")), F.greatest(o, F.col("block")))), F.transform(every(F.col("belows")), lambda o: two(F.col("block"), F.col("fronts") + o)))
    of_below = F.transform(every(F.col("fronts")), lambda o: two(o, F.col("block")))
    placed = dealt.select("pivot", "ring", "node", "block", F.explode(F.when(F.col("front"), of_front).otherwise(of_below)).alias("m"))
    placed = placed.select("pivot", "ring", F.col("m.p").alias("p"), F.col("m.q").alias("q"), "node", "block")

    def meet(group):
        import pandas as pd

        group = group.sort_values(["block", "node"])
        p, q = int(group["p"].iloc[0]), int(group["q"].iloc[0])
        sets_ = [np.asarray(s) for s in group["shingles"]]
        found = block_links(group["node"].to_numpy(), sets_, int((group["block"] == p).sum()) if p != q else 0, num, den)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return placed.join(sets, "node").groupBy("pivot", "ring", "p", "q").applyInPandas(meet, "a long, b long")


def jaccard_groups(docs: DataFrame, *, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, root (what stands for the component; null for an empty set) and least
    (its smallest id): a row for each row of docs. Cases as jaccard_components. region: documents of a region not cut again.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    prof = scratch.table(profiles(rows, words, num, den))
    # Regions: keys that different sets share. The smallest node is the pivot; regions of one pivot are one.
    entries = prof.select(F.explode("keys").alias("key"), "node")
    shared = scratch.table(reduced_entries(prof).repartition("key").groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top").select("key", "pivot"))
    some = entries.join(F.broadcast(bitmap(shared, "key")), hit(F.col("key"), F.col("bits"))).select("key", "node")  # sifts before the shuffle
    pairs = scratch.table(some.join(shared.hint("merge"), "key").filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    scratch.drop(shared)
    scratch.sweep()
    full, prof = prof, scratch.table(prof.select("doc_id", "th", "n_shingles", "node"))
    scratch.drop(full)  # the keys were its bulk
    # Written, as all sides of a join by a hot node are: AQE splits a join only if its exchanges stand alone.
    alike = scratch.table(prof.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id")))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.table(alike.join(wanted, "node"))  # one document for each set
    ids = small_side(scratch.table(wanted.select("id").distinct()))
    needed = rows.join(ids, F.expr("doc_id <=> id")).select("doc_id", "text")
    sets = scratch.table(shingle_sets(needed, words).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    scratch.sweep()
    met = _distances(scratch, pairs, sets, num, den)
    scratch.sweep()
    links = met.filter("linked").select("a", "b")
    one = scratch.table(connected(scratch, links))

    def labelled(df: DataFrame, node: str, to: str) -> DataFrame:
        return df.join(one.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col(node) == F.col("_n"), "left").withColumn(to, F.coalesce("_c", node)).drop("_n", "_c")

    def placed(met: DataFrame) -> DataFrame:
        return labelled(labelled(met, "a", "c1"), "b", "c2").withColumn("front", F.col("c1") != F.col("c2")).drop("c1", "c2")

    # Regions with documents outside the pivot's component; large ones are cut into cells as long as that halves the pairs.
    now = scratch.table(placed(met.select(F.col("a").alias("region"), "a", "b", "linked", "gap")))
    final, made = [], []
    while True:
        sized = now.groupBy("region").agg(F.count("*").alias("n"), F.max("front").alias("open")).filter("open and n > 1").select("region", "n")
        sized = scratch.table(now.join(scratch.table(sized), "region"))
        large = sized.filter(F.col("n") > region)
        final.append(sized.filter(F.col("n") <= region))
        if not large.limit(1).count():
            break
        assigned = scratch.table(_assigned(large.select("region", "b", "front", "n"), sets, num, den))
        cut = scratch.table(_shrinks(assigned))
        final.append(large.join(cut, "region", "left_anti"))
        links = links.union(scratch.table(_by_pivot(assigned.filter("linked <> 0"), "linked").select("a", "b")))
        cells = scratch.table(_by_pivot(assigned.join(cut, "region"), "cells").withColumn("region", F.xxhash64("region", "a")))
        made += [assigned, cells]
        one = scratch.table(connected(scratch, links))
        now = scratch.table(placed(cells))
    width = (1 - num / den) * 1.000001
    whole = final[0]
    for part in final[1:]:
        whole = whole.unionByName(part)
    whole = whole.select("region", "a", "b", "linked", "gap")
    own = F.when(F.col("linked"), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("gap") / width).cast("int")))
    ringed = placed(whole).select(F.col("region").alias("pivot"), F.col("b").alias("node"), "front", own.alias("own"))  # labels of the last round
    ringed = ringed.select("pivot", "node", "own", "front", F.explode(F.array("own", F.col("own") + 1)).alias("ring")).filter("ring > 0")
    rings = scratch.table(ringed.select("pivot", "ring", "node", "front", (F.col("own") == F.col("ring")).alias("inner")))
    more = scratch.table(_ring_links(rings, sets, num, den).distinct())
    two = connected(scratch, labelled(labelled(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    late = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(one, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = one.unionByName(late).join(two.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left")
    labels = labels.select("node", F.coalesce("_c", "component").alias("component"))
    rooted = scratch.table(alike.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "id"))
    for t in (sets, met, rings, pairs, wanted, more, *made):
        scratch.drop(t)
    lowest = scratch.table(rooted.groupBy("root").agg(F.min("id").alias("least")))
    by_node = scratch.table(rooted.join(lowest, "root").select("node", "root", "least"))
    return prof.join(by_node, "node", "left").select("doc_id", "th", "n_shingles", "root", "least")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs; options as jaccard_groups.

    Sets are distinct `words`-word shingles (A-Z lower-cased; fewer words: the whole sequence as one); two documents link
    when den * |x & y| >= num * |x | y|, exactly up to collisions of 64-bit hashes. component_id: the smallest id reachable
    by links, itself included. Null or empty texts and texts without words have no shingles and link with nothing. Equal
    sets are one node: copies meet no one. Rows of one id with different texts are documents of their own that share
    the id; rows with a null id link too, and have a null component only if no id is reachable. Extra columns aren't read.
    """
    found = jaccard_groups(docs, **options)
    return found.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Component and number of shingles of every document of `documents`, at 90 of 100 and three words; cases as jaccard_components."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract said in SQL: an inverted index of shingles, exact ratios, and the closure of the links.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(doc_id, other) AS (
    SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
