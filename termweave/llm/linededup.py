"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line's shingles are the character strings of N code points at every position of the lower-cased, trimmed line (a shorter
line is one shingle). Exact copies are one class, known by two 64-bit hashes. The k-th minimum of a class is the first of
its shingle hashes after a k-th constant, round the circle of 64 bits: two sets share it with the probability of their
Jaccard similarity. One sorted array gives all minima, so a line costs one sort whatever the number of bands. The few
hashes of a SHORT line would tie the bands to each other; so the bands of short lines are spread over FAMILIES hash
functions, and lines about the border stand in the bands of both kinds.

Classes that share a band meet the band's pivot, another one in each band. Then all classes outside the largest component of
their band meet every member in another component, block by block, which is quadratic in classes that are not joined yet;
in crowded bands such classes meet some of the largest component first, for most are joined by that, and bitmaps of the
shingles, which never refuse a link, sift the pairs in place. Pairs of long lines whose sketches of the signature agree
well enough, pairs of short lines whose small bitmaps don't refuse them, and all pairs of a short and a long line are verified by exact Jaccard similarity. Verified links are joined by distributed union-find; the first line of each component, by
document and place, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, hit, small_side
from .components import connected

SIMILARITY = 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^18 = 0.999.
BANDS, ROWS = 18, 5
#: Code points of a shingle.
N = 5
#: Lines of at most so many shingles have their bands spread over so many hash functions.
SHORT, FAMILIES = 120, 3
GROUP = BANDS // FAMILIES
#: Of 64 minima, by four bits each in numbers of 16, so many must agree before a pair of long lines is verified (a pair at
#: the threshold fails this with probability 0.00003).
SKETCH, AGREE = [f"s{i}" for i in range(4)], 40
#: Bits in the sketch of a short line, a bitmap of its shingles in as many numbers.
BITS = 64 * len(SKETCH)
#: Of the largest component of a crowded band, so many classes at most meet those outside it first.
FIRST = 32
#: A band is crowded that has more classes than CROWD and more pairs of different components than OPEN: bitmaps sift its pairs.
CROWD, OPEN = 256, 256
#: Classes outside a band's largest component that meet their band in one block.
BLOCK = 512
#: Numbers of 64 bits in the bitmaps of shingles that sift the pairs of crowded bands.
WORDS = 128


def _constant(i: int) -> int:
    x = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


CONSTANTS = [_constant(i) for i in range(BANDS * ROWS)]
_BEFORE = {c: i for i, c in enumerate(sorted(CONSTANTS))}


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, th, pos, k1, k2, norm of every line with a character that isn't a blank; docs: (doc, th, text)."""
    lines = docs.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc", "th", "pos", F.trim(F.lower("line")).alias("norm")).filter("norm <> ''")
    return lines.withColumn("k1", F.xxhash64("norm")).withColumn("k2", F.xxhash64(F.lit(7), "norm"))


def shingles(norm, family=None) -> F.Column:
    """The hashes of a line's shingles, repeats included. In UTF-32 a place is found without counting from the line's start."""
    of = lambda x: F.xxhash64(x) if family is None else F.xxhash64(x, family)
    last = lambda wide: F.greatest(F.length(wide) - F.lit(4 * N), F.lit(0)) + F.lit(1)
    # The sequence holds the places in bytes, so that no arithmetic is left for each of them.
    at = lambda wide: F.transform(F.sequence(F.lit(1), last(wide), F.lit(4)), lambda i: of(F.substring(wide, i, F.lit(4 * N))))
    return F.element_at(F.transform(F.array(F.encode(norm, "UTF-32")), at), 1)


def signatures(lines: DataFrame, similarity: float) -> DataFrame:
    """k1, family, g0, g1, ... (keys of the bands, by group), SKETCH, d (distinct shingles of a short line, else null): a row for each class
    of lines, and for a short one a row for each further hash function. SKETCH and d count in rows of family 0.

    Group f holds the bands of the f-th hash function of short lines, and the same bands of long lines.
    """
    one = lines.groupBy("k1", "k2").agg(F.min("norm").alias("norm")).select("k1", "norm", (F.length("norm") - F.lit(N - 1)).alias("n"))
    families = F.when(F.col("n") <= SHORT, F.array(*[F.lit(f) for f in range(FAMILIES)])).otherwise(F.array(F.lit(0)))
    made = one.select("k1", "n", "norm", F.explode(families).alias("family"))
    made = made.select("k1", "n", "family", F.sort_array(shingles(F.col("norm"), F.col("family"))).alias("h"))
    made = made.select("k1", "n", "family", F.concat("h", F.slice("h", 1, 1)).alias("ring"), F.sort_array(F.concat("h", F.array(*[F.lit(c) for c in CONSTANTS]))).alias("merged"))
    made = made.select("k1", "n", "family", "ring", "merged", F.reverse("merged").alias("back"), F.size("merged").alias("size"))

    def after(c: int) -> F.Column:
        """A constant's place among the hashes is its place in all, looked for from the nearer end, less the constants before it."""
        before = F.array_position("merged", F.lit(c)).cast("int") - 1 if c < 0 else F.col("size") - F.array_position("back", F.lit(c)).cast("int")
        return F.get(F.col("ring"), before - F.lit(_BEFORE[c]))

    all_bands = (F.col("family") == 0) & (F.col("n") >= int(similarity * SHORT))
    bands = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: all_bands | (F.floor(b / GROUP) == F.col("family")))
    # `bands` keeps this projection out of whole-stage code, whose one method the JVM would find too large to compile.
    short = (F.col("n") <= SHORT) & (F.col("family") == 0)
    maps = [F.when(short, _bits(i)).alias(f"b{i}") for i in range(len(SKETCH))]
    made = made.select("k1", "n", "family", bands.alias("bands"), F.array(*[after(c) for c in CONSTANTS]).alias("m"), F.when(short, F.size(F.array_distinct("ring"))).alias("d"), *maps)
    key = lambda b: F.xxhash64(b, "family", F.slice("m", b * ROWS + 1, ROWS))
    group = lambda f: F.transform(F.filter("bands", lambda b: F.floor(b / GROUP) == f), key).alias(f"g{f}")
    return made.select("k1", "family", *map(group, range(FAMILIES)), "d", *[F.when(F.col("n") > SHORT, _sketch(16 * i)).otherwise(F.col(f"b{i}")).alias(s) for i, s in enumerate(SKETCH)])


def _bits(i: int) -> F.Column:
    """The i-th number of the bitmap of the hashes in `ring`."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    own = lambda h: F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 6) == i
    return F.aggregate("ring", F.lit(0).cast("long"), lambda a, h: F.when(own(h), a.bitwiseOR(bit(h))).otherwise(a))


def _sketch(start: int) -> F.Column:
    """The low four bits of 16 minima in one number."""
    out = F.lit(0).cast("long")
    for i in range(16):
        out = out.bitwiseOR(F.shiftleft(F.get("m", F.lit(start + i)).bitwiseAND(F.lit(15)), 4 * i))
    return out


def _agreeing(a: F.Column, b: F.Column) -> F.Column:
    """How many of the 16 groups of four bits are equal."""
    x = a.bitwiseXOR(b)
    for by in (2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _other(sketches: DataFrame) -> DataFrame:
    """Sketches of the other side of a pair."""
    return sketches.select(F.col("k1").alias("a"), *[F.col(s).alias(f"o_{s}") for s in ("d", *SKETCH)])


def _alike(similarity: float) -> F.Column:
    """Whether the sketches of two long lines agree well enough, or the bitmaps of two short ones admit a link (they never
    refuse one); a short and a long line may always be alike."""
    num = round(similarity * 10_000)
    total = lambda parts: sum(parts[1:], parts[0])
    agree = total([_agreeing(F.col(s), F.col(f"o_{s}")) for s in SKETCH]) >= AGREE
    common, own, other = (total([F.bit_count(x) for x in xs]) for xs in ([F.col(s).bitwiseAND(F.col(f"o_{s}")) for s in SKETCH], [F.col(s) for s in SKETCH], [F.col(f"o_{s}") for s in SKETCH]))
    admitted = (common + F.least(F.col("d") - own, F.col("o_d") - other)) * F.lit(10_000 + num) >= (F.col("d") + F.col("o_d")) * F.lit(num)
    short, o_short = F.col("d").isNotNull(), F.col("o_d").isNotNull()
    return F.when(short & o_short, admitted).when(short | o_short, F.lit(True)).otherwise(agree)


def _members(scratch: Scratch, sigs: DataFrame) -> DataFrame:
    """key, a (the key's pivot), n (its classes), k1 for all other classes of keys with more than one."""
    out = None
    for f in range(FAMILIES):
        keyed = sigs.select(F.explode(f"g{f}").alias("key"), "k1")
        x = F.col("k1").bitwiseXOR(F.col("key"))  # another pivot in each band
        shared = keyed.groupBy("key").agg(F.min(x).alias("a"), F.max(x).alias("z"), F.count("*").alias("n")).filter("a < z")
        shared = scratch.table(shared.select("key", F.col("a").bitwiseXOR(F.col("key")).alias("a"), "n"))
        some = keyed.join(F.broadcast(bitmap(shared, "key")), hit(F.col("key"), F.col("bits"))).select("key", "k1")
        met = scratch.table(some.join(shared.hint("merge"), "key").filter("k1 <> a"))
        scratch.drop(shared)
        scratch.sweep()
        out = met if out is None else out.union(met)
    return out


def _labelled(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with c, the component of k1 so far."""
    return df.join(found.select(F.col("node").alias("k1"), F.col("component").alias("_c")), "k1", "left").withColumn("c", F.coalesce("_c", "k1")).drop("_c")


def _bands(scratch: Scratch, members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, k1, c), and (key, top: the largest component, open: pairs of different components, crowded) of bands with any such pair."""
    placed = scratch.table(_labelled(members, found))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("top"), F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("open"))
    bands = bands.withColumn("crowded", (F.col("n") > CROWD) & (F.col("open") > OPEN)).drop("n")
    return placed, scratch.table(bands.filter("open > 0"))


def _complete(scratch: Scratch, members: DataFrame, links: DataFrame, tried: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Further links (a, b), so that all members (key, k1) of a band have met or are joined by links.

    In each band the classes outside the largest component meet all those of other components.
    """
    found = scratch.table(connected(scratch, links))
    placed, bands = _bands(scratch, members, found)
    further = None
    if bands.filter("crowded").limit(1).count():
        pairs = _first(scratch, placed.join(bands.filter("crowded").select("key", "top"), "key"), tried, sketches, similarity)
        further = _verified(scratch, pairs, texts, similarity)
        for t in (placed, bands, found):
            scratch.drop(t)
        scratch.sweep()
        found, tried = scratch.table(connected(scratch, links.union(further))), tried.union(pairs)
        placed, bands = _bands(scratch, members, found)
    few, many = ((placed.join(bands.filter(cond).select("key", "top"), "key").join(sketches, "k1").withColumn("front", F.col("c") != F.col("top"))) for cond in ("not crowded", "crowded"))
    few, many = scratch.table(few), scratch.table(many)
    held = scratch.table(_bitmaps(texts.join(many.select("k1").distinct(), "k1")))
    for t in (placed, found):
        scratch.drop(t)
    scratch.sweep()
    met = _met(scratch, few, _alike(similarity)).union(_met(scratch, many.join(held, "k1"), _alike(similarity) & _may_link(similarity)))
    pairs = scratch.table(met.select(F.least("a", "k1").alias("a"), F.greatest("a", "k1").alias("k1")).distinct().join(tried, ["a", "k1"], "left_anti"))
    for t in (few, many, held):
        scratch.drop(t)
    scratch.sweep()
    last = _verified(scratch, pairs, texts, similarity)
    return last if further is None else last.union(further)


def _first(scratch: Scratch, crowded: DataFrame, tried: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, k1) not tried: classes outside the largest component of a crowded band (k1, c, top) with FIRST of that component.

    The same few of a component in all its bands: a class of many links is joined by one of them and needn't meet all.
    """
    slot = F.pmod(F.xxhash64("k1"), F.lit(FIRST)).alias("slot")
    some = small_side(scratch.table(crowded.filter("c = top").groupBy("top", slot).agg(F.min("k1").alias("p")).drop("slot")))
    pairs = crowded.filter("c <> top").select("k1", "top").distinct().join(some, "top")
    pairs = pairs.select(F.least("k1", "p").alias("a"), F.greatest("k1", "p").alias("k1")).distinct()
    pairs = pairs.join(tried, ["a", "k1"], "left_anti").join(sketches, "k1").join(_other(sketches), "a")
    return scratch.table(pairs.filter(_alike(similarity)).select("a", "k1"))


def _met(scratch: Scratch, bands: DataFrame, alike: F.Column) -> DataFrame:
    """Pairs (a, k1) of different components of bands (key, k1, c, front, ...): those in front with all, in blocks, if alike.

    What tells likeness stands in columns of bands; the other side has them with `o_` before the name.
    """
    blocks = scratch.table(bands.filter("front").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = bands.join(blocks, "key")
    told = [c for c in bands.columns if c not in ("key", "k1", "c", "front", "top")]
    front = dealt.filter("front").select("key", F.pmod(F.xxhash64("k1"), "blocks").cast("int").alias("p"), F.col("k1").alias("a"), F.col("c").alias("ca"), *[F.col(c).alias(f"o_{c}") for c in told])
    every = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "k1", "c", "front", *told)
    return front.join(every, (front["key"] == every["key"]) & (front["p"] == every["p"]) & F.expr("c <> ca and (a < k1 or not front)") & alike).select("a", "k1")


def _bitmaps(texts: DataFrame) -> DataFrame:
    """k1, n (distinct shingles), used (bits that they set) and words, the bits themselves, 64 in each of WORDS numbers."""
    bits = texts.select("k1", F.explode(F.array_distinct(shingles(F.col("norm")))).alias("h")).select("k1", F.pmod("h", F.lit(64 * WORDS)).alias("b"))
    bits = bits.select("k1", F.shiftright("b", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int")).alias("bits"), F.lit(1).alias("n"))
    none = texts.select("k1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long"))).alias("w"), F.lit(0).cast("long").alias("bits"), F.lit(0).alias("n"))
    words = bits.union(none).groupBy("k1", "w").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return words.groupBy("k1").agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits")).alias("used"), F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"))


def _may_link(similarity: float) -> F.Column:
    """Whether as many shingles may be shared as a link needs: common bits, and shingles that share a bit with others. Never refuses a link."""
    num = round(similarity * 10_000)
    common = F.aggregate(F.zip_with("words", "o_words", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, x: a + x)
    most = common + F.least(F.col("n") - F.col("used"), F.col("o_n") - F.col("o_used"))
    return most * F.lit(10_000 + num) >= (F.col("n") + F.col("o_n")) * F.lit(num)


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b): the pairs (a, k1) whose exact Jaccard similarity is high enough. Texts are moved: their sets are five times as large."""
    num = round(similarity * 10_000)
    both = pairs.join(texts.select(F.col("k1").alias("a"), F.col("norm").alias("na")), "a").join(texts, "k1")
    sets = both.select("a", "k1", F.array_distinct(shingles(F.col("na"))).alias("ha"), F.array_distinct(shingles(F.col("norm"))).alias("hs"))
    near = F.size(F.array_intersect("ha", "hs")) * F.lit(10_000 + num) >= (F.size("ha") + F.size("hs")) * F.lit(num)
    return scratch.table(sets.filter(near).select("a", F.col("k1").alias("b")))


def line_components(scratch: Scratch, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(k1, component) for the line classes that have a near-duplicate of another class, and all lines' places (doc, th, pos, k1, k2)."""
    sigs = scratch.table(signatures(lines_of(docs), similarity))
    scratch.sweep()
    sketches = scratch.table(sigs.filter("family = 0").select("k1", "d", *SKETCH))
    members = _members(scratch, sigs)
    scratch.drop(sigs)
    stars = members.select(F.least("a", "k1").alias("a"), F.greatest("a", "k1").alias("k1")).distinct().join(sketches, "k1").join(_other(sketches), "a")
    stars = scratch.table(stars.filter(_alike(similarity)).select("a", "k1"))
    several = members.filter("n > 2")  # in a band of two, all have met
    crowded = scratch.table(several.select("key", "k1").union(several.select("key", F.col("a").alias("k1")).distinct()))
    wanted = stars.select("k1").union(stars.select("a")).union(crowded.select("k1")).distinct()
    # One more pass over the texts: every line's place and, by a filter of fixed size, the texts of the wanted classes.
    norm = F.when(hit(F.col("k1"), F.col("bits")), F.col("norm"))
    places = scratch.table(lines_of(docs).crossJoin(F.broadcast(bitmap(wanted, "k1"))).select("doc", "th", "pos", "k1", "k2", norm.alias("norm")))
    texts = scratch.table(places.filter("norm is not null").groupBy("k1").agg(F.min("norm").alias("norm")))
    scratch.sweep()
    links = _verified(scratch, stars, texts, similarity)
    more = _complete(scratch, crowded, links, stars, sketches, texts, similarity)
    for t in (texts, sketches):
        scratch.drop(t)
    return connected(scratch, links.union(more)).select(F.col("node").alias("k1"), "component"), places.drop("norm")


def dropped_lines(scratch: Scratch, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc, th, drop array<int> (the places of the lines that go), n_lines, for documents with lines."""
    found, places = line_components(scratch, docs, similarity)
    # Exact copies need their own count: classes without a near-duplicate are told apart by both hashes.
    placed = places.join(scratch.table(found), "k1", "left").select("doc", "th", "pos", F.coalesce("component", "k1").alias("c"), F.when(F.col("component").isNull(), F.col("k2")).otherwise(0).alias("c2"))
    placed = scratch.table(placed)
    at = F.struct(F.col("doc").isNull().alias("n"), "doc", "th", "pos")
    # Written first, so that the join's exchanges stand alone and AQE can split a very common line.
    first = scratch.table(placed.groupBy("c", "c2").agg(F.min(at).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    told = placed.join(first, ["c", "c2"], "left").select("doc", "th", "pos", F.coalesce(at != F.col("keep"), F.lit(False)).alias("gone"))
    return told.groupBy("doc", "th").agg(F.collect_set(F.when(F.col("gone"), F.col("pos"))).alias("drop"), F.size(F.collect_set("pos")).alias("n_lines"))


def dedup_lines(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text` without the lines that go, and n_lines, n_dropped (of lines that aren't blank).

    One line of each component of near-duplicate lines stays over the whole table: the first by id (null last), text hash
    and place. Blank lines stay. Null and empty texts stay as they are. A text that loses all its lines becomes what is
    left of blank lines, or "". Rows of equal id and text are one document: their lines stay or go together. All other
    columns of docs are kept, whatever their names; n_lines and n_dropped of docs are replaced. An empty table gives an
    empty result. Classes and documents are told apart by 64-bit hashes: among 1e9 lines two differ by a chance of 0.03.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    row = lambda c: F.col("row").getField(c)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", row(id_col).cast("long").alias("doc"), F.xxhash64(row(text_col)).alias("th"))
    base = keyed.select("doc", "th", F.coalesce(row(text_col), F.lit("")).alias("text"))
    told = scratch.table(dropped_lines(scratch, base, similarity).select(F.col("doc").alias("of"), F.col("th").alias("of_th"), "drop", "n_lines"))
    joined = keyed.join(told.hint("shuffle_hash"), F.expr("doc <=> of and th = of_th"), "left")
    kept = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drop"), lambda i: F.get(parts, i)), "\n")
    text = F.element_at(F.transform(F.array(F.split(row(text_col), "\n")), kept), 1)  # bound once for all its lines
    text = F.when(F.coalesce(F.size("drop") > 0, F.lit(False)) & row(text_col).isNotNull(), text).otherwise(row(text_col))
    own = [text.alias(c) if c == text_col else row(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*own, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text after fuzzy line deduplication over the whole table, and how many lines it had and lost.

    Null and empty texts come back as they are with 0 lines.
    """
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: What the bands are to find, said in SQL: exact components of lines. Two lines that link share one of their rarest
#: shingles: of n, the first n - ceil(0.8 n) + 1.
ORACLE_SQL = """
WITH RECURSIVE parts AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents
), places AS (
    SELECT doc_id, i - 1 AS pos, trim(lower(ps[i]), ' ') AS norm FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts WHERE text IS NOT NULL)
), lines AS (
    SELECT * FROM places WHERE norm <> ''
), classes AS (
    SELECT norm, row_number() OVER (ORDER BY norm) AS id FROM (SELECT DISTINCT norm FROM lines)
), shingles AS (
    SELECT DISTINCT id, substr(norm, i, 5) AS s FROM (SELECT id, norm, unnest(range(1, greatest(length(norm) - 4, 1) + 1)) AS i FROM classes)
), frequent AS (
    SELECT s, count(*) AS df FROM shingles GROUP BY s
), ranked AS (
    SELECT id, s, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY df, s) AS rn FROM shingles JOIN frequent USING (s)
), rare AS (
    SELECT id, s, n FROM ranked WHERE rn <= n - ceil(0.8 * n) + 1
), maybe AS (
    SELECT DISTINCT a.id AS a, b.id AS b, a.n + b.n AS n FROM rare a JOIN rare b ON a.s = b.s AND a.id < b.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), links AS (
    SELECT m.a, m.b FROM maybe m JOIN shingles x ON x.id = m.a JOIN shingles y ON y.id = m.b AND y.s = x.s GROUP BY m.a, m.b, m.n HAVING 18 * count(*) >= 8 * m.n
), both_ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(id, other) AS (
    SELECT a, b FROM both_ways UNION SELECT r.id, e.b FROM reached r JOIN both_ways e ON e.a = r.other
), component AS (
    SELECT c.norm, least(c.id, coalesce(min(r.other), c.id)) AS comp FROM classes c LEFT JOIN reached r ON r.id = c.id GROUP BY c.norm, c.id
), told AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY comp ORDER BY doc_id, pos) > 1 AS gone FROM lines JOIN component USING (norm)
), dropped AS (
    SELECT doc_id, count(*) AS n_lines, list(pos) FILTER (gone) AS gone FROM told GROUP BY doc_id
)
SELECT p.doc_id, CASE WHEN len(d.gone) > 0 THEN array_to_string(list_filter(ps, lambda line, i: NOT list_contains(d.gone, i - 1)), chr(10)) ELSE p.text END AS text,
    coalesce(d.n_lines, 0)::int AS n_lines, coalesce(len(d.gone), 0)::int AS n_dropped
FROM parts p LEFT JOIN dropped d ON d.doc_id = p.doc_id
"""
