"""Queries over the driver's tables, one for each operator, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import lineitem_op, part_labels, part_op, supplier_op, table
from .frame import OperatorFrame
from .functions import bits, codec
from .operators import algebra, expect
from .operators.commute import CommutationRelation

# ---- Spark ---------------------------------------------------------------------------------------------------------


def c01_zero_terms(spark, sf_dir) -> DataFrame:
    """As many zero terms as there are suppliers."""
    n = table(spark, sf_dir, "supplier").count()
    return OperatorFrame.zeros(spark, 8, n).df


def c03_parse_labels(spark, sf_dir) -> DataFrame:
    op = OperatorFrame.from_df(part_labels(spark, sf_dir), 96, label="label", re=F.col("p_size"), term_id=F.col("p_partkey"))
    return op.df


def c05_sparse_terms(spark, sf_dir) -> DataFrame:
    """Labels taken apart to sparse terms, then parsed from those."""
    from .sources.tables import sparse_parsed

    letters, qubits = codec.sparse_of_label(F.col("label"))
    terms = part_labels(spark, sf_dir).select(F.col("p_partkey").alias("term_id"), letters.alias("local"), qubits.alias("qubits"), F.col("p_size").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return sparse_parsed(terms, 96)


def c06_phased_labels(spark, sf_dir) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("", "+", "i", "+i", "-", "-i")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    k, bare = codec.phase_and_label(F.col("phased"))
    rows = part_labels(spark, sf_dir, 32).select("p_partkey", F.concat(prefix, "label").alias("phased"), F.col("p_size").cast("double").alias("re"))
    re, im = bits.turned(F.col("re"), F.lit(0.0), k)
    return rows.select("p_partkey", bare.alias("label"), re.alias("re"), im.alias("im"))


def p01_render_labels(spark, sf_dir) -> DataFrame:
    op = OperatorFrame(c03_parse_labels(spark, sf_dir), 96)
    return op.labels_df().select("term_id", "label")


def p02_sparse_terms(spark, sf_dir) -> DataFrame:
    op = OperatorFrame(c03_parse_labels(spark, sf_dir), 96)
    return op.sparse_df().select("term_id", "local", F.concat_ws(",", F.transform("qubits", lambda q: q.cast("string"))).alias("qubits"))


def p05_scale(spark, sf_dir) -> DataFrame:
    return (supplier_op(spark, sf_dir) * (2 - 3j)).df


def p06_weight(spark, sf_dir) -> DataFrame:
    op = part_op(spark, sf_dir)
    return op.df.select("term_id", bits.weight(8).alias("weight"), bits.y_count(8).alias("y_count"), bits.is_diagonal(8).alias("diagonal"))


def u01_add(spark, sf_dir) -> DataFrame:
    return (part_op(spark, sf_dir) + supplier_op(spark, sf_dir)).df


def s01_simplify_lineitem(spark, sf_dir) -> DataFrame:
    return algebra.simplified(lineitem_op(spark, sf_dir).df, 6)


def s01_simplify_rtol(spark, sf_dir) -> DataFrame:
    return algebra.simplified(lineitem_op(spark, sf_dir).df, 6, atol=0.25, rtol=7.0)


def s04_simplify_ordered(spark, sf_dir) -> DataFrame:
    """Summed in construction order, in canonical order."""
    return part_op(spark, sf_dir).simplify(deterministic=True).df


def s10_simplify_exact(spark, sf_dir) -> DataFrame:
    """Summed as decimals: the same in any order."""
    return algebra.simplified(lineitem_op(spark, sf_dir).df, 6, exact=True)


def s11_simplify_widthless(spark, sf_dir) -> DataFrame:
    """Terms without qubits are one term."""
    return algebra.simplified(supplier_op(spark, sf_dir).df.select("term_id", "re", "im"), 0)


def c02_empty_sum(spark, sf_dir) -> DataFrame:
    """No terms, and the suppliers' added to them."""
    return (OperatorFrame.empty(spark, 8) + supplier_op(spark, sf_dir)).df


def g07_both_degrees(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).both_degrees()


def e05_expectation_without_terms(spark, sf_dir) -> DataFrame:
    """A sum without terms has no expectation in any state; the states keep theirs, 0."""
    none = supplier_op(spark, sf_dir, 6).df.limit(0)
    got = expect.statevector_expectation(none, _states(spark, sf_dir), ["vec_id"])
    return _states(spark, sf_dir).select("vec_id").distinct().join(got, "vec_id", "left").select("vec_id", F.coalesce("re", F.lit(0.0)).alias("re"))


#: The products are lazy tables: what bounds their rows is the type of their ids, not the library's default.
MOST = (1 << 63) - 1


def j01_matmul_raw(spark, sf_dir) -> DataFrame:
    return part_op(spark, sf_dir).matmul(supplier_op(spark, sf_dir), simplify=False, max_intermediate_terms=MOST).df


def j01_matmul_simplify(spark, sf_dir) -> DataFrame:
    return part_op(spark, sf_dir).matmul(supplier_op(spark, sf_dir), max_intermediate_terms=MOST).df.drop("term_id")


def _relation(spark, sf_dir, **k) -> CommutationRelation:
    return part_op(spark, sf_dir).relation(supplier_op(spark, sf_dir), **k)


def _self_relation(spark, sf_dir) -> CommutationRelation:
    op = part_op(spark, sf_dir)
    return op.relation(op)


def j06_commutes_pairs(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).pairs()


def j11_qwc_pairs(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir, qubitwise=True).pairs()


def j12_self_conflicts(spark, sf_dir) -> DataFrame:
    op = supplier_op(spark, sf_dir)
    return op.relation(op).edges()


def g01_count_total(spark, sf_dir) -> DataFrame:
    """Commuting pairs of all line terms with each other: dictionaries of masks, not lines, meet."""
    op = lineitem_op(spark, sf_dir)
    return op.relation(op).total()


def g02_count_rows(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).counts(1)


def g03_count_cols(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).counts(0)


def g04_conflict_degrees(spark, sf_dir) -> DataFrame:
    return _self_relation(spark, sf_dir).counts(1, commuting=False)


def g06_edges(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).edges()


def g06_row_offsets(spark, sf_dir) -> DataFrame:
    return _relation(spark, sf_dir).row_offsets()


def g08_topk_conflicts(spark, sf_dir) -> DataFrame:
    return _self_relation(spark, sf_dir).top_conflicts(10)


def k02_group_qwc(spark, sf_dir) -> DataFrame:
    return supplier_op(spark, sf_dir).group_df("qwc").select("term_id", "group_id", "pos_in_group")


def k03_group_full(spark, sf_dir) -> DataFrame:
    return supplier_op(spark, sf_dir).group_df("full").select("term_id", "group_id", "pos_in_group")


def _states(spark, sf_dir) -> DataFrame:
    """Embeddings as real 6-qubit states, in 1024ths."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("basis", "a")).select("vec_id", F.col("basis").cast("long").alias("basis"), F.round(F.col("a").cast("double") * 1024).alias("re"), F.lit(0.0).alias("im"))


def e01_expectation_embeddings(spark, sf_dir) -> DataFrame:
    return expect.statevector_expectation(supplier_op(spark, sf_dir, 6).df, _states(spark, sf_dir), ["vec_id"])


def e03_expectation_diagonal(spark, sf_dir) -> DataFrame:
    terms = supplier_op(spark, sf_dir, 6).df.withColumn("x0", F.lit(0).cast("long"))
    return expect.statevector_expectation(terms, _states(spark, sf_dir), ["vec_id"])


def e06_z_counts(spark, sf_dir) -> DataFrame:
    terms = supplier_op(spark, sf_dir, 6).df.withColumn("x0", F.lit(0).cast("long"))
    hist = table(spark, sf_dir, "events").groupBy(F.lpad(F.bin(F.col("user_id").bitwiseAND(F.lit(63))), 6, "0").alias("bitstring")).agg(F.count("*").cast("double").alias("cnt"))
    return expect.z_counts_expectation(terms, hist, 6).select(F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def o02_sort_by_weight(spark, sf_dir) -> DataFrame:
    return part_op(spark, sf_dir).sort(by_weight=True).df


QUERIES = {f.__name__: f for f in (c01_zero_terms, c03_parse_labels, c05_sparse_terms, c06_phased_labels, p01_render_labels, p02_sparse_terms, p05_scale, p06_weight, u01_add, s01_simplify_lineitem, s01_simplify_rtol, s04_simplify_ordered, j01_matmul_raw, j01_matmul_simplify, j06_commutes_pairs, j11_qwc_pairs, j12_self_conflicts, g01_count_total, g02_count_rows, g03_count_cols, g04_conflict_degrees, g07_both_degrees, c02_empty_sum, s10_simplify_exact, s11_simplify_widthless, e05_expectation_without_terms, g06_edges, g06_row_offsets, g08_topk_conflicts, k02_group_qwc, k03_group_full, e01_expectation_embeddings, e03_expectation_diagonal, e06_z_counts, o02_sort_by_weight)}

# ---- DuckDB --------------------------------------------------------------------------------------------------------

_L = "(select l_partkey & 63 x, l_suppkey & 63 z, l_quantity re, l_linenumber::double im from lineitem)"
_P = "(select p_partkey id, (p_partkey * 37) & 255 x, (p_partkey * 91) & 255 z, p_size::double re, 0.0::double im from part)"
_S = "(select s_suppkey id, (s_suppkey * 29) & 255 x, (s_suppkey * 53) & 255 z, (s_suppkey % 7)::double re, s_nationkey::double im from supplier)"
_S6 = "(select s_suppkey id, (s_suppkey * 29) & 63 x, (s_suppkey * 53) & 63 z, (s_suppkey % 7)::double re, s_nationkey::double im from supplier)"
_LABEL = "translate(md5(p_partkey::varchar) || md5(p_partkey::varchar || 'a') || md5(p_partkey::varchar || 'b'), '0123456789abcdef', 'IXYZIXYZIXYZIXYZ')"
_ODD = "(bit_count(xor(a.x & b.z, a.z & b.x))::bigint & 1) = 1"


def _bits(piece: str, ones: str) -> str:
    """A label's bits as a signed 64-bit number."""
    return f"lpad(translate({piece}, 'IXYZ', '{ones}'), 64, '0')::bit::bigint"


def _masks(label: str) -> str:
    low, high = f"substr({label}, 33, 64)", f"substr({label}, 1, 32)"
    return f"{_bits(low, '0110')} x0, {_bits(low, '0011')} z0, {_bits(high, '0110')} x1, {_bits(high, '0011')} z1"


_PRODUCT = f"""(select a.id l, b.id r, xor(a.x, b.x) x, xor(a.z, b.z) z, a.re * b.re - a.im * b.im re, a.re * b.im + a.im * b.re im,
  (bit_count(xor(a.x, b.x) & xor(a.z, b.z))::bigint - bit_count(a.x & a.z)::bigint - bit_count(b.x & b.z)::bigint + 2 * bit_count(a.x & b.z)::bigint) & 3 k
  from {_P} a cross join {_S} b)"""
_TURNED = "case k when 0 then re when 1 then -im when 2 then -re else im end + 0.0"
_TURNED_IM = "case k when 0 then im when 1 then re when 2 then -im else -re end + 0.0"
_STATE = "(select vec_id, generate_subscripts(embedding, 1) - 1 basis, round(unnest(embedding)::double * 1024) a from embeddings)"
_ORDERED = "select row_number() over (order by -bit_count(x | z)::int, x, z, id) rn, id, x, z from " + _S

ORACLE_SQL = {
    "c01_zero_terms": "select (row_number() over () - 1)::bigint term_id, 0::bigint x0, 0::bigint z0, 0.0::double re, 0.0::double im from supplier",
    "c03_parse_labels": f"select p_partkey term_id, {_masks(_LABEL)}, p_size::double re, 0.0::double im from part",
    "c05_sparse_terms": f"select p_partkey term_id, {_masks(_LABEL)}, p_size::double re, 0.0::double im from part",
    "c06_phased_labels": f"select p_partkey, substr({_LABEL}, 1, 32) label, case p_partkey % 6 when 0 then p_size when 1 then p_size when 4 then -p_size else 0 end::double re, case p_partkey % 6 when 2 then p_size when 3 then p_size when 5 then -p_size else 0 end::double im from part",
    "p01_render_labels": f"select p_partkey term_id, {_LABEL} label from part",
    "p02_sparse_terms": f"select p_partkey term_id, replace(reverse({_LABEL}), 'I', '') as local, array_to_string(list_filter(range(96), lambda q: substr({_LABEL}, (96 - q)::bigint, 1) <> 'I'), ',') qubits from part",
    "p05_scale": f"select id term_id, x x0, z z0, re * 2 + im * 3 re, re * -3 + im * 2 im from {_S}",
    "p06_weight": f"select id term_id, bit_count(x | z)::int weight, bit_count(x & z)::int y_count, x = 0 diagonal from {_P}",
    "u01_add": f"select id term_id, x x0, z z0, re, im from {_P} union all select id + (select max(p_partkey) + 1 from part), x, z, re, im from {_S}",
    "s01_simplify_lineitem": f"select x x0, z z0, sum(re) re, sum(im) im from {_L} group by x, z having sqrt(sum(re) * sum(re) + sum(im) * sum(im)) > 1e-12",
    "s01_simplify_rtol": f"select x x0, z z0, sum(re) re, sum(im) im from {_L} group by x, z having sqrt(sum(re) * sum(re) + sum(im) * sum(im)) > 0.25 + 7.0 * (select max(sqrt(re * re + im * im)) from {_L})",
    "s04_simplify_ordered": f"select (row_number() over (order by x, z) - 1)::bigint term_id, x x0, z z0, re, im from (select x, z, sum(re) re, sum(im) im from {_P} group by x, z having abs(sum(re)) > 1e-12)",
    "s10_simplify_exact": f"select x x0, z z0, sum(re) re, sum(im) im from {_L} group by x, z having sqrt(sum(re) * sum(re) + sum(im) * sum(im)) > 1e-12",
    "s11_simplify_widthless": f"select sum(re) re, sum(im) im from {_S}",
    "c02_empty_sum": f"select id term_id, x x0, z z0, re, im from {_S}",
    "g07_both_degrees": f"select 1::int axis, a.id, sum(case when {_ODD} then 1 else 0 end)::bigint n from {_P} a cross join {_S} b group by a.id union all select 0::int, b.id, sum(case when {_ODD} then 1 else 0 end)::bigint from {_P} a cross join {_S} b group by b.id",
    "e05_expectation_without_terms": "select vec_id, 0.0::double re from embeddings",
    "j01_matmul_raw": f"select l * (select max(s_suppkey) + 1 from supplier) + r term_id, x x0, z z0, {_TURNED} re, {_TURNED_IM} im from {_PRODUCT}",
    "j01_matmul_simplify": f"select x x0, z z0, sum(re) re, sum(im) im from (select x, z, {_TURNED} re, {_TURNED_IM} im from {_PRODUCT}) group by x, z having sqrt(sum(re) * sum(re) + sum(im) * sum(im)) > 1e-12",
    "j06_commutes_pairs": f"select a.id lhs_id, b.id rhs_id, not {_ODD} commutes from {_P} a cross join {_S} b",
    "j11_qwc_pairs": f"select a.id lhs_id, b.id rhs_id, xor(a.x & b.z, a.z & b.x) = 0 commutes from {_P} a cross join {_S} b",
    "j12_self_conflicts": f"select a.id row_id, b.id col_id from {_S} a cross join {_S} b where {_ODD}",
    "g01_count_total": f"with d as (select x, z, count(*) n from {_L} group by x, z) select coalesce(sum(a.n * b.n), 0)::bigint n from d a cross join d b where not {_ODD}",
    "g02_count_rows": f"select a.id, sum(case when {_ODD} then 0 else 1 end)::bigint n from {_P} a cross join {_S} b group by a.id",
    "g03_count_cols": f"select b.id, sum(case when {_ODD} then 0 else 1 end)::bigint n from {_P} a cross join {_S} b group by b.id",
    "g04_conflict_degrees": f"select a.id, sum(case when {_ODD} then 1 else 0 end)::bigint n from {_P} a cross join {_P} b group by a.id",
    "g06_edges": f"select a.id row_id, b.id col_id from {_P} a cross join {_S} b where {_ODD}",
    "g06_row_offsets": f"select id row_id, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select a.id, sum(case when {_ODD} then 1 else 0 end) n from {_P} a cross join {_S} b group by a.id)",
    "g08_topk_conflicts": f"select a.id, sum(case when {_ODD} then 1 else 0 end)::bigint n from {_P} a cross join {_P} b group by a.id order by n desc, a.id limit 10",
    "k02_group_qwc": f"""with recursive t as ({_ORDERED}), r(rn, id, g, xb, zb) as (
      select 0::bigint, null::bigint, 0::bigint, []::bigint[], []::bigint[]
      union all
      select rn, id, case when pos > 0 then pos else len(xb) + 1 end,
        case when pos > 0 then list_transform(xb, lambda v, i: case when i = pos then v | x else v end) else list_append(xb, x) end,
        case when pos > 0 then list_transform(zb, lambda v, i: case when i = pos then v | z else v end) else list_append(zb, z) end
      from (select t.rn, t.id, t.x, t.z, r.xb, r.zb, coalesce(list_position(list_transform(r.xb, lambda v, i: xor(t.x & r.zb[i], t.z & v) = 0), true), 0) pos from r join t on t.rn = r.rn + 1))
      select id term_id, (g - 1)::int group_id, (row_number() over (partition by g order by rn) - 1)::int pos_in_group from r where rn > 0""",
    "k03_group_full": f"""with recursive t as ({_ORDERED}), r(rn, id, g, xs, zs, gs, n) as (
      select 0::bigint, null::bigint, 0::bigint, []::bigint[], []::bigint[], []::bigint[], 0::bigint
      union all
      select rn, id, pos, list_append(xs, x), list_append(zs, z), list_append(gs, pos), greatest(n, pos + 1)
      from (select t.rn, t.id, t.x, t.z, r.xs, r.zs, r.gs, r.n, list_min(list_filter(range(r.n + 1), lambda c: not list_contains(list_transform(r.xs, lambda v, i: case when (bit_count(xor(t.x & r.zs[i], t.z & v))::bigint & 1) = 1 then r.gs[i] else -1 end), c))) pos from r join t on t.rn = r.rn + 1))
      select id term_id, g::int group_id, (row_number() over (partition by g order by rn) - 1)::int pos_in_group from r where rn > 0""",
    "e01_expectation_embeddings": f"""with t as (select x, z, sum(re) re, sum(im) im from {_S6} group by x, z), p as {_STATE}
      select vec_id, sum(v * t.re) re, sum(v * t.im) im from (
        select p.vec_id, t.x, t.z, sum(case when bit_count(t.x & t.z)::bigint & 1 = 1 then 0 else (1 - (bit_count(t.x & t.z)::bigint & 2)) * (1 - 2 * (bit_count(t.z & p.basis)::bigint & 1)) * p.a * q.a end) v
        from p cross join t join p q on q.vec_id = p.vec_id and q.basis = xor(p.basis, t.x) group by p.vec_id, t.x, t.z) join t using (x, z) group by vec_id""",
    "e03_expectation_diagonal": f"""with t as (select z, sum(re) re, sum(im) im from {_S6} group by z), p as {_STATE}
      select vec_id, sum((1 - 2 * (bit_count(t.z & p.basis)::bigint & 1)) * p.a * p.a * t.re) re, sum((1 - 2 * (bit_count(t.z & p.basis)::bigint & 1)) * p.a * p.a * t.im) im from p cross join t group by vec_id""",
    "e06_z_counts": f"""with h as (select user_id & 63 b, count(*)::double n from events group by 1)
      select round(sum(m * re), 6) re, round(sum(m * im), 6) im from (select t.id, t.re, t.im, sum((1 - 2 * (bit_count(t.z & h.b)::bigint & 1)) * h.n) / sum(h.n) m from {_S6} t cross join h group by t.id, t.re, t.im)""",
    "o02_sort_by_weight": f"select (row_number() over (order by bit_count(x | z), x, z, id) - 1)::bigint term_id, x x0, z z0, re, im from {_P}",
}
