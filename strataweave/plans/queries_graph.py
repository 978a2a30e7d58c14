"""Queries of the graph operators: scans, predicates, traversal, patterns, aggregation, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..functions import predicates as P
from ..operators import graph as G
from .catalog import query

T = M.table
#: DuckDB's edge views, alike for all oracles.
CONTAINS = "(SELECT (l_orderkey * 10 + l_linenumber) * 8 + 2 AS eid, l_orderkey * 8 + 2 AS src, l_partkey * 8 + 3 AS dst, l_quantity AS quantity FROM lineitem)"
LOCATED = (
    "(SELECT c_custkey AS eid, c_custkey AS src, (-1 - c_nationkey)::BIGINT AS dst FROM customer UNION ALL "
    "SELECT (-1 - n_nationkey)::BIGINT, (-1 - n_nationkey)::BIGINT, (-1001 - n_regionkey)::BIGINT FROM nation)"
)
NEXT = (
    "(SELECT a.conv_id * 1000 + a.turn AS src, b.conv_id * 1000 + b.turn AS dst FROM conversations a "
    "JOIN conversations b ON a.conv_id * 1000 + a.turn = b.conv_id * 1000 + b.turn - 1)"
)


@query("flagship", "SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey "
       "WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def flagship(spark, d):
    from .catalog import flagship as f

    return f(spark, d)


@query("start_node", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def start_node(spark, d):
    return T(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal")


@query("start_nodes", "SELECT c_custkey, c_name, p AS pos FROM (VALUES (5, 0), (3, 1), (99999999, 2), (11, 3)) v(k, p) JOIN customer ON c_custkey = k")
def start_nodes(spark, d):
    return G.start_nodes(T(spark, d, "customer"), [5, 3, 99999999, 11], "c_custkey").select("c_custkey", "c_name", "pos")


@query("scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000.0 AND o_orderpriority LIKE '1-%'")
def scan_filter(spark, d):
    o = T(spark, d, "orders")
    keep = P.eq(F.col("o_orderstatus"), "F") & P.gt(F.col("o_totalprice"), 1000.0) & P.starts_with(F.col("o_orderpriority"), "1-")
    return o.where(keep).select("o_orderkey", "o_totalprice")


@query("scan_edges", f"SELECT eid, src, dst, quantity FROM {CONTAINS} WHERE quantity >= 45")
def scan_edges(spark, d):
    return M.contains_edges(spark, d).where(P.ge(F.col("quantity"), 45)).select("eid", "src", "dst", "quantity")


@query("predicates_two_valued", """
SELECT p.doc_id, l.quality IS NOT DISTINCT FROM 1 AS is_one, NOT (l.quality IS NOT DISTINCT FROM 1) AS not_one,
       coalesce(l.quality > 0, false) AS above, l.doc_id IS NOT NULL AS has, coalesce(l.quality IN (0, 1), false) AS among
FROM documents p LEFT JOIN labels l USING (doc_id)""")
def predicates_two_valued(spark, d):
    j = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels"), "doc_id", "left")
    q = F.col("quality")
    return j.select("doc_id", P.eq(q, 1).alias("is_one"), P.ne(q, 1).alias("not_one"), P.gt(q, 0).alias("above"), P.exists(q).alias("has"), P.is_in(q, [0, 1]).alias("among"))


@query("predicates_three_valued", """
SELECT p.doc_id, quality = 1 AS eq, NOT (quality = 1) AS noteq, coalesce(quality <> 0, false) AS kept
FROM documents p LEFT JOIN labels l USING (doc_id)""")
def predicates_three_valued(spark, d):
    j = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels"), "doc_id", "left")
    q = F.col("quality")
    return j.select("doc_id", P.compare("R2", "=", q, 1).alias("eq"), (~P.compare("R2", "=", q, 1)).alias("noteq"), F.coalesce(P.compare("R2", "<>", q, 0), F.lit(False)).alias("kept"))


@query("predicates_null_bound", """
SELECT p.doc_id, l.doc_id IS NOT NULL AND quality = 1 AS eq, l.doc_id IS NOT NULL AND quality <> 1 AS ne, NOT (l.doc_id IS NOT NULL AND quality = 1) AS noteq
FROM documents p LEFT JOIN labels l USING (doc_id)""")
def predicates_null_bound(spark, d):
    lab = T(spark, d, "labels").withColumn("bound", F.lit(True))
    j = T(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    q, b = F.col("quality"), F.col("bound")
    eq, ne = P.compare("R3", "=", q, 1, b), P.compare("R3", "<>", q, 1, b)
    return j.select("doc_id", eq.alias("eq"), ne.alias("ne"), (~eq).alias("noteq"))


@query("string_predicates", "SELECT p_partkey, contains(p_name, '1') AS c, starts_with(p_type, 'S') AS s, ends_with(p_brand, '3') AS e FROM part")
def string_predicates(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", P.contains(F.col("p_name"), "1").alias("c"), P.starts_with(F.col("p_type"), "S").alias("s"), P.ends_with(F.col("p_brand"), "3").alias("e"))


@query("traverse_out", f"""SELECT DISTINCT src AS anchor, dst AS id, 1 AS depth FROM orders JOIN {CONTAINS} ON src = o_orderkey * 8 + 2 WHERE o_orderpriority = '1-URGENT'""")
def traverse_out(spark, d):
    a = T(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(M.in_space("o_orderkey", "Order").alias("anchor"))
    return G.traverse(a, M.contains_edges(spark, d), "out", 1, 1)


@query("traverse_in", f"SELECT DISTINCT dst AS anchor, src AS id, 1 AS depth FROM part JOIN {CONTAINS} ON dst = p_partkey * 8 + 3 WHERE p_size > 40")
def traverse_in(spark, d):
    a = T(spark, d, "part").where("p_size > 40").select(M.in_space("p_partkey", "Part").alias("anchor"))
    return G.traverse(a, M.contains_edges(spark, d), "in", 1, 1)


@query("traverse_both", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM {NEXT} UNION ALL SELECT dst, src FROM {NEXT}),
w AS (SELECT conv_id * 1000 + turn AS anchor, conv_id * 1000 + turn AS id, 0 AS depth FROM conversations WHERE turn = 2
      UNION SELECT anchor, dst, depth + 1 FROM w JOIN e ON src = id WHERE depth < 3)
SELECT anchor, id, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) >= 1""")
def traverse_both(spark, d):
    a = T(spark, d, "conversations").where("turn = 2").select((F.col("conv_id") * 1000 + F.col("turn")).alias("anchor"))
    return G.traverse(a, M.conversation_edges(spark, d), "both", 1, 3)


@query("traverse_variable", f"""
WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS anchor, conv_id * 1000 + turn AS id, 0 AS depth FROM conversations WHERE turn = 0
      UNION ALL SELECT anchor, dst, depth + 1 FROM w JOIN {NEXT} ON src = id WHERE depth < 10)
SELECT anchor, id, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) >= 1""")
def traverse_variable(spark, d):
    a = T(spark, d, "conversations").where("turn = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("anchor"))
    return G.traverse(a, M.conversation_edges(spark, d))


@query("traverse_exact_two", f"""
SELECT DISTINCT a.src AS anchor, b.dst AS id, 2 AS depth FROM {LOCATED} a JOIN {LOCATED} b ON a.dst = b.src WHERE a.src >= 0""")
def traverse_exact_two(spark, d):
    a = T(spark, d, "customer").select(F.col("c_custkey").alias("anchor"))
    return G.traverse(a, M.located_edges(spark, d), "out", 2, 2)


@query("traverse_paths", f"""
SELECT a.src AS anchor, b.dst AS id, 2 AS depth, [a.src, a.eid, a.dst, b.eid, b.dst] AS path FROM {LOCATED} a JOIN {LOCATED} b ON a.dst = b.src WHERE a.src >= 0""")
def traverse_paths(spark, d):
    a = T(spark, d, "customer").select(F.col("c_custkey").alias("anchor"))
    return G.traverse(a, M.located_edges(spark, d), "out", 2, 2, with_path=True)


@query("edge_bound_hop", f"SELECT o_orderkey, eid, dst, quantity FROM orders JOIN {CONTAINS} ON src = o_orderkey * 8 + 2 WHERE o_orderstatus = 'P' AND quantity > 30")
def edge_bound_hop(spark, d):
    a = T(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", M.in_space("o_orderkey", "Order").alias("id"))
    e = M.contains_edges(spark, d).where("quantity > 30")
    return G.expand(a, e, "out").select("o_orderkey", "eid", "dst", "quantity")


@query("optional_match", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey""")
def optional_match(spark, d):
    c = T(spark, d, "customer").select("c_custkey")
    big = T(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return G.optional_match(c, big, ["c_custkey"])


@query("pattern_isomorphism", """
SELECT o.o_custkey * 8 + 1 AS c, o.o_orderkey * 8 + 2 AS o, a.l_partkey * 8 + 3 AS p, b.l_partkey * 8 + 3 AS q, o.o_orderkey * 8 + 1 AS e0,
  (a.l_orderkey * 10 + a.l_linenumber) * 8 + 2 AS e1, (b.l_orderkey * 10 + b.l_linenumber) * 8 + 2 AS e2
FROM orders o JOIN lineitem a ON a.l_orderkey = o.o_orderkey JOIN lineitem b ON b.l_orderkey = o.o_orderkey
WHERE a.l_linenumber <> b.l_linenumber AND o.o_totalprice > 250000""")
def pattern_isomorphism(spark, d):
    placed = M.placed_edges(spark, d).where("price > 250000")
    lines = M.contains_edges(spark, d)
    return G.match_pattern([("c", placed, "o"), ("o", lines, "p"), ("o", lines, "q")])


@query("aggregate_groups", """
SELECT c_mktsegment, count(*) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total, round(avg(c_acctbal), 6) AS mean, min(c_name) AS first, max(c_acctbal) AS top,
  count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1""")
def aggregate_groups(spark, d):
    out = G.aggregate(T(spark, d, "customer"), ["c_mktsegment"], n=("count", "*"), total=("sum", "c_acctbal"), mean=("avg", "c_acctbal"),
                      first=("min", "c_name"), top=("max", "c_acctbal"), nations=("count", "c_nationkey", True))
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("aggregate_empty", "SELECT count(*) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS total, avg(c_acctbal) AS mean, max(c_name) AS top FROM customer WHERE c_custkey < 0")
def aggregate_empty(spark, d):
    return G.aggregate(T(spark, d, "customer").where("c_custkey < 0"), [], n=("count", "*"), total=("sum", "c_custkey"), mean=("avg", "c_acctbal"), top=("max", "c_name"))


@query("aggregate_collect", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def aggregate_collect(spark, d):
    return G.aggregate(T(spark, d, "nation"), ["n_regionkey"], names=("collect", "n_name"))


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return T(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("sort_skip_limit", """
SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 25 OFFSET 10""")
def sort_skip_limit(spark, d):
    j = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return G.page(G.order_by(j, ("quality", True), ("doc_id", False)), 10, 25)


@query("distinct_by_entity", f"SELECT dst AS id, count(*) AS n FROM {CONTAINS} GROUP BY 1")
def distinct_by_entity(spark, d):
    e = M.contains_edges(spark, d)
    nodes = G.distinct_entities(e.select(F.col("dst").alias("id")))
    return nodes.join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id")


@query("set_operations", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_operations(spark, d):
    o = T(spark, d, "orders")
    a, b = (G.distinct_entities(o.where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("id"))) for s in "FP")
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("union", G.union_entities(a, b)).union(count("intersect", G.intersect_entities(a, b))).union(count("except", G.except_entities(a, b)))


@query("property_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal WHERE c_mktsegment = 'MACHINERY'")
def property_join(spark, d):
    c = T(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    s = T(spark, d, "supplier")
    return G.property_join(c, s, [("c_nationkey", "s_nationkey")], F.col("c_acctbal") > F.col("s_acctbal")).select("c_custkey", "s_suppkey")


@query("degree_counts", f"""
SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {LOCATED} UNION ALL SELECT dst, 0, 1 FROM {LOCATED}) GROUP BY 1""")
def degree_counts(spark, d):
    return G.degrees(M.located_edges(spark, d))


@query("namespace_scope", "SELECT source, lang, count(*) AS n FROM documents WHERE source IN ('src0', 'src3') GROUP BY 1, 2")
def namespace_scope(spark, d):
    return T(spark, d, "documents").where(F.col("source").isin("src0", "src3")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("unique_violations", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return G.unique_violations(T(spark, d, "part"), ["p_brand", "p_size"])


@query("schema_conformance", """
SELECT count(*) AS rows, count(*) FILTER (WHERE quality IS NULL) AS missing_quality, count(*) FILTER (WHERE quality NOT IN (0, 1)) AS bad_quality,
  count(*) FILTER (WHERE text IS NULL OR text = '') AS empty_text FROM documents LEFT JOIN labels USING (doc_id)""")
def schema_conformance(spark, d):
    j = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left")
    quality, text = F.col("quality"), F.col("text")
    return G.conformance(j, {"missing_quality": quality.isNull(), "bad_quality": ~quality.isin(0, 1), "empty_text": text.isNull() | (text == "")})


@query("friends_within_two_hops", """
SELECT a.o_custkey AS anchor, b.o_custkey AS id, count(DISTINCT x.l_partkey) AS shared FROM orders a JOIN lineitem x ON x.l_orderkey = a.o_orderkey
JOIN lineitem y ON y.l_partkey = x.l_partkey JOIN orders b ON b.o_orderkey = y.l_orderkey
WHERE a.o_orderpriority = '1-URGENT' AND a.o_orderstatus = 'P' AND a.o_custkey <> b.o_custkey AND x.l_quantity >= 40 AND y.l_quantity >= 40 GROUP BY 1, 2""")
def friends_within_two_hops(spark, d):
    o, li = T(spark, d, "orders"), T(spark, d, "lineitem").where("l_quantity >= 40")
    bought = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    near = bought.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("anchor"), "l_partkey").distinct()
    far = bought.select(F.col("o_custkey").alias("id"), "l_partkey").distinct()
    return near.join(far, "l_partkey").where("anchor <> id").groupBy("anchor", "id").agg(F.count("*").alias("shared"))
