"""Queries through the language front ends and the fluent builder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..builder import Query
from ..lang.aql import run_aql
from ..lang.core import Graph
from ..lang.cypher import run_cypher
from ..lang.mutation import write_cypher
from ..lang.sql import run_sql
from ..operators import temporal as TP
from .catalog import query
from .queries_temporal import JAN, V, WRITES, X, _as_of, _window_sql
from .queries_vector import NODES, QS, Q


def shop(spark, d) -> Graph:
    """Customers, orders, parts and suppliers as one graph of one id space."""
    placed = M.placed_edges(spark, d)
    lines = M.contains_edges(spark, d)
    return Graph(M.shop_nodes(spark, d), placed.unionByName(lines, allowMissingColumns=True), {"User": M.event_writes(spark, d)})


def users(spark, d) -> Graph:
    w = M.event_writes(spark, d)
    return Graph({"User": TP.as_of(w, TP.OPEN)}, None, {"User": w})


def vectors(spark, d) -> Graph:
    return Graph({"Vec": M.vector_nodes(spark, d).withColumnRenamed("label", "kind")}, M.vector_links(spark, d))


@query("aql_match_filter", "SELECT c_name AS name, c_acctbal AS n_c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_name LIMIT 15")
def aql_match_filter(spark, d):
    return run_aql(spark, shop(spark, d), "MATCH (n:Customer) WHERE n.c_acctbal > 5000 AND n.c_mktsegment = 'BUILDING' RETURN n.c_name AS name, n.c_acctbal ORDER BY n.c_acctbal DESC, n.c_name LIMIT 15")


@query("aql_traverse_count", """SELECT c_custkey AS customer, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey
 WHERE c_mktsegment = 'FURNITURE' AND o_totalprice > 100000 GROUP BY 1""")
def aql_traverse_count(spark, d):
    return run_aql(spark, shop(spark, d), "MATCH (c:Customer {c_mktsegment: 'FURNITURE'})-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000.5 OR o.o_totalprice > 100000 RETURN c.c_custkey AS customer, COUNT(o) AS orders")


@query("aql_variable_depth", """SELECT DISTINCT c_custkey AS customer, l_partkey AS part FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0 AND p_size > 20""")
def aql_variable_depth(spark, d):
    return run_aql(spark, shop(spark, d), "MATCH (c:Customer)-[*1..2]->(p:Part) WHERE c.c_mktsegment = 'MACHINERY' AND c.c_acctbal < 0 AND p.p_size > 20 RETURN DISTINCT c.c_custkey AS customer, p.p_partkey AS part")


@query("aql_as_of", f"WITH {WRITES}, {_as_of(V, X)} SELECT id, value AS u_value FROM x WHERE kind <> 'view'")
def aql_as_of(spark, d):
    return run_aql(spark, users(spark, d), f"AS OF {V}, {X} MATCH (u:User) WHERE u.kind <> 'view' RETURN u.id AS id, u.value")


@query("aql_window", f"SELECT strftime(make_timestamp(window_start), '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, strftime(make_timestamp(window_end), '%Y-%m-%dT%H:%M:%S.%fZ') AS window_end, average AS mean, changes AS moves, entities AS n FROM ({_window_sql('1 MONTH', '2024-05-01')})")
def aql_window(spark, d):
    out = run_aql(spark, users(spark, d), "MATCH (u:User) WINDOW 1 MONTH OVER VALID_TIME FROM '2024-01-01' TO '2024-05-01' RETURN AVG(u.value) AS mean, CHANGES(*) AS moves, COUNT(*) AS n")
    return out.withColumn("mean", F.round("mean", 6))


@query("aql_similar", f"WITH {NODES} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS score FROM n ORDER BY list_cosine_similarity(e, {QS}) DESC, id LIMIT 7")
def aql_similar(spark, d):
    return run_aql(spark, vectors(spark, d), "SIMILAR TO $q USING COSINE LIMIT 7 RETURN n.id AS id", {"q": Q}).withColumn("score", F.round("score", 6))


@query("aql_rank", f"WITH {NODES} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS score FROM n WHERE label = 6 ORDER BY list_cosine_similarity(e, {QS}) DESC, id LIMIT 5")
def aql_rank(spark, d):
    return run_aql(spark, vectors(spark, d), "MATCH (n:Vec) WHERE n.kind = 6 RANK BY SIMILARITY TO $q TOP 5 RETURN n.id AS id", {"q": Q}).withColumn("score", F.round("score", 6))


@query("cypher_group", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def cypher_group(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (c:Customer) RETURN c.c_mktsegment AS segment, count(*) AS n, avg(c.c_acctbal) AS mean").withColumn("mean", F.round("mean", 6))


@query("cypher_optional", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000.0) ON o_custkey = c_custkey")
def cypher_optional(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > $p RETURN c.c_custkey AS c, o.o_orderkey AS o", {"p": 350000.0})


@query("cypher_multi_pattern", """SELECT o.o_orderkey AS o, a.l_partkey AS p, b.l_partkey AS q FROM orders o JOIN lineitem a ON a.l_orderkey = o.o_orderkey JOIN lineitem b ON b.l_orderkey = o.o_orderkey
 JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey WHERE a.l_linenumber <> b.l_linenumber AND x.p_size = y.p_size AND x.p_brand = y.p_brand""")
def cypher_multi_pattern(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (o:Order)-[:CONTAINS]->(p:Part), (o)-[:CONTAINS]->(q:Part) WHERE p.p_size = q.p_size AND p.p_brand = q.p_brand RETURN o.o_orderkey AS o, p.p_partkey AS p, q.p_partkey AS q")


@query("cypher_with", "SELECT segment, n FROM (SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1) WHERE n > 10 ORDER BY n DESC, segment LIMIT 3")
def cypher_with(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (c:Customer) WHERE c.c_acctbal >= 0 WITH c.c_mktsegment AS segment, count(*) AS n WHERE n > 10 RETURN segment, n ORDER BY n DESC, segment LIMIT 3")


@query("cypher_unwind", "SELECT unnest([3, 1, 2, 1]) AS x ORDER BY 1")
def cypher_unwind(spark, d):
    return run_cypher(spark, shop(spark, d), "UNWIND [3, 1, 2, 1] AS x RETURN x ORDER BY x")


@query("cypher_vector", f"WITH {NODES} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS s FROM n WHERE list_cosine_similarity(e, {QS}) > 0.1")
def cypher_vector(spark, d):
    return run_cypher(spark, vectors(spark, d), "MATCH (n:Vec) WHERE vector.similarity(n.embedding, $q) > 0.1 RETURN n.id AS id, vector.similarity(n.embedding, $q) AS s", {"q": Q}).withColumn("s", F.round("s", 6))


@query("cypher_edge_property", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_quantity >= 49")
def cypher_edge_property(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 49 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.quantity AS q")


@query("sql_select", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sql_select(spark, d):
    return run_sql(spark, shop(spark, d), "SELECT o_orderkey AS id, o_totalprice AS price FROM Order WHERE o_orderstatus = 'F' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")


@query("sql_group", "SELECT p_brand, count(*) AS n, max(p_size) AS top FROM part WHERE p_type LIKE '%S%' GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC, p_brand")
def sql_group(spark, d):
    return run_sql(spark, shop(spark, d), "SELECT p_brand, COUNT(*) AS n, MAX(p_size) AS top FROM part WHERE p_type LIKE '%S%' GROUP BY p_brand HAVING COUNT(*) > 3 ORDER BY n DESC, p_brand")


@query("sql_system_time", f"WITH {WRITES}, {_as_of(V, X)} SELECT id, kind FROM x WHERE value > 20")
def sql_system_time(spark, d):
    return run_sql(spark, users(spark, d), f"SELECT id, kind FROM user FOR SYSTEM_TIME AS OF {X} FOR VALID_TIME AS OF {V} WHERE value > 20.0")


@query("sql_match", "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P' AND p_size < 5")
def sql_match(spark, d):
    return run_sql(spark, shop(spark, d), "SELECT DISTINCT p_partkey AS id FROM nodes MATCH (o:Order {o_orderstatus: 'P'})-[:CONTAINS]->(p:Part) WHERE p.p_size < 5")


@query("cypher_null_bound", """SELECT c_custkey AS c FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000.0) ON o_custkey = c_custkey
 WHERE o_orderkey IS NOT NULL AND o_orderstatus <> 'F'""")
def cypher_null_bound(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 350000.0 WITH c, o WHERE o.o_orderstatus <> 'F' RETURN c.c_custkey AS c")


@query("cypher_variable_length", """SELECT DISTINCT c_custkey AS c, l_partkey AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN part ON p_partkey = l_partkey WHERE c_acctbal > 9500 AND p_size < 3""")
def cypher_variable_length(spark, d):
    return run_cypher(spark, shop(spark, d), "MATCH (c:Customer)-[*2]->(p:Part) WHERE c.c_acctbal > 9500 AND p.p_size < 3 RETURN c.c_custkey AS c, p.p_partkey AS p")


@query("sql_having", "SELECT p_brand, count(*) AS n, max(p_size) AS top FROM part GROUP BY 1 HAVING count(*) > 3 AND max(p_size) >= 45 OR avg(p_size) < 10 ORDER BY n DESC, p_brand")
def sql_having(spark, d):
    return run_sql(spark, shop(spark, d), "SELECT p_brand, COUNT(*) AS n, MAX(p_size) AS top FROM part GROUP BY p_brand HAVING COUNT(*) > 3 AND MAX(p_size) >= 45 OR AVG(p_size) < 10 ORDER BY n DESC, p_brand")


@query("sql_knn_page", f"WITH {NODES} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS score FROM n ORDER BY list_cosine_similarity(e, {QS}) DESC, id LIMIT 4 OFFSET 3")
def sql_knn_page(spark, d):
    return run_sql(spark, vectors(spark, d), "SELECT id FROM vec ORDER BY embedding <=> '" + str(Q) + "'::vector LIMIT 4 OFFSET 3").withColumn("score", F.round("score", 6))


@query("sql_knn_function", f"WITH {NODES} SELECT id, round(1 / (1 + list_distance(e, {QS})), 6) AS score FROM n ORDER BY list_distance(e, {QS}), id LIMIT 5")
def sql_knn_function(spark, d):
    return run_sql(spark, vectors(spark, d), "SELECT id FROM vec WHERE KNN(embedding, '" + str(Q) + "', 5, 'euclidean')").withColumn("score", F.round("score", 6))


@query("aql_rank_threshold", f"WITH {NODES} SELECT id, round(1 / (1 + list_distance(e, {QS})), 6) AS near FROM n WHERE label IN (1, 2) AND 1 / (1 + list_distance(e, {QS})) >= 0.15 ORDER BY list_distance(e, {QS}), id LIMIT 6")
def aql_rank_threshold(spark, d):
    out = run_aql(spark, vectors(spark, d), "MATCH (n:Vec) WHERE n.kind IN [1, 2] RANK BY SIMILARITY TO $q USING EUCLIDEAN THRESHOLD >= 0.15 TOP 6 AS near RETURN n.id AS id, near", {"q": Q})
    return out.withColumn("near", F.round("near", 6))


@query("cypher_create", """SELECT 'nodes' AS part, count(*)::BIGINT + 2 AS n FROM customer UNION ALL SELECT 'edges', count(*)::BIGINT + 1 FROM orders""")
def cypher_create(spark, d):
    g = Graph({"Customer": M.shop_nodes(spark, d)["Customer"]}, M.placed_edges(spark, d))
    g = write_cypher(spark, g, "CREATE (a:Customer {c_name: 'new one'})-[:KNOWS {since: 3}]->(b:Customer {c_name: 'new two'})")
    return g.scan(None).agg(F.lit("nodes").alias("part"), F.count("*").alias("n")).union(g.edges.agg(F.lit("edges"), F.count("*")))


@query("cypher_set", "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN 'cleared' END AS note FROM customer")
def cypher_set(spark, d):
    g = write_cypher(spark, Graph({"Customer": M.shop_nodes(spark, d)["Customer"]}), "MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 0.0, c.note = 'cleared'")
    return g.nodes["Customer"].select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("balance"), "note")


@query("cypher_delete", """SELECT 'nodes' AS part, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS n UNION ALL
 SELECT 'edges', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""")
def cypher_delete(spark, d):
    g = Graph({"Customer": M.shop_nodes(spark, d)["Customer"]}, M.placed_edges(spark, d))
    g = write_cypher(spark, g, "MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c")
    return g.scan(None).agg(F.lit("nodes").alias("part"), F.count("*").alias("n")).union(g.edges.agg(F.lit("edges"), F.count("*")))


@query("cypher_merge", "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'seen' END AS state FROM nation UNION ALL SELECT 'ATLANTIS', 'fresh'")
def cypher_merge(spark, d):
    nations = M.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    name = M.table(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    g = Graph({"Nation": nations})
    for own in (name, "ATLANTIS"):
        g = write_cypher(spark, g, "MERGE (n:Nation {name: $name}) ON CREATE SET n.state = 'fresh' ON MATCH SET n.state = 'seen'", {"name": own})
    return g.nodes["Nation"].select("name", "state")


@query("sql_knn", f"WITH {NODES} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS score FROM n ORDER BY list_cosine_similarity(e, {QS}) DESC, id LIMIT 6")
def sql_knn(spark, d):
    return run_sql(spark, vectors(spark, d), "SELECT id FROM vec ORDER BY embedding <=> '" + str(Q) + "'::vector LIMIT 6").withColumn("score", F.round("score", 6))


@query("builder_chain", """SELECT DISTINCT o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000 ORDER BY 1 LIMIT 30""")
def builder_chain(spark, d):
    q = Query(shop(spark, d)).scan("Customer").filter("c_mktsegment", "=", "BUILDING").traverse_out("PLACED").with_label("Order")
    return q.filter("o_totalprice", ">", 300000).sort("id").limit(30).build().select(F.col("o_orderkey").alias("id"))


@query("builder_as_of", f"WITH {WRITES}, {_as_of(V, X)} SELECT id, value FROM x WHERE value >= 10 ORDER BY value DESC, id LIMIT 20")
def builder_as_of(spark, d):
    q = Query(users(spark, d)).as_of(V, X).scan("User").filter("value", ">=", 10.0)
    return q.sort("value", True).sort("id").limit(20).build().select("id", "value")


_ = JAN
