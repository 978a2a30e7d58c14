"""A small harbour graph with known answers, through Cypher, AQL, SQL, the builder and writes."""

import pytest

from strataweave.builder import Query
from strataweave.lang.aql import run_aql
from strataweave.lang.core import Graph, QueryError
from strataweave.lang.cypher import run_cypher
from strataweave.lang.mutation import write_cypher
from strataweave.lang.sql import run_sql


@pytest.fixture(scope="module")
def graph(spark):
    ships = spark.createDataFrame(
        [(1, "Tern", 900, "north", "a//b"), (2, "Gull", 400, "north", None), (3, "Petrel", 1500, "south", None), (4, "Skua", 700, "south", "set"), (5, "Auk", 120, None, None)],
        "id long, title string, tonnage long, fleet string, note string",
    )
    ports = spark.createDataFrame([(21, "Varne", 9), (22, "Ostmoor", 14), (23, "Kell", 6)], "id long, town string, depth long")
    legs = [(1, 1, 21, "CALLS_AT", 3), (2, 1, 22, "CALLS_AT", 5), (3, 2, 22, "CALLS_AT", 1), (4, 3, 23, "CALLS_AT", 8), (5, 1, 2, "TOWS", 0), (6, 2, 4, "TOWS", 0), (7, 4, 1, "TOWS", 2), (8, 3, 23, "CALLS_AT", 2)]
    return Graph({"Ship": ships, "Port": ports}, spark.createDataFrame(legs, "eid long, src long, dst long, label string, days long"))


CYPHER = [
    ("MATCH (s:Ship) WHERE s.tonnage > 700 RETURN s.title AS x", ["Petrel", "Tern"]),
    ("MATCH (s:Ship) WHERE s.tonnage >= 400 AND s.tonnage <= 900 RETURN s.title AS x", ["Gull", "Skua", "Tern"]),
    ("MATCH (s:Ship {fleet: 'south'}) RETURN s.title AS x", ["Petrel", "Skua"]),
    ("MATCH (s:Ship) WHERE s.fleet IS NULL RETURN s.title AS x", ["Auk"]),
    ("MATCH (s:Ship) WHERE s.fleet <> 'north' RETURN s.title AS x", ["Auk", "Petrel", "Skua"]),
    ("MATCH (s:Ship) WHERE NOT (s.fleet = 'north' OR s.tonnage > 1000) RETURN s.title AS x", ["Auk", "Skua"]),
    ("MATCH (s:Ship) WHERE s.title CONTAINS 'u' AND s.title ENDS WITH 'k' RETURN s.title AS x", ["Auk"]),
    ("MATCH (s:Ship) WHERE s.title IN ['Auk', 'Skua', 'Heron'] RETURN s.title AS x", ["Auk", "Skua"]),
    ("MATCH (s:Ship) WHERE s.note = 'a//b' RETURN s.title AS x // a comment", ["Tern"]),
    ("MATCH (s:Ship) WHERE s.note = 'set' // set apart\nRETURN s.title AS x", ["Skua"]),
    ("MATCH (s:Ship)-[:CALLS_AT]->(p:Port) WHERE p.depth > 10 RETURN s.title AS x", ["Gull", "Tern"]),
    ("MATCH (p:Port)<-[:CALLS_AT]-(s:Ship {title: 'Petrel'}) RETURN p.town AS x", ["Kell"]),
    ("MATCH (s:Ship)-[c:CALLS_AT]->(p:Port {town: 'Kell'}) RETURN c.days AS x", [2, 8]),
    ("MATCH (s:Ship)-[c:CALLS_AT {days: 8}]->(p:Port) RETURN p.town AS x", ["Kell"]),
    ("MATCH (s:Ship {title: 'Tern'})-[:TOWS*1..2]->(o) RETURN o.title AS x", ["Gull", "Skua"]),
    ("MATCH (s:Ship {title: 'Tern'})-[:TOWS*2]->(o) RETURN o.title AS x", ["Skua"]),
    ("MATCH (s:Ship {title: 'Tern'})-[:TOWS]-(o) RETURN o.title AS x", ["Gull", "Skua"]),
    ("MATCH (a:Ship)-[:TOWS]->(b:Ship), (b)-[:CALLS_AT]->(p:Port) RETURN p.town AS x", ["Ostmoor", "Ostmoor", "Varne"]),
    ("MATCH (s:Ship) OPTIONAL MATCH (s)-[:CALLS_AT]->(p:Port) WHERE p.depth > 10 RETURN p.town AS x", [None, None, None, "Ostmoor", "Ostmoor"]),
    ("MATCH (s:Ship) OPTIONAL MATCH (s)-[:CALLS_AT]->(p:Port) WITH s, p WHERE p.town <> 'Kell' RETURN s.title AS x", ["Gull", "Tern", "Tern"]),
    ("MATCH (s:Ship) WITH s.fleet AS f, sum(s.tonnage) AS t WHERE t > 1000 RETURN t AS x", [1300, 2200]),
    ("MATCH (s:Ship) RETURN s.title AS x ORDER BY s.tonnage DESC SKIP 1 LIMIT 2", ["Skua", "Tern"]),
    ("MATCH (s:Ship) RETURN DISTINCT s.fleet AS x", [None, "north", "south"]),
    ("MATCH (s:Ship), (p:Port) WHERE p.depth = 6 RETURN s.title AS x", ["Auk", "Gull", "Petrel", "Skua", "Tern"]),
    ("UNWIND [5, 5, 7] AS n RETURN n AS x", [5, 5, 7]),
    ("MATCH (b:Buoy) RETURN b.id AS x", []),
]


@pytest.mark.parametrize("text,want", CYPHER)
def test_cypher(spark, graph, text, want):
    found = [r["x"] for r in run_cypher(spark, graph, text).collect()]
    assert sorted(found, key=lambda v: (v is not None, v)) == want


def test_cypher_groups_and_parameters(spark, graph):
    out = run_cypher(spark, graph, "MATCH (s:Ship)-[c:CALLS_AT]->(p:Port) WHERE c.days >= $least RETURN p.town AS town, count(*) AS n, collect(s.title) AS ships ORDER BY town", {"least": 2})
    assert [(r["town"], r["n"], sorted(r["ships"])) for r in out.collect()] == [("Kell", 2, ["Petrel", "Petrel"]), ("Ostmoor", 1, ["Tern"]), ("Varne", 1, ["Tern"])]
    assert "plan" in run_cypher(spark, graph, "EXPLAIN MATCH (s:Ship) RETURN s").columns


@pytest.mark.parametrize("text", ["CREATE (s:Ship)", "MATCH (s:Ship) SET s.tonnage = 1 RETURN s", "MATCH (s:Ship", "MATCH (s:Ship) WHERE s.tonnage > $none RETURN s", "MATCH (s:Ship) DELETE s", "RETURN"])
def test_cypher_reads_refuse(spark, graph, text):
    with pytest.raises(QueryError):
        run_cypher(spark, graph, text)


def test_names_like_clauses_are_no_writes(spark, graph):
    assert run_cypher(spark, graph, "MATCH (s:Ship) WHERE s.set IS NULL RETURN s.title AS create").count() == 5


def test_aql(spark, graph):
    out = run_aql(spark, graph, "MATCH (a:Ship)-[:TOWS]->(b:Ship) WHERE b.tonnage >= 700 RETURN a.title AS a, b.title AS b ORDER BY b.tonnage DESC").collect()
    assert [(r["a"], r["b"]) for r in out] == [("Skua", "Tern"), ("Gull", "Skua")]
    assert run_aql(spark, graph, "MATCH (s:Ship) RETURN COUNT(*)").first()[0] == 5
    # an absent key differs from any value, and is not ordered
    assert run_aql(spark, graph, "MATCH (s:Ship) WHERE s.mast <> 'x' RETURN s.id").count() == 5
    assert run_aql(spark, graph, "MATCH (s:Ship) WHERE s.mast > 'a' RETURN s.id").count() == 0


def test_aql_namespace(spark):
    nodes = spark.createDataFrame([(1, "in", "x"), (2, "out", "y"), (3, "in", "z")], "id long, namespace string, name string")
    edges = spark.createDataFrame([(1, 1, 3, "L", "in"), (2, 1, 2, "L", "in"), (3, 3, 1, "L", "out")], "eid long, src long, dst long, label string, namespace string")
    g = Graph({"N": nodes, "Bare": spark.createDataFrame([(9,)], "id long")}, edges)
    assert [r["a"] for r in run_aql(spark, g, "IN NAMESPACE 'in' MATCH (n:N)-[:L]->(m:N) RETURN n.name AS a").collect()] == ["x"]
    assert run_aql(spark, g, "IN NAMESPACE 'in' MATCH (b:Bare) RETURN b.id").count() == 0


def test_sql(spark, graph):
    assert [r["title"] for r in run_sql(spark, graph, "SELECT title FROM ship WHERE tonnage > 300 ORDER BY tonnage DESC LIMIT 2 OFFSET 1").collect()] == ["Tern", "Skua"]
    assert run_sql(spark, graph, "SELECT * FROM edges WHERE label = 'TOWS'").count() == 3
    out = run_sql(spark, graph, "SELECT fleet, COUNT(*) AS n FROM Ship GROUP BY fleet HAVING COUNT(*) > 1 AND MIN(tonnage) < 500").collect()
    assert [(r["fleet"], r["n"]) for r in out] == [("north", 2)]
    assert run_sql(spark, graph, "SELECT DISTINCT fleet FROM ship").count() == 3
    with pytest.raises(QueryError):
        run_sql(spark, graph, "SELECT * FROM ship, port")


def test_sql_nearest(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 6), (3, [1.0, 1.0], 7), (4, [1.0, 0.0], 8)]
    g = Graph({"Buoy": spark.createDataFrame(rows, "id long, embedding array<double>, mark long")})
    ids = lambda text: [r["id"] for r in run_sql(spark, g, text).collect()]
    assert ids("SELECT id FROM buoy ORDER BY embedding <=> '[1, 0]'::vector LIMIT 3") == [1, 4, 3]
    assert ids("SELECT id FROM buoy ORDER BY embedding <=> '[1, 0]'::vector, mark DESC LIMIT 2 OFFSET 1") == [1, 3]
    assert ids("SELECT id FROM buoy ORDER BY embedding <=> '[1, 0]'::vector LIMIT 0") == []
    assert ids("SELECT id FROM buoy WHERE KNN(embedding, '[0, 1]', 2)") == [2, 3]


def test_builder(spark, graph):
    q = Query(graph).scan("Ship").filter("title", "=", "Tern").traverse_out("TOWS", depth=3, min_depth=1).sort("tonnage", True)
    assert [r["title"] for r in q.build().collect()] == ["Skua", "Gull"]
    assert Query(graph).start(1, 22).count().first()[0] == 2
    with pytest.raises(QueryError):
        Query(graph).scan().build(max_rows=3)
    with pytest.raises(QueryError):
        Query(graph).filter("x", "=", 1)


def test_writes(spark, graph):
    names = lambda g: sorted(r["title"] for r in g.nodes["Ship"].collect())
    made = write_cypher(spark, graph, "CREATE (s:Ship {title: 'Crake', tonnage: 50})-[:CALLS_AT {days: 4}]->(p:Port {town: 'Lys'})")
    assert names(made) == ["Auk", "Crake", "Gull", "Petrel", "Skua", "Tern"] and names(graph) == ["Auk", "Gull", "Petrel", "Skua", "Tern"]
    assert [r["x"] for r in run_cypher(spark, made, "MATCH (s:Ship {title: 'Crake'})-[c:CALLS_AT]->(p:Port) RETURN p.town AS x").collect()] == ["Lys"]
    linked = write_cypher(spark, graph, "MATCH (s:Ship), (p:Port) WHERE s.fleet = 'south' AND p.town = 'Varne' CREATE (s)-[:CALLS_AT]->(p)")
    assert linked.edges.where("dst = 21").count() == 3 and linked.edges.select("eid").distinct().count() == 10
    renamed = write_cypher(spark, graph, "MATCH (s:Ship) WHERE s.tonnage < 500 SET s.fleet = 'small', s.crew = s.tonnage / 100")
    assert {r["title"]: (r["fleet"], r["crew"]) for r in renamed.nodes["Ship"].collect() if r["crew"] is not None} == {"Gull": ("small", 4.0), "Auk": ("small", 1.2)}
    assert write_cypher(spark, graph, "MATCH (s:Ship)-[c:TOWS]->(o:Ship) DELETE c").edges.count() == 5
    gone = write_cypher(spark, graph, "MATCH (s:Ship {title: 'Tern'}) DETACH DELETE s")
    assert names(gone) == ["Auk", "Gull", "Petrel", "Skua"] and gone.edges.count() == 4
    with pytest.raises(QueryError):
        write_cypher(spark, graph, "MATCH (s:Ship {title: 'Tern'}) DELETE s")
    merged = write_cypher(spark, graph, "MERGE (s:Ship {title: 'Auk'}) ON MATCH SET s.note = 'met' ON CREATE SET s.note = 'made'")
    assert merged.nodes["Ship"].where("note = 'met'").count() == 1 and merged.nodes["Ship"].count() == 5
    assert write_cypher(spark, graph, "MATCH (s:Ship) REMOVE s.fleet").nodes["Ship"].where("fleet is not null").count() == 0
