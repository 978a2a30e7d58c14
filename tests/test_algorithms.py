"""Hand-computed answers of the packaged analyses on small graphs."""

import math

import pytest
from pyspark.sql import functions as F

from strataweave.functions import evaluation as EV
from strataweave.operators import graph as G
from strataweave.operators import provenance as PV
from strataweave.operators import vector as VO
from strataweave.operators.algorithms import characterization as C
from strataweave.operators.algorithms import chronicle as H
from strataweave.operators.algorithms import diagnostics as D
from strataweave.operators.algorithms import reasoning as R
from strataweave.operators.algorithms import semantic as S


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.8, 0.2, 0.0, 0.0])], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 1, 2, "KNOWS"), (2, 1, 3, "KNOWS"), (3, 1, 4, "KNOWS"), (4, 2, 3, "KNOWS"), (5, 4, 3, "KNOWS"), (6, 3, 3, "SELF")], "eid long, src long, dst long, label string")


def test_traverse_and_rank(spark, nodes, edges):
    anchor = spark.createDataFrame([(1,)], "anchor long")
    out = VO.traverse_and_rank(anchor, edges, nodes, [1.0, 0, 0, 0], 3).collect()
    assert [r["id"] for r in out] == [2, 4, 3]


def test_traversal_depths_and_paths(spark, edges):
    anchor = spark.createDataFrame([(1,)], "anchor long")
    assert sorted((r["id"], r["depth"]) for r in G.traverse(anchor, edges).collect()) == [(2, 1), (3, 1), (4, 1)]
    out = G.traverse(spark.createDataFrame([(2,)], "anchor long"), edges, "both", 2, 2, with_path=True).collect()
    assert [(r["id"], r["path"]) for r in out] == [(4, [2, 1, 1, 3, 4])]


def test_shortest_costs(spark):
    hops = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 0.0)], "src long, dst long, cost double")
    out = G.shortest_costs(spark.createDataFrame([(1,)], "anchor long"), hops).where("id = 3").first()
    assert (out["cost"], out["path"]) == (2.0, [1, 2, 3])


def test_rerank_refuses_another_dimension(nodes):
    with pytest.raises(Exception, match="dimensions differ"):
        VO.rerank(nodes, [1.0, 0]).collect()


def test_adamic_adar(nodes, edges):
    out = {(r["a"], r["b"]): r["score"] for r in R.predict_links(nodes, edges.where("label = 'KNOWS'")).collect()}
    cos = (0.9 * 0.8 + 0.1 * 0.2) / math.hypot(0.9, 0.1) / math.hypot(0.8, 0.2)
    assert set(out) == {(2, 4), (4, 2)}
    assert out[2, 4] == pytest.approx((1 / math.log(3) + 1 / math.log(3)) * (1 + cos))


def test_trust_policies(spark):
    c = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, None), (4, 0.8)], "version long, confidence double")
    lineage = spark.createDataFrame([(1, 2), (2, 4), (4, 3)], "derived long, source long")
    weakest = {r["version"]: r["trust"] for r in PV.trust(c, lineage, missing=0.5).collect()}
    assert weakest == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5}
    noisy = {r["version"]: r["trust"] for r in PV.trust(c, lineage, "noisy_or", None).collect()}
    assert noisy[2] == pytest.approx(1 - 0.5 * 0.2) and noisy[3] == 0.5


def test_counterfactual_drops_orphans(spark):
    w = spark.createDataFrame(
        [(1, 1, 1, 1, "update", "a", 10, 1), (1, 2, 2, 2, "update", "b", 10, 2), (1, 3, 3, 3, "update", "a", 30, 2), (2, 4, 1, 1, "update", "b", 7, 0), (2, 5, 2, 2, "update", "a", 8, 0)],
        "id long, version_id long, vf long, tf long, op string, source string, x long, y long",
    )
    out = [tuple(r) for r in PV.counterfactual(w, ["x", "y"], F.col("source") == "b").collect()]
    # the third write changed x only, so the excluded y is gone
    assert out == [(1, 30, 1)]


def test_kaplan_meier(spark):
    spans = spark.createDataFrame([("k", 1, True), ("k", 2, False), ("k", 3, True), ("k", 4, True)], "kind string, life long, event boolean")
    out = [round(r["survival"], 6) for r in PV.kaplan_meier(spans, "kind").orderBy("life").collect()]
    assert out == [0.75, 0.75, 0.375, 0.0]


def test_kmeans_starts_from_evenly_spaced_rows(spark):
    rows = [(k, [float(k // 10), 0.0]) for k in range(40)]
    out = {r["id"]: r["region"] for r in S.kmeans(spark.createDataFrame(rows, "id long, embedding array<double>"), 4, 2).collect()}
    assert out == {k: k // 10 for k in range(40)}


def test_greedy_and_pursuit(nodes, edges):
    assert S.voyage(nodes, edges, 1, 3) == [1, 3]
    assert S.compose(nodes, [2.0, 0, 0, 0], 1) == [(1, 2.0)]
    pairs, mean = R.align_metaphor(nodes.where("id in (1, 3)"), nodes.where("id in (2, 4)"), edges)
    assert sorted((a, b) for a, b, _ in pairs) == [(1, 2), (3, 4)] and 0 < mean < 1.2


def test_semantic_routes(nodes, edges):
    row = S.semantic_path(nodes, edges, 1, 3).first()
    assert row["path"][0] == 1 and row["path"][-1] == 3
    focus = S.focused_path(nodes, edges, 1, 3, [1.0, 0, 0, 0]).first()
    assert focus["path"] == [1, 3] and focus["cost"] == pytest.approx(1.001)
    assert S.scenic_route(nodes, edges, 1, 3, 3).first()["path"][-1] == 3
    assert S.tapestry(nodes, edges, [1, 2, 3]).first()["path"][:2] == [1, 2]


def test_gestalt_and_polygraph(nodes, edges):
    out = S.gestalt(nodes, [("a", edges, "b"), ("b", edges, "c")], {"a": ([1.0, 0, 0, 0], 0.99)}).select("a", "b", "c").collect()
    assert sorted(map(tuple, out)) == [(1, 2, 3), (1, 4, 3)]
    bad = D.polygraph(nodes, edges, {"KNOWS": ("high", 0.5)}).collect()
    assert sorted(r["eid"] for r in bad) == [2, 4, 5]


def test_sentinel_sets_rows_aside(nodes):
    good, bad = D.sentinel(nodes, [([0.0, 1, 0, 0], 0.9)], {"id": (1, 3)})
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and sorted(r["id"] for r in bad.collect()) == [3, 4]


def test_prism_drops_dependent_axes():
    base = C.gram_schmidt([("x", [2.0, 0]), ("y", [3.0, 0]), ("z", [1.0, 1])])
    assert [n for n, _ in base] == ["x", "z"] and base[1][1] == pytest.approx([0, 1])


def test_layout_is_repeatable(nodes, edges):
    a, b = (sorted(map(tuple, C.kaleidoscope(nodes, edges, 10).collect())) for _ in range(2))
    assert a == b and len(a) == 4


def test_investigate_is_greedy(spark):
    w = spark.createDataFrame([(1, k, t, t, "update", e) for k, (t, e) in enumerate([(1, "a"), (2, "b"), (3, "a"), (5, "c"), (50, "b"), (60, "c")])], "id long, version_id long, vf long, tf long, op string, kind string")
    out = H.investigate(w, [F.col("kind") == x for x in "abc"], 10).collect()
    assert [r["versions"] for r in out] == [[0, 1, 3]]


def test_synthesize():
    out = R.synthesize({"a": 1, "b": [0.0, 2], "c": "x"}, {"a": 3, "b": [2.0, 2], "d": 5}, {"a": "mean", "b": "lerp"})
    assert out == {"a": 2, "b": [1.0, 2.0], "c": "x", "d": 5}


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [2, 9]), ([], [1])], "got array<int>, want array<int>")
    out = df.select(EV.precision_at(F.col("got"), F.col("want"), 2), EV.recall_at(F.col("got"), F.col("want"), 3)).collect()
    assert [tuple(r) for r in out] == [(0.5, 0.5), (0.0, 0.0)]


def test_synonyms_merge(spark):
    n = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.01], "b"), (3, [0.0, 1.0], "c"), (4, [1.0, 0.02], "d")], "id long, embedding array<double>, name string")
    e = spark.createDataFrame([(0, 1, 2, "L"), (1, 2, 3, "L"), (2, 3, 2, "L"), (3, 2, 2, "L")], "eid long, src long, dst long, label string")
    pairs = S.synonyms(n, [1, 2, 3, 4], 0.9)
    assert pairs == [(1, 2)]  # 4 is left: its near ones are taken
    assert S.synonyms(n, [4, 2], 0.9) == [(2, 4)] and S.synonyms(n, [3], 0.9) == []
    kept, moved = S.merge_nodes(n, e, pairs)
    assert sorted((r["id"], r["name"]) for r in kept.collect()) == [(1, "b"), (3, "c"), (4, "d")]
    assert sorted((r["eid"], r["src"], r["dst"]) for r in moved.collect()) == [(1, 1, 3), (2, 3, 1), (3, 1, 1)]


def test_facet_search(spark):
    n = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    e = spark.createDataFrame([(k, 0, k, "L") for k in (1, 2, 3)], "eid long, src long, dst long, label string")
    assert [r["id"] for r in S.facet_search(0, n, e, 1, 1, 2, k=2).collect()] == [3]
    with pytest.raises(ValueError, match="of 2"):
        S.facet_search(0, n, e, 2, 1, 2, k=2)
