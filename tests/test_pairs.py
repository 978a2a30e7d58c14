"""Joins of pairs in blocks: every cell meets, ties as SQL has them, work dealt evenly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import vectors as V
from strataweave.operators import graph as G
from strataweave.operators import vector as VO


@pytest.fixture
def dealt(spark):
    """Partitions as they are dealt: AQE joins none."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_knn_join_meets_every_block(dealt, monkeypatch):
    monkeypatch.setattr(VO, "KNN_BLOCK", 16)
    # grid points, many of them repeated: scores tie and ids decide
    data = [(i, [float(i % 5 - 2), float(i % 3 - 1), float(i % 2)]) for i in range(60)]
    n = dealt.createDataFrame(data, "id long, embedding array<double>")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in VO.knn_join(n.withColumnRenamed("id", "qid"), n, 4).collect())
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b) or math.inf)
    want = []
    for i, q in data:
        near = sorted((-cos(q, e), j) for j, e in data if j != i)[:4]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_knn_kernel_agrees_with_columns(spark, monkeypatch, metric):
    """Tiles smaller than the table, zero vectors and equal ones: the same rows as a sort of all scores."""
    monkeypatch.setattr(VO, "KNN_TILE", 7)
    monkeypatch.setattr(VO, "KNN_STEP", 11)
    e = np.random.default_rng(3).integers(-1, 2, (50, 3)).astype(float)
    own = np.arange(50)[::-1].copy()
    r, c, s = VO._nearest(own, e, own, e, 6, metric)
    n = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(own, e)], "id long, embedding array<double>")
    pairs = n.alias("a").join(n.select(F.col("id").alias("other"), F.col("embedding").alias("v")), F.col("id") != F.col("other"))
    scores = {(x["id"], x["other"]): x["s"] for x in pairs.select("id", "other", V.similarity(F.col("embedding"), F.col("v"), metric).alias("s")).collect()}
    for i in own:
        mine = [round(x, 9) for x, q in zip(s, own[r]) if q == i]
        assert mine == sorted((round(x, 9) for (q, _), x in scores.items() if q == i), reverse=True)[:6]
    assert all(scores[int(own[a]), int(own[b])] == pytest.approx(x) for a, b, x in zip(r, c, s))


def test_knn_blocks_do_not_grow_with_the_vectors():
    """What is shuffled is each side once per block of the other: no more blocks for ten times the vectors, and none too large."""
    assert VO._blocks(60_000, 64) == VO._blocks(600_000, 64) == 16
    assert VO._blocks(100, 64) == VO._blocks(0, None) == 1
    assert all(n * d / VO._blocks(n, d) <= VO.KNN_VALUES for n in (10**6, 10**7) for d in (64, 1024))


@pytest.mark.parametrize("block", [4, 2048])
def test_property_join_deals_a_common_value(dealt, monkeypatch, block):
    """One value holds most rows: the pairs are whole, and no task makes more than a small part of them."""
    monkeypatch.setattr(G, "JOIN_BLOCK", block, raising=False)
    monkeypatch.setattr(G, "JOIN_PAIRS", block, raising=False)
    a = [(i, None if i % 20 == 3 else i % 3 if i < 12 else 1, i % 7) for i in range(60)]
    b = [(i, 1 if i % 5 else 2, i % 4) for i in range(40)] + [(99, None, 0)]
    x, y = dealt.createDataFrame(a, "i long, k long, u int"), dealt.createDataFrame(b, "j long, l long, v int")
    got = G.property_join(x, y, [("k", "l")], F.col("u") > F.col("v"))
    assert got.columns == ["i", "k", "u", "j", "l", "v"]
    want = sorted((i, j) for i, k, u in a for j, m, v in b if k is not None and k == m and u > v)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    if block == 4:
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most * 2 < len(want)
