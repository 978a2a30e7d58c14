"""Trust over lineages of every shape, against sets of ancestors walked by hand."""

import math

import pytest

from strataweave.operators import provenance as PV


@pytest.mark.parametrize("policy", ["weakest", "noisy_or"])
@pytest.mark.parametrize("links", [
    [(i, i // 2) for i in range(1, 50)],  # a tree
    [(i, i - 1) for i in range(1, 50)],  # a chain longer than the depth
    [(1, 2), (2, 3), (3, 1), (4, 3), (5, 5), (6, 70), (70, 7)],  # a cycle, a loop, a version without confidence
    [(9, 8), (9, 7), (8, 6), (7, 6)],  # two sources
])
def test_trust_of_each_shape(spark, policy, links):
    c = {i: None if i % 11 == 5 else (i * 37 % 101) / 101 for i in range(50)}
    got = PV.trust(spark.createDataFrame(list(c.items()), "version long, confidence double"), spark.createDataFrame(links, "derived long, source long"), policy, None)
    want = {}
    for v in c:
        seen = at = {v}
        for _ in range(PV.LINEAGE_DEPTH):
            at = {b for a, b in links if a in at} - seen
            seen = seen | at
        have = [c[x] for x in seen if c.get(x) is not None]
        want[v] = 0.5 if not have else min(have) if policy == "weakest" else 1 - math.prod(1 - x for x in have)
    rows = got.collect()
    assert len(rows) == len(c) and {r["version"]: r["trust"] for r in rows} == pytest.approx(want)


def test_trust_of_single_sources_takes_no_closure(spark, monkeypatch):
    monkeypatch.setattr(PV, "lineage_closure", None)
    c = spark.createDataFrame([(i, 0.5) for i in range(30)], "version long, confidence double")
    tree = spark.createDataFrame([(i, i // 2) for i in range(1, 30)], "derived long, source long")
    assert {r["trust"] for r in PV.trust(c, tree).collect()} == {0.5}
