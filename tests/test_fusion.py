"""Provenance-weighted fusion over more rows than one shortlist."""

from pyspark.sql import functions as F

from strataweave.operators import vector as VO


def test_fusion_reads_every_row(spark):
    """The best by confidence is the 3,000th by similarity."""
    rows = spark.range(3000).select("id", (1 - F.col("id") / 3000).alias("score"), F.when(F.col("id") == 2999, 100.0).otherwise(0.0).alias("confidence"), F.lit(0).cast("long").alias("recorded"))
    assert [r["id"] for r in VO.provenance_fusion(rows, 0, 2).collect()] == [2999, 0]


def test_freshness_of_what_is_recorded_later(spark):
    """Two half-lives ahead of now: 4 by the curve, 1 where the age stops at 0."""
    rows = spark.createDataFrame([(1, 0.0, 0.0, 20)], "id long, score double, confidence double, recorded long")
    fused = [VO.provenance_fusion(rows, 0, 1, (0.0, 0.0, 1.0), 10.0, ahead).first()["fused"] for ahead in (True, False)]
    assert [round(x, 9) for x in fused] == [4.0, 1.0]
