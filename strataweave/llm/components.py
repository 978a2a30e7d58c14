"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, spool

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a")).toDF("u", "v")


def _large_star(both: DataFrame, low: DataFrame) -> DataFrame:
    return both.join(low.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node that has a link to another; root is the smallest node.

    Minima are aggregated before they are joined back, from a table of their own, so
    that AQE can split a hub's links.  The driver sees one count and one checksum a round.
    """
    edges = spool(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = _both(edges)
        low = spool(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        last, edges = edges, spool(_small_star(_large_star(both, low).where("a <> b").distinct()).where("a <> b").distinct())
        release(last, low)
        r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (r["n"], r["x"]) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        before = (r["n"], r["x"])
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
