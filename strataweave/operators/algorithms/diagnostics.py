"""Diagnostics over nodes (id, embedding), edges and histories (id, version_id, vf, tf, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import vectors as V
from ...model import both_ways
from .. import graph as G
from ..vector import knn_join


def _ends(nodes: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), F.col("embedding").alias("va"))
    b = nodes.select(F.col("id").alias("dst"), F.col("embedding").alias("vb"))
    return edges.select("src", "dst", *keep).join(a, "src").join(b, "dst")


def polygraph(nodes: DataFrame, edges: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """Edges that break their type's rule: ('high', t) wants similarity >= t, ('low', t) wants <= t."""
    s = _ends(nodes, edges, "eid", "label").withColumn("similarity", V.cosine(F.col("va"), F.col("vb")))
    broken: Column = F.lit(False)
    for label, (kind, t) in rules.items():
        miss = F.col("similarity") < t if kind == "high" else F.col("similarity") > t
        broken = broken | ((F.col("label") == label) & miss)
    return s.where(broken).select("eid", "label", "similarity")


def dissonance(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, dissonance): mean similarity of the k nearest by vector less that of the distinct neighbours by edge."""
    near = knn_join(nodes.select(F.col("id").alias("qid"), "embedding"), nodes, k).groupBy(F.col("qid").alias("id")).agg(F.avg("score").alias("semantic"))
    own = both_ways(edges.select("src", "dst")).where("src <> dst").distinct()
    linked = _ends(nodes, own).groupBy(F.col("src").alias("id")).agg(F.avg(V.cosine(F.col("va"), F.col("vb"))).alias("structural"))
    return near.join(linked, "id").select("id", (F.col("semantic") - F.col("structural")).alias("dissonance"))


def deltas(versions: DataFrame) -> DataFrame:
    """Changes between consecutive versions: (id, vf, tf, delta)."""
    w = Window.partitionBy("id").orderBy("vf", "version_id")
    rows = versions.withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    return rows.withColumn("delta", V.subtract(F.col("embedding"), F.col("before"))).drop("before")


def entanglement(versions: DataFrame, at: str = "tf") -> DataFrame:
    """(a, b, entanglement, n): mean cosine of the changes that two entities made at the same time; no change, no vote."""
    moved = deltas(versions).where(V.magnitude(F.col("delta")) > V.TINY)
    x = moved.select(F.col(at).alias("at"), F.col("id").alias("a"), F.col("delta").alias("da"))
    y = moved.select(F.col(at).alias("at"), F.col("id").alias("b"), F.col("delta").alias("db"))
    return x.join(y, "at").where("a < b").groupBy("a", "b").agg(F.avg(V.cosine(F.col("da"), F.col("db"))).alias("entanglement"), F.count("*").alias("n"))


def thermos(versions: DataFrame, start: int, end: int) -> DataFrame:
    """(id, travelled, rate): distance moved in [start, end), and per second."""
    w = Window.partitionBy("id").orderBy("vf", "version_id")
    rows = versions.where((F.col("vf") >= start) & (F.col("vf") < end)).withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    step = V.euclidean(F.col("embedding"), F.col("before"))
    return rows.groupBy("id").agg(F.sum(step).alias("travelled"), (F.sum(step) / ((end - start) / 1e6)).alias("rate"))


def tremor(before: DataFrame, after: DataFrame, dimension: int, by: str = "label") -> DataFrame:
    """(by, tremor): distance of a group's centroids at two coordinates (id, by, embedding)."""
    a = before.groupBy(by).agg(V.array_mean("embedding", dimension).alias("a"))
    b = after.groupBy(by).agg(V.array_mean("embedding", dimension).alias("b"))
    return a.join(b, by).select(by, V.euclidean(F.col("a"), F.col("b")).alias("tremor"))


def fossil(before: DataFrame, after: DataFrame, edges: DataFrame, dimension: int) -> DataFrame:
    """(id, fossil): how far a node's neighbourhood moved over how far it moved itself."""
    hops = edges.select("src", "dst").distinct()

    def context(nodes: DataFrame, name: str) -> DataFrame:
        j = hops.join(nodes.select(F.col("id").alias("dst"), "embedding"), "dst")
        return j.groupBy(F.col("src").alias("id")).agg(V.array_mean("embedding", dimension).alias(name))

    own = before.select("id", F.col("embedding").alias("a")).join(after.select("id", F.col("embedding").alias("b")), "id")
    j = own.join(context(before, "ca"), "id").join(context(after, "cb"), "id")
    return j.select("id", (V.euclidean(F.col("ca"), F.col("cb")) / (V.euclidean(F.col("a"), F.col("b")) + 1e-6)).alias("fossil"))


def paradox(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, paradox): clamp(-4 * change of similarity * change of affinity, -1, 1) of linked pairs.
    affinity: mean non-zero similarity of the source's other out-neighbours to the target."""
    hops = edges.select("src", "dst").distinct()

    def at(nodes: DataFrame, tag: str) -> DataFrame:
        pair = _ends(nodes, hops).select("src", "dst", "vb", V.cosine(F.col("va"), F.col("vb")).alias(f"s{tag}"))
        other = hops.select("src", F.col("dst").alias("n")).join(nodes.select(F.col("id").alias("n"), F.col("embedding").alias("vn")), "n")
        s = V.cosine(F.col("vn"), F.col("vb"))
        j = pair.join(other, "src").where("n <> dst").withColumn("x", s)
        affinity = F.coalesce(F.avg(F.when(F.col("x") != 0, F.col("x"))), F.lit(0.0))
        return j.groupBy("src", "dst").agg(F.first(f"s{tag}").alias(f"s{tag}"), affinity.alias(f"a{tag}"))

    j = at(before, "0").join(at(after, "1"), ["src", "dst"])
    value = -4 * (F.col("s1") - F.col("s0")) * (F.col("a1") - F.col("a0"))
    return j.select("src", "dst", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).alias("paradox"))


def flux(versions: DataFrame, bin_us: int) -> DataFrame:
    """(id, bin, flux): movement summed in bins of time."""
    moved = deltas(versions)
    return moved.groupBy("id", F.floor(F.col("vf") / bin_us).alias("bin")).agg(F.sum(V.magnitude(F.col("delta"))).alias("flux"))


def ripple(flux_a: DataFrame, flux_b: DataFrame, max_lag: int) -> DataFrame:
    """(lag, correlation): Pearson of two binned fluxes (bin, flux), b behind a by lag bins; empty bins are 0."""
    lags = flux_a.sparkSession.range(max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    span = flux_a.select("bin").union(flux_b.select("bin")).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    bins = span.select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    a = bins.join(flux_a.select("bin", F.col("flux").alias("x")), "bin", "left").join(F.broadcast(lags))  # max_lag + 1 rows
    shifted = a.withColumn("bb", F.col("bin") + F.col("lag"))
    b = bins.join(flux_b.select("bin", F.col("flux").alias("y")), "bin", "left").withColumnRenamed("bin", "bb")
    j = shifted.join(b, "bb").select("lag", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    cov = n * F.sum(F.col("x") * F.col("y")) - sx * sy
    spread = F.sqrt(F.greatest(F.lit(0.0), (n * F.sum(F.col("x") * F.col("x")) - sx * sx) * (n * F.sum(F.col("y") * F.col("y")) - sy * sy)))
    return j.groupBy("lag").agg(F.when(spread > V.TINY, cov / spread).otherwise(0.0).alias("correlation"))


def sentinel(rows: DataFrame, banned: list[tuple[list[float], float]] = (), ranges: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): rows near a banned vector or out of a column's range are set aside."""
    bad: Column = F.lit(False)
    for vector, threshold in banned:
        bad = bad | (F.col("embedding").isNotNull() & (V.cosine(F.col("embedding"), vector) >= threshold))
    for column, (low, high) in (ranges or {}).items():
        bad = bad | ~F.coalesce(F.col(column).between(low, high), F.lit(True))
    marked = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return marked.where(~F.col("_bad")).drop("_bad"), marked.where("_bad").drop("_bad")


def wormholes(nodes: DataFrame, edges: DataFrame, k: int, threshold: float, max_hops: int) -> DataFrame:
    """(a, b, similarity): near pairs by vector with no out-path of at most max_hops between them."""
    near = knn_join(nodes.select(F.col("id").alias("qid"), "embedding"), nodes, k).where(F.col("score") >= threshold)
    pairs = near.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"))
    reach = G.traverse(pairs.select(F.col("a").alias("anchor")), edges, "out", 1, max_hops)
    return pairs.join(reach.select(F.col("anchor").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_anti")
