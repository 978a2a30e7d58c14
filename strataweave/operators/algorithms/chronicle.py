"""Temporal analytics over histories (id, version_id, vf, tf, embedding or properties)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import vectors as V
from ...model import DELETE, RETRACT
from .. import graph as G
from .. import temporal as TP


def aura(versions: DataFrame, now: int, half_life_us: float, dimension: int) -> DataFrame:
    """(id, divergence): 1 - cosine of the current vector and the mean of all, weighted by 0.5 ^ (age / half-life)."""
    weight = F.pow(F.lit(0.5), (F.lit(now) - F.col("vf")) / half_life_us)
    rows = versions.where(F.col("vf") <= now).select("id", "vf", "version_id", "embedding", V.scale(F.col("embedding"), weight).alias("x"))
    out = rows.groupBy("id").agg(V.array_mean("x", dimension).alias("m"), F.max_by("embedding", F.struct("vf", "version_id")).alias("last"))
    return out.select("id", (1 - V.cosine(F.col("last"), V.normalize(F.col("m")))).alias("divergence"))


def volatility(writes: DataFrame, start: int, end: int) -> DataFrame:
    """(id, versions, volatility): writes in [start, end), and per second."""
    n = writes.where((F.col("vf") >= start) & (F.col("vf") < end)).groupBy("id").agg(F.count("*").alias("versions"))
    return n.withColumn("volatility", F.col("versions") / ((end - start) / 1e6))


def stability(writes: DataFrame, start: int, end: int, tx: int = TP.OPEN) -> DataFrame:
    """(id, stability): the share of [start, end) over which the entity was believed to exist."""
    s = TP.between(writes, start, end, tx)
    held = F.least("valid_to", F.lit(end)) - F.greatest("vf", F.lit(start))
    return s.groupBy("id").agg((F.sum(held) / (end - start)).alias("stability"))


def path_at(edge_writes: DataFrame, start: int, goal: int, valid: int, tx: int = TP.OPEN) -> DataFrame:
    """The shortest path over the edges visible at (valid, tx); edge_writes carry src and dst."""
    e = TP.as_of(edge_writes, valid, tx).select(F.col("id").alias("eid"), "src", "dst")
    anchor = e.sparkSession.createDataFrame([(start,)], "anchor long")
    return G.traverse(anchor, e, "out", 1, None, with_path=True).where(F.col("id") == goal).select("path", "depth")


def echo(writes: DataFrame, bins: int = 60, bin_us: int = 60_000_000) -> DataFrame:
    """(id, bins): activity histogram of unit length."""
    b = writes.groupBy("id", F.pmod(F.floor(F.col("vf") / bin_us), F.lit(bins)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    filled = b.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.get(F.array(F.try_element_at("m", k)), F.lit(0)), F.lit(0)).cast("double"))
    return filled.select("id", V.normalize(hist).alias("bins"))


def resonance(echoes: DataFrame, entity: int) -> DataFrame:
    """(id, resonance): dot product of each activity histogram with one entity's."""
    q = echoes.where(F.col("id") == entity).select(F.col("bins").alias("q")).limit(1)
    return echoes.where(F.col("id") != entity).join(F.broadcast(q)).select("id", V.dot(F.col("bins"), F.col("q")).alias("resonance"))


def investigate(writes: DataFrame, clues: list[Column], window_us: int) -> DataFrame:
    """(id, versions): from each write matching the first clue, greedily the next later write matching each further
    clue, all within window_us of the first.

    Each clue is one window: the next match after a write is carried backward, then looked up by equality.
    """
    rows = writes.select("id", "version_id", "vf", *[F.coalesce(c, F.lit(False)).alias(f"c{k}") for k, c in enumerate(clues)])
    order = Window.partitionBy("id").orderBy("vf", "version_id")
    # next match of clue k strictly later in time
    # read backward, the frame only grows
    later = Window.partitionBy("id").orderBy(F.desc("vf")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = [F.min(F.when(F.col(f"c{k}"), F.struct("vf", "version_id"))).over(later).alias(f"n{k}") for k in range(1, len(clues))]
    step = rows.select("id", "version_id", "vf", "c0", *nxt)
    out = step.where("c0").select("id", F.col("vf").alias("t0"), F.array("version_id").alias("versions"), *([F.col("n1").alias("at")] if nxt else []))
    for k in range(1, len(clues)):
        hit = out.where(F.col("at").isNotNull() & (F.col("at.vf") - F.col("t0") <= window_us))
        nx = [F.col(f"n{k + 1}").alias("nx")] if k + 1 < len(clues) else []
        look = step.select("id", F.col("version_id").alias("v"), *nx)
        hit = hit.withColumn("v", F.col("at.version_id")).join(look, ["id", "v"])
        out = hit.select("id", "t0", F.concat("versions", F.array("v")).alias("versions"), *([F.col("nx").alias("at")] if nx else []))
    del order
    return out.select("id", "versions")


def narrative(writes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, line): each change of each write in words, in order."""
    d = TP.version_diffs(writes, columns)
    line = F.format_string("v%d: %s %s from %s to %s", "version_number", "key", "change", F.coalesce("old", F.lit("-")), F.coalesce("new", F.lit("-")))
    return d.select("id", "version_number", "key", line.alias("line"))


def drift_alarms(versions: DataFrame, now: int, window_us: int, theta: float, distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, distance): entities whose vector at now lies strictly further than theta from that at now - window, as recorded then."""
    live = versions.withColumn("op", F.lit("update")) if "op" not in versions.columns else versions
    new = TP.as_of(live, TP.OPEN, now).select("id", F.col("embedding").alias("a"))
    old = TP.as_of(live, TP.OPEN, now - window_us).select("id", F.col("embedding").alias("b"))
    d = (distance or (lambda a, b: 1 - V.cosine(a, b)))(F.col("a"), F.col("b"))
    return new.join(old, "id").select("id", d.alias("distance")).where(F.col("distance") > theta)


def open_alarms(fired: DataFrame, unresolved: DataFrame) -> DataFrame:
    """New alarms only: an entity with an unresolved one stays silent."""
    return fired.join(unresolved.select("id"), "id", "left_anti")


def weave(nodes: DataFrame, edges: DataFrame, start: int, goal: int, max_hops: int = 6) -> DataFrame:
    """(path, cost): from start to goal through edges at cost 1 each, forward in time (nodes: id, vf)."""
    t = nodes.select("id", "vf")
    hops = edges.select("src", "dst").distinct().join(t.toDF("src", "ts"), "src").join(t.toDF("dst", "td"), "dst").where("td >= ts")
    best = G.shortest_costs(nodes.sparkSession.createDataFrame([(start,)], "anchor long"), hops.select("src", "dst", F.lit(1.0).alias("cost")), max_hops)
    return best.where(F.col("id") == goal).select("path", "cost")


def live(writes: DataFrame) -> DataFrame:
    return writes.where(~F.col("op").isin(RETRACT, DELETE))
