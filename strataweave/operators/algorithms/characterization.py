"""Characterization of nodes and groups, and exports of neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import vectors as V
from ...model import both_ways
from .. import graph as G
from .semantic import edge_costs


def archetypes(nodes: DataFrame, by: str, dimension: int) -> DataFrame:
    """(id, by, purity): (1 + cosine to the group's centroid) / 2."""
    c = nodes.groupBy(by).agg(V.array_mean("embedding", dimension).alias("c"))
    return nodes.join(c, by).select("id", by, ((1 + V.cosine(F.col("embedding"), F.col("c"))) / 2).alias("purity"))


def orbit(before: DataFrame, after: DataFrame, edges: DataFrame, centre: int, seconds: float) -> DataFrame:
    """(id, velocity): change of cosine distance to the centre per second, for its out-neighbours at the end."""
    near = edges.where(F.col("src") == centre).select(F.col("dst").alias("id")).distinct()

    def distance(nodes: DataFrame, name: str) -> DataFrame:
        c = nodes.where(F.col("id") == centre).select(F.col("embedding").alias("c")).limit(1)
        return nodes.join(near, "id").join(F.broadcast(c)).select("id", (1 - V.cosine(F.col("embedding"), F.col("c"))).alias(name))

    return distance(before, "a").join(distance(after, "b"), "id").select("id", ((F.col("b") - F.col("a")) / seconds).alias("velocity"))


def pull(nodes: DataFrame, centre: list[float], step: float, mass: float) -> DataFrame:
    """(id, embedding): each vector moved towards the centre by step * mass / (d^2 + 0.1) and set to unit length."""
    d = F.greatest(F.lit(1e-4), V.euclidean(F.col("embedding"), centre))
    force = step * mass / (d * d + 0.1) / d
    moved = V.add(F.col("embedding"), V.scale(V.subtract(F.lit([float(x) for x in centre]), F.col("embedding")), force))
    return nodes.select("id", V.normalize(moved).alias("embedding"))


def gram_schmidt(axes: list[tuple[str, list[float]]]) -> list[tuple[str, list[float]]]:
    """Orthonormal axes in order; those that nothing is left of are dropped."""
    out: list[tuple[str, list[float]]] = []
    for name, v in axes:
        rest = [float(x) for x in v]
        for _, u in out:
            along = sum(a * b for a, b in zip(rest, u))
            rest = [a - along * b for a, b in zip(rest, u)]
        size = sum(a * a for a in rest) ** 0.5
        if size > 1e-6:
            out.append((name, [a / size for a in rest]))
    return out


def prism(nodes: DataFrame, axes: list[tuple[str, list[float]]]) -> DataFrame:
    """Per node its coordinate on each orthonormal axis, and the length of what the axes leave."""
    base = gram_schmidt(axes)
    spectrum = [V.dot(F.col("embedding"), u).alias(name) for name, u in base]
    caught = sum((F.col(name) * F.col(name) for name, _ in base), F.lit(0.0))
    rows = nodes.select("id", V.magnitude_squared(F.col("embedding")).alias("_m"), *spectrum)
    return rows.select("id", *[n for n, _ in base], F.sqrt(F.greatest(F.lit(0.0), F.col("_m") - caught)).alias("residual"))


def propagate(nodes: DataFrame, edges: DataFrame, dimension: int, alpha: float | Column, steps: int = 1) -> DataFrame:
    """(id, embedding): x' = (1 - a) x + a * mean of the in-neighbours, steps times; a may be a column of nodes."""
    hops = edges.select("src", "dst").distinct()
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    rows = nodes.select("id", F.col("embedding").cast("array<double>").alias("embedding"), a.alias("a"))
    for _ in range(steps):
        mean = hops.join(rows.select(F.col("id").alias("src"), "embedding"), "src").groupBy(F.col("dst").alias("id")).agg(V.array_mean("embedding", dimension).alias("m"))
        moved = V.add(V.scale(F.col("embedding"), 1 - F.col("a")), V.scale(F.col("m"), F.col("a")))
        rows = rows.join(mean, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("embedding")).otherwise(moved).alias("embedding"), "a")
    return rows.select("id", "embedding")


def wildfire_rate(base: float, factor: float, temperature: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + factor * F.coalesce(F.col(temperature), F.lit(0.0))))


def synapse_costs(nodes: DataFrame, edges: DataFrame, usage: DataFrame) -> DataFrame:
    """(src, dst, cost): 1 - cosine, 0.001 at least, cheaper by use; usage: src, dst, uses."""
    c = edge_costs(nodes, edges).join(usage, ["src", "dst"], "left")
    return c.select("src", "dst", (F.greatest(F.lit(0.001), F.col("cost")) / (1 + F.log2(1 + F.coalesce("uses", F.lit(0))))).alias("cost"))


def decayed(usage: DataFrame, factor: float) -> DataFrame:
    return usage.withColumn("uses", F.floor(F.col("uses") * factor))


def kaleidoscope(nodes: DataFrame, edges: DataFrame, rounds: int = 50, size: float = 100.0) -> DataFrame:
    """(id, x, y): a force layout of one small neighbourhood (checked: 2,000 nodes at most), seeded by id."""
    import numpy as np

    ids = sorted(r["id"] for r in nodes.select("id").limit(2001).collect())
    if len(ids) > 2000:
        raise ValueError("a layout holds 2,000 nodes at most")
    at = {v: k for k, v in enumerate(ids)}
    linked = [(at[r["src"]], at[r["dst"]]) for r in edges.select("src", "dst").where(F.col("src").isin(ids) & F.col("dst").isin(ids)).collect()]
    state, pos = 12345, np.zeros((len(ids), 2))
    for k in range(len(ids)):
        for axis in (0, 1):
            state = (state * 1103515245 + 12345) % 2**31
            pos[k, axis] = state / 2**31 * size
    want = size / max(1.0, len(ids) ** 0.5)
    for r in range(rounds):
        gap = pos[:, None] - pos[None]
        d = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
        push = (gap / d[..., None] * (want * want / d)[..., None]).sum(1)
        for a, b in linked:
            step = (pos[b] - pos[a]) * d[a, b] / want * 0.1
            push[a] += step
            push[b] -= step
        length = np.maximum(np.linalg.norm(push, axis=1, keepdims=True), 1e-9)
        pos += push / length * np.minimum(length, size / 10 * (1 - r / rounds))
    return nodes.sparkSession.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, pos)], "id long, x double, y double")


def ego(edges: DataFrame, centre: int, depth: int) -> DataFrame:
    """The edges among the nodes within depth hops, either way."""
    start = edges.sparkSession.createDataFrame([(centre,)], "anchor long")
    near = G.traverse(start, edges, "both", 0, depth).select("id")
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def mermaid(edges: DataFrame) -> DataFrame:
    """(line): a flow chart, a line per edge."""
    return edges.select(F.format_string("  n%d -->|%s| n%d", "src", "label", "dst").alias("line"))


def force_graph_json(edges: DataFrame) -> DataFrame:
    """(kind, json): node and link records."""
    nodes = both_ways(edges.select("src", "dst")).select(F.col("src").alias("id")).distinct()
    out = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id")).alias("json"))
    return out.union(edges.select(F.lit("link"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label"))))


def markdown_context(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """(id, markdown): per node a heading and its outgoing links."""
    w = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.format_string("- %s -> %d", "label", "dst"))).alias("l"))
    head = F.concat(F.lit("## "), F.col(title).cast("string"), F.lit("\n"))
    return nodes.join(w, "id", "left").select("id", F.concat(head, F.coalesce(F.array_join("l", "\n"), F.lit(""))).alias("markdown"))


def rank_within(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
