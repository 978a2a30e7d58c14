"""Semantic search over nodes (id, embedding) and edges (eid, src, dst, label).

Similarity is cosine throughout; a dimension is passed where vectors are averaged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import vectors as V
from ...model import both_ways
from ...scratch import cut
from .. import graph as G
from ..vector import knn, knn_join, top

STEPS = 10


def _vec(nodes: DataFrame, name: str, column: str) -> DataFrame:
    return nodes.select(F.col("id").alias(name), F.col("embedding").alias(column))


def edge_costs(nodes: DataFrame, edges: DataFrame, missing: float = 1.0, extra: float = 0.0) -> DataFrame:
    """(src, dst, cost): 1 - cosine of the ends plus extra; missing where an end has no vector."""
    e = edges.select("src", "dst").distinct()
    j = e.join(_vec(nodes, "src", "va"), "src", "left").join(_vec(nodes, "dst", "vb"), "dst", "left")
    cost = F.when(F.col("va").isNull() | F.col("vb").isNull(), F.lit(missing)).otherwise(1 - V.cosine(F.col("va"), F.col("vb")))
    return j.select("src", "dst", (F.greatest(F.lit(0.0), cost) + extra).alias("cost"))


def kmeans(nodes: DataFrame, k: int, dimension: int, max_rounds: int = 100) -> DataFrame:
    """(id, region): Lloyd's rounds from the rows at i * (n // k) in id order, squared L2, until nothing changes.

    Centroids are k rows; a round is one aggregation with partial sums per task.
    """
    n = nodes.count()
    if n == 0 or k < 1:
        return nodes.select("id", F.lit(0).alias("region")).limit(0)
    step = max(1, n // k)
    # exact row numbers by range-partitioned offsets, not one global window
    ordered = cut(nodes.select("id", "embedding").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    base, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p] = base - (p << 33)
        base += sizes[p]
    lookup = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    starts = [i * step for i in range(min(k, n))]
    seeds = ordered.withColumn("row", F.col("at") + lookup[part]).where(F.col("row").isin(starts)).orderBy("row").select("embedding").collect()
    centroids = [[float(x) for x in r["embedding"]] for r in seeds]
    last = None
    for _ in range(max_rounds):
        d = F.array(*[F.struct(V.euclidean_squared(F.col("embedding"), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
        placed = ordered.select("id", "embedding", F.array_min(d)["i"].alias("region"))
        sums = placed.groupBy("region").agg(V.array_mean("embedding", dimension).alias("c"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.count("*").alias("n")).collect()
        now = sorted((r["region"], r["x"], r["n"]) for r in sums)
        if now == last:
            break
        last = now
        for r in sums:
            centroids[r["region"]] = list(r["c"])
    return placed.select("id", "region")


def reify_regions(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region nodes and the LOCATED_IN edges to them."""
    regions = placed.groupBy("region").agg(F.count("*").alias("members"))
    return regions, placed.select(F.col("id").alias("src"), F.col("region").alias("dst"), F.lit("LOCATED_IN").alias("label"))


def facets(node_id: int, nodes: DataFrame, edges: DataFrame, k: int, dimension: int, exemplars: int = 3) -> DataFrame:
    """(region, weight, exemplars, centre): clusters of a node's out-neighbours, with the members nearest to each centre."""
    near = edges.where(F.col("src") == node_id).select(F.col("dst").alias("id")).distinct()
    own = nodes.join(near, "id")
    placed = kmeans(own, k, dimension).join(own, "id")
    centres = placed.groupBy("region").agg(V.array_mean("embedding", dimension).alias("c"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # k rows
    ranked = placed.join(centres, "region").withColumn("d", V.euclidean_squared(F.col("embedding"), F.col("c")))
    w = Window.partitionBy("region").orderBy("d", "id")
    best = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= exemplars).groupBy("region").agg(F.sort_array(F.collect_list("id")).alias("exemplars"))
    return centres.withColumn("weight", F.col("n") / total).join(best, "region").select("region", "weight", "exemplars", F.col("c").alias("centre"))


def facet_search(node_id: int, nodes: DataFrame, edges: DataFrame, facet: int, limit: int, dimension: int, k: int = 5) -> DataFrame:
    """k-NN of the centre of a node's facet, counted from the heaviest (0)."""
    found = facets(node_id, nodes, edges, k, dimension).orderBy(F.desc("weight"), "region").select("centre").collect()  # k rows
    if not 0 <= facet < len(found):
        raise ValueError(f"facet {facet} of {len(found)}")
    return knn(nodes, list(found[facet]["centre"]), limit)


def concept(nodes: DataFrame, plus: list[int], minus: list[int] = (), k: int = 10, mean: bool = False) -> DataFrame:
    """k-NN of a sum of vectors less others (analogy: a - b + c), or of their mean; the operands are left out."""
    wanted = [*plus, *minus]
    rows = {r["id"]: r["embedding"] for r in nodes.where(F.col("id").isin(*wanted)).collect()}
    size = len(next(iter(rows.values())))
    v = [sum(rows[i][d] for i in plus) - sum(rows[i][d] for i in minus) for d in range(size)]
    if mean:
        v = [x / len(plus) for x in v]
    return knn(nodes.where(~F.col("id").isin(*wanted)), v, k)


def cast_rod(nodes: DataFrame, edges: DataFrame, query: list[float], k: int, vector_weight: float = 0.7, graph_weight: float = 0.3, depth: int = 1) -> DataFrame:
    """(id, score): hits score by similarity, and pass graph_weight to each node that they link to."""
    hits = knn(nodes, query, k).select("id", (vector_weight * F.col("score")).alias("score"))
    if depth < 1:
        return hits
    links = hits.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(graph_weight).alias("score"))
    return hits.union(links).groupBy("id").agg(F.sum("score").alias("score"))


def gestalt(nodes: DataFrame, hops: list[tuple[str, DataFrame, str]], wanted: dict[str, tuple[list[float], float]]) -> DataFrame:
    """Pattern matches whose variables are distinct nodes and reach the wanted similarity: {variable: (vector, threshold)}."""
    out = G.match_pattern(hops)
    names = sorted({v for a, _, b in hops for v in (a, b)})
    for i, a in enumerate(names):
        for b in names[:i]:
            out = out.where(F.col(a) != F.col(b))
    for name, (vector, threshold) in wanted.items():
        fit = _vec(nodes, name, "_e").withColumn(f"{name}_score", V.cosine(F.col("_e"), vector)).where(F.col(f"{name}_score") >= threshold)
        out = out.join(fit.drop("_e"), name)
    return out


def duplicates_of(nodes: DataFrame, node_id: int, threshold: float, k: int = 10) -> DataFrame:
    from ..vector import similar_to

    return similar_to(nodes, node_id, k).where(F.col("score") >= threshold)


def merge_nodes(nodes: DataFrame, edges: DataFrame, pairs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after merging stated pairs (survivor, victim), in which no victim is a survivor.

    A survivor takes the properties that it lacks from its victim of the smallest id; edges move to
    the survivor, and those between the two go.
    """
    spark = nodes.sparkSession
    into = F.broadcast(spark.createDataFrame(pairs, "into long, victim long"))  # as many rows as were stated
    lost = nodes.join(into, F.col("id") == F.col("victim"))
    rest = [c for c in nodes.columns if c != "id"]
    given = lost.groupBy("into").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("victim"))).alias(f"_{c}") for c in rest])
    kept = nodes.join(into.select("victim"), F.col("id") == F.col("victim"), "left_anti").join(given, F.col("id") == F.col("into"), "left")
    kept = kept.select("id", *[F.coalesce(c, f"_{c}").alias(c) for c in rest])
    moved = edges
    for end in ("src", "dst"):
        at = into.select(F.col("into").alias(f"{end}_into"), F.col("victim").alias(f"{end}_victim"))
        moved = moved.join(at, F.col(end) == F.col(f"{end}_victim"), "left")
    ends = [F.coalesce(f"{end}_into", end) for end in ("src", "dst")]
    moved = moved.where((ends[0] != ends[1]) | (F.col("src") == F.col("dst")))
    return kept, moved.select(*[ends[("src", "dst").index(c)].alias(c) if c in ("src", "dst") else c for c in edges.columns])


def synonyms(nodes: DataFrame, candidates: list[int], threshold: float, k: int = 5) -> list[tuple[int, int]]:
    """Pairs (survivor, victim) to merge: each candidate in turn takes its most similar free candidate among its k
    nearest nodes, where that is similar enough; the smaller id survives.  At most k rows a stated candidate are read."""
    asked = nodes.where(F.col("id").isin(*candidates)).select(F.col("id").alias("qid"), "embedding")
    near: dict[int, list[int]] = {}
    found = knn_join(asked, nodes, k + 1).where((F.col("id") != F.col("qid")) & (F.col("score") >= threshold))
    for r in found.orderBy("qid", F.desc("score"), "id").collect():
        near.setdefault(r["qid"], []).append(r["id"])
    wanted, taken, out = set(candidates), set(), []
    for a in candidates:
        b = next((x for x in near.get(a, [])[:k] if x in wanted and x not in taken), None)
        if a not in taken and b is not None:
            taken |= {a, b}
            out.append((min(a, b), max(a, b)))
    return out


def horizon(seed: int, nodes: DataFrame, edges: DataFrame, threshold: float, max_depth: int = STEPS) -> DataFrame:
    """(id, inside, depth): breadth-first in both directions through nodes at least as similar to the seed; the first others are the horizon."""
    source = nodes.where(F.col("id") == seed).select(F.col("embedding").alias("q")).limit(1)
    scored = nodes.join(F.broadcast(source)).select("id", (V.cosine(F.col("embedding"), F.col("q")) >= threshold).alias("inside"))
    hops = both_ways(edges.select("src", "dst")).distinct()
    seen = frontier = scored.where(F.col("id") == seed).select("id", F.lit(True).alias("inside"), F.lit(0).alias("depth"))
    for d in range(1, max_depth + 1):
        step = frontier.where("inside").join(hops, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").join(scored, "id").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("id", "inside", "depth"))
    return seen


def telepathy(seed: int, nodes: DataFrame, edges: DataFrame, decay: float = 0.8, threshold: float = 0.01, steps: int = 3, missing: float = 0.1) -> DataFrame:
    """(id, signal): the strongest product of decayed similarities along any out-path of at most steps hops."""
    e = edges.select("src", "dst").distinct().join(_vec(nodes, "src", "va"), "src", "left").join(_vec(nodes, "dst", "vb"), "dst", "left")
    weight = F.when(F.col("va").isNull() | F.col("vb").isNull(), F.lit(missing)).otherwise(F.greatest(F.lit(0.0), V.cosine(F.col("va"), F.col("vb"))))
    hops = e.select("src", "dst", (weight * decay).alias("w"))
    best = nodes.where(F.col("id") == seed).select("id", F.lit(1.0).alias("signal"))
    for _ in range(steps):
        step = best.join(hops, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("signal") * F.col("w")).alias("signal"))
        best = best.union(step.where(F.col("signal") >= threshold)).groupBy("id").agg(F.max("signal").alias("signal"))
    return best.where(F.col("id") != seed)


def two_means(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, score): per node the distance of two clusters of its out-neighbours over their spread.

    Members are ordered by id; the first and the one farthest from it are the seeds.
    The neighbours of one node are one group; a group is clustered in Arrow batches.
    """
    import numpy as np
    import pandas as pd

    near = edges.select("src", "dst").distinct().join(_vec(nodes, "dst", "embedding"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("other"), "embedding")

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("other")["embedding"].map(lambda v: np.asarray(v, float)))
        if len(x) < 2:
            return pd.DataFrame({"id": [key[0]], "score": [0.0]})
        c = np.stack([x[0], x[int(((x - x[0]) ** 2).sum(1).argmax())]])
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in (0, 1)])
            if np.allclose(new, c):
                break
            c = new
        gap = float(np.linalg.norm(c[0] - c[1]))
        spread = float(np.linalg.norm(x - c[own], axis=1).mean())
        return pd.DataFrame({"id": [key[0]], "score": [100.0 if spread < 1e-6 < gap else 0.0 if gap <= 1e-6 else gap / spread]})

    return near.groupBy("id").applyInPandas(score, "id long, score double")


def compose(nodes: DataFrame, target: list[float], parts: int = 3, candidates: int = 10) -> list[tuple[int, float]]:
    """Matching pursuit: ids and weights whose vectors add up to target, best first."""
    rest, out = list(target), []
    for _ in range(parts):
        found = [r for r in knn(nodes, rest, candidates).select("id", "embedding", "score").collect() if r["id"] not in {i for i, _ in out}]
        if not found or found[0]["score"] <= 0:
            break
        v = [float(x) for x in found[0]["embedding"]]
        w = sum(a * b for a, b in zip(rest, v)) / max(sum(a * a for a in v), V.TINY)
        out.append((found[0]["id"], w))
        rest = [a - w * b for a, b in zip(rest, v)]
    return out


def semantic_path(nodes: DataFrame, edges: DataFrame, start: int, goal: int, hop_cost: float = 0.0, max_hops: int | None = None) -> DataFrame:
    """(path, cost): the least sum of 1 - cosine (1 without a vector) plus hop_cost a hop."""
    spark = nodes.sparkSession
    best = G.shortest_costs(spark.createDataFrame([(start,)], "anchor long"), edge_costs(nodes, edges, 1.0, hop_cost), max_hops, goal)
    return best.where(F.col("id") == goal).select("path", "cost")


def focused_path(nodes: DataFrame, edges: DataFrame, start: int, goal: int, lens: list[float], max_hops: int | None = None) -> DataFrame:
    """(path, cost) where entering a node costs 1 - its focus on the lens + 0.001; without a vector the focus is -1."""
    focus = nodes.select(F.col("id").alias("dst"), V.cosine(F.col("embedding"), lens).alias("f"))
    hops = edges.select("src", "dst").distinct().join(focus, "dst", "left")
    hops = hops.select("src", "dst", (1 - F.coalesce("f", F.lit(-1.0)) + 0.001).alias("cost"))
    best = G.shortest_costs(nodes.sparkSession.createDataFrame([(start,)], "anchor long"), hops, max_hops, goal)
    return best.where(F.col("id") == goal).select("path", "cost")


def tapestry(nodes: DataFrame, edges: DataFrame, waypoints: list[int]) -> DataFrame:
    """(path, cost): least-cost paths from waypoint to waypoint, joined."""
    legs = [semantic_path(nodes, edges, a, b).toDF(f"p{k}", f"c{k}") for k, (a, b) in enumerate(zip(waypoints, waypoints[1:]))]
    joined = reduce(lambda x, y: x.join(y), legs)  # a row each
    tail = [F.slice(f"p{k}", 2, F.size(f"p{k}")) for k in range(1, len(legs))]
    return joined.select(F.concat("p0", *tail).alias("path"), reduce(lambda x, y: x + y, [F.col(f"c{k}") for k in range(len(legs))]).alias("cost"))


def scenic_route(nodes: DataFrame, edges: DataFrame, start: int, goal: int, max_depth: int) -> DataFrame:
    """(path, scenery): the simple out-path whose steps differ most in sum."""
    hops = edge_costs(nodes.where("embedding is not null"), edges, missing=-1.0).join(nodes.where("embedding is not null").select(F.col("id").alias("dst")), "dst")
    paths = nodes.where(F.col("id") == start).select(F.array("id").alias("path"), F.col("id").alias("at"), F.lit(0.0).alias("scenery"))
    done = paths.limit(0)
    for _ in range(max_depth):
        step = paths.join(hops, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("scenery") + F.greatest(F.lit(0.0), F.col("cost"))).alias("scenery"))
        done = done.union(paths.where(F.col("at") == goal))
        paths = paths.where(F.col("at") != goal)
    return top(done, 1, F.desc("scenery"), F.col("path")).select("path", "scenery")


def voyage(nodes: DataFrame, edges: DataFrame, start: int, steps: int) -> list[int]:
    """Greedy walk to the least similar neighbour not yet visited; one small join a step."""
    path = [start]
    costs = edge_costs(nodes, edges)
    for _ in range(steps):
        nxt = top(costs.where((F.col("src") == path[-1]) & ~F.col("dst").isin(*path)), 1, F.desc("cost"), F.col("dst")).first()
        if nxt is None:
            break
        path.append(nxt["dst"])
    return path
