"""Reasoning over nodes, edges and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import vectors as V
from ...model import both_ways
from ...scratch import cut
from .. import graph as G
from ..vector import knn, top
from .diagnostics import wormholes

#: Nodes of a subgraph that the driver maps by itself.
MAX_SUBGRAPH = 300


def crystallize(nodes: DataFrame, edges: DataFrame, threshold: float, k: int = 10, max_hops: int = 2) -> DataFrame:
    """Wormholes as new edges (src, dst, label, similarity)."""
    w = wormholes(nodes, edges, k, threshold, max_hops)
    return w.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CRYSTALLIZED").alias("label"), "similarity")


def synthesize(a: dict, b: dict, strategies: dict[str, str], alpha: float = 0.5) -> dict:
    """The properties of a node made of two: keep_a (default), keep_b, mean, sum, min, max, concat or lerp by key."""
    out = {}
    for key in {**a, **b}:
        x, y = a.get(key), b.get(key)
        if x is None or y is None:
            out[key] = y if x is None else x
            continue
        how = strategies.get(key, "keep_a")
        pick = {
            "keep_a": lambda: x, "keep_b": lambda: y, "mean": lambda: (x + y) / 2, "sum": lambda: x + y, "min": lambda: min(x, y),
            "max": lambda: max(x, y), "concat": lambda: f"{x}{y}",
            "lerp": lambda: [p + (q - p) * alpha for p, q in zip(x, y)] if isinstance(x, list) else x + (y - x) * alpha,
        }
        out[key] = pick[how]()
    return out


def predicted_vectors(versions: DataFrame, horizon_us: int) -> DataFrame:
    """(id, predicted): the last vector moved on by the mean velocity since the first."""
    ends = versions.groupBy("id").agg(
        F.min_by(F.struct("vf", "embedding"), F.struct("vf", "version_id")).alias("a"), F.max_by(F.struct("vf", "embedding"), F.struct("vf", "version_id")).alias("b")
    )
    gap = F.col("b.vf") - F.col("a.vf")
    step = V.scale(V.subtract(F.col("b.embedding"), F.col("a.embedding")), F.when(gap > 0, F.lit(float(horizon_us)) / gap).otherwise(0.0))
    return ends.select("id", V.add(F.col("b.embedding"), step).alias("predicted"))


def overlay(nodes: DataFrame, added: DataFrame | None = None, removed: list[int] = ()) -> DataFrame:
    """nodes with some replaced or added and some removed, without touching the stored ones."""
    out = nodes
    if added is not None:
        out = out.join(added.select("id"), "id", "left_anti").unionByName(added)
    return out.where(~F.col("id").isin(*removed)) if removed else out


def overlay_edges(edges: DataFrame, added: DataFrame | None = None, removed: list[int] = (), removed_nodes: list[int] = ()) -> DataFrame:
    """edges with some added and some removed, and none at a removed node."""
    out = edges if added is None else edges.unionByName(added)
    out = out.where(~F.col("eid").isin(*removed)) if removed else out
    return out.where(~F.col("src").isin(*removed_nodes) & ~F.col("dst").isin(*removed_nodes)) if removed_nodes else out


def overlay_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """(id, change): nodes added, removed or modified between the stored nodes and an overlay."""
    rest = [c for c in base.columns if c != "id"]
    both = base.select("id", F.struct(*rest).alias("a")).join(other.select("id", F.struct(*rest).alias("b")), "id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("id", change.alias("change")).where("change is not null")


def core_of(nodes: DataFrame, by: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Centroid nodes by group, and CORE_OF edges from each to its members."""
    cores = nodes.groupBy(by).agg(V.array_mean("embedding", dimension).alias("embedding"))
    return cores, nodes.select(F.col(by).alias("src"), F.col("id").alias("dst"), F.lit("CORE_OF").alias("label"))


def align_metaphor(source: DataFrame, target: DataFrame, edges: DataFrame, structural_weight: float = 0.2) -> tuple[list[tuple[int, int, float]], float]:
    """Greedy mapping of two small stated subgraphs, of at most MAX_SUBGRAPH nodes each (checked): pairs with scores, and their mean."""

    def small(nodes: DataFrame) -> dict:
        rows = nodes.select("id", "embedding").limit(MAX_SUBGRAPH + 1).collect()
        if len(rows) > MAX_SUBGRAPH:
            raise ValueError(f"a subgraph has more than {MAX_SUBGRAPH} nodes")
        return {r["id"]: r["embedding"] for r in rows}

    a, b = small(source), small(target)
    links: dict[int, set[int]] = {}
    for r in both_ways(edges.select("src", "dst")).where(F.col("src").isin(*a, *b) & F.col("dst").isin(*a, *b)).collect():
        links.setdefault(r["src"], set()).add(r["dst"])

    def cos(x, y) -> float:
        if x is None or y is None:
            return 0.0
        n = (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
        return sum(p * q for p, q in zip(x, y)) / n if n > V.TINY else 0.0

    score = {(i, j): cos(a[i], b[j]) for i in a for j in b}
    out = []
    while score:
        (i, j), s = max(score.items(), key=lambda kv: (kv[1], -kv[0][0], -kv[0][1]))
        out.append((i, j, s))
        score = {(x, y): v for (x, y), v in score.items() if x != i and y != j}
        for x, y in score:
            if x in links.get(i, ()) and y in links.get(j, ()):
                score[x, y] += structural_weight
    return out, sum(s for *_, s in out) / max(1, len(out))


def inspire(nodes: DataFrame, seeds: list[int], dimension: int) -> DataFrame:
    """(novelty, coherence) of the seeds' normalised centroid: 1 - its best similarity to other nodes, and its mean to the seeds."""
    own = nodes.where(F.col("id").isin(*seeds))
    centre = own.agg(V.normalize(V.array_mean("embedding", dimension)).alias("c"))  # one row
    other = nodes.where(~F.col("id").isin(*seeds)).join(F.broadcast(centre)).agg(F.max(V.cosine(F.col("embedding"), F.col("c"))).alias("m"))
    near = own.join(F.broadcast(centre)).agg(F.avg(V.cosine(F.col("embedding"), F.col("c"))).alias("coherence"))
    return other.join(F.broadcast(near)).select((1 - F.greatest(F.lit(0.0), "m")).alias("novelty"), "coherence")


def encounter(rows: DataFrame) -> DataFrame:
    """rows: a0, a1, b0, b1 (vectors a step apart).  t of least distance on straight courses, the distance, and whether it is past."""
    p, v = V.subtract(F.col("a1"), F.col("b1")), V.subtract(V.subtract(F.col("a1"), F.col("a0")), V.subtract(F.col("b1"), F.col("b0")))
    rows = rows.withColumns({"_p": p, "_v": v})
    vv = V.dot(F.col("_v"), F.col("_v"))
    t = F.when(vv < 1e-9, 0.0).otherwise(-V.dot(F.col("_p"), F.col("_v")) / vv)
    rows = rows.withColumn("t", t)
    return rows.withColumns({"distance": V.magnitude(V.add(F.col("_p"), V.scale(F.col("_v"), F.col("t")))), "is_past": F.col("t") < 0}).drop("_p", "_v")


def personalized_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, rank): personalised PageRank by power iteration; what dangling nodes hold returns to the seeds.
    seeds: id.  Deterministic, where sampling walks would not be."""
    n = seeds.select("id").distinct().count()
    start = seeds.select("id").distinct().withColumn("p", F.lit(1.0 / max(1, n)))
    hops = edges.select("src", "dst").distinct()
    hops = hops.join(hops.groupBy("src").agg(F.count("*").alias("deg")), "src")
    rank = start.select("id", F.col("p").alias("rank"))
    for k in range(rounds):
        passed = rank.join(hops, F.col("id") == F.col("src"))
        flow = passed.groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("rank") / F.col("deg"))).alias("rank"))
        moved = flow.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("m"))
        back = start.join(F.broadcast(moved)).select("id", (F.col("p") * (1 - F.col("m"))).alias("rank"))  # m: one row
        rank = flow.union(back).groupBy("id").agg(F.sum("rank").alias("rank"))
        if k % 2 == 1:
            rank = cut(rank)
    return rank


def reachability(edges: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """pairs: a, b -> with reachable."""
    reach = G.traverse(pairs.select(F.col("a").alias("anchor")), edges, "out", 1, max_hops).select(F.col("anchor").alias("a"), F.col("id").alias("b"), F.lit(True).alias("r"))
    return pairs.join(reach, ["a", "b"], "left").select("a", "b", F.coalesce("r", F.lit(False)).alias("reachable"))


def predict_links(nodes: DataFrame, edges: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(a, b, score): Adamic-Adar over shared undirected neighbours times 1 + cosine (0 without a vector),
    for pairs two hops apart that are not linked.  A hub's pairs are what is asked for; anchors: id narrows them."""
    hops = both_ways(edges.select("src", "dst")).where("src <> dst").distinct()
    deg = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("deg")).where("deg > 1")
    first = hops.select(F.col("src").alias("a"), F.col("dst").alias("mid"))
    if anchors is not None:
        first = first.join(anchors.select(F.col("id").alias("a")).distinct(), "a")
    two = first.join(deg, "mid").join(hops.select(F.col("src").alias("mid"), F.col("dst").alias("b")), "mid").where("a <> b")
    aa = two.groupBy("a", "b").agg(F.sum(1 / F.log("deg")).alias("aa")).join(hops.toDF("a", "b"), ["a", "b"], "left_anti")
    va = nodes.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    vb = nodes.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    j = aa.join(va, "a", "left").join(vb, "b", "left")
    s = F.coalesce(F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), V.cosine(F.col("va"), F.col("vb"))), F.lit(0.0))
    return j.select("a", "b", (F.col("aa") * (1 + s)).alias("score")).where("score > 0")


def synergy(members: DataFrame, edges: DataFrame, dimension: int) -> DataFrame:
    """(synergy): 1 - cosine of the plain mean and the mean of vectors half mixed with their in-set neighbours'."""
    hops = both_ways(edges.select("src", "dst")).where("src <> dst").distinct()
    mean = hops.join(members.select(F.col("id").alias("dst"), "embedding"), "dst").groupBy(F.col("src").alias("id")).agg(V.array_mean("embedding", dimension).alias("m"))
    mixed = members.join(mean, "id", "left").select(F.col("embedding"), F.when(F.col("m").isNull(), F.col("embedding").cast("array<double>")).otherwise(V.add(V.scale(F.col("embedding"), 0.5), V.scale(F.col("m"), 0.5))).alias("x"))
    both = mixed.agg(V.array_mean("embedding", dimension).alias("p"), V.array_mean("x", dimension).alias("q"))
    return both.select((1 - V.cosine(F.col("p"), F.col("q"))).alias("synergy"))


def nearest_future(versions: DataFrame, nodes: DataFrame, entity: int, horizon_us: int, k: int = 5) -> DataFrame:
    row = predicted_vectors(versions.where(F.col("id") == entity), horizon_us).first()
    return knn(nodes, [float(x) for x in row["predicted"]], k)
