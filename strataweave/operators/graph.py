"""Graph operators: starts, scans, traversal, patterns, optional matches, ordering, sets."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..model import both_ways, flip
from ..scratch import cut

#: Depth of an unbounded traversal.
DEPTH_CAP = 10
#: Rows a side of a cell of property_join; pairs of equal values a task, and the most tasks.
JOIN_BLOCK, JOIN_PAIRS, JOIN_TASKS = 1024, 1 << 22, 4096
#: Hops after which the visited set's lineage is cut.
CUT_EVERY = 3


def start_nodes(nodes: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """The nodes of an id list, in list order (column pos); the list is the query's own, so it is broadcast."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} long, pos int")
    return nodes.join(F.broadcast(wanted), id_col).orderBy("pos")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    return {"out": lambda e: e, "in": flip, "both": both_ways}[direction](edges)


def expand(anchors: DataFrame, edges: DataFrame, direction: str = "out", id_col: str = "id") -> DataFrame:
    """One hop with the edge bound: a row per edge, parallel edges and self-loops included."""
    return anchors.join(directed(edges, direction), F.col(id_col) == F.col("src"))


def traverse(
    anchors: DataFrame,
    edges: DataFrame,
    direction: str = "out",
    min_depth: int = 1,
    max_depth: int | None = None,
    label: str | None = None,
    with_path: bool = False,
) -> DataFrame:
    """anchors: anchor.  Rows (anchor, id, depth[, path]): each node once per anchor, at its least depth.

    Breadth-first by joins: every hop drops what the anchor has seen, its start
    included.  path alternates node and edge ids; of equally short ones the least.
    """
    depth_limit = DEPTH_CAP if max_depth is None else max_depth
    hops = edges if label is None else edges.where(F.col("label") == label)
    hops = directed(hops.select("eid", "src", "dst"), direction).where("src <> dst")
    if not with_path:
        # one hop is made distinct once, by anchor; for several, parallel edges go first
        hops = hops.select("src", "dst") if depth_limit == 1 else hops.select("src", "dst").distinct()
    start = anchors.select("anchor").distinct()
    seen = start.select("anchor", F.col("anchor").alias("id"), F.lit(0).alias("depth"))
    if with_path:
        seen = seen.withColumn("path", F.array("id"))
    frontier = seen
    for depth in range(1, depth_limit + 1):
        step = frontier.join(hops, F.col("id") == F.col("src"))
        if with_path:
            step = step.groupBy("anchor", F.col("dst").alias("id")).agg(
                F.min(F.concat("path", F.array("eid", "dst"))).alias("path")
            )
        else:
            step = step.select("anchor", F.col("dst").alias("id")).distinct()
        if depth > 1:  # the first hop cannot meet its anchor: loops are out
            step = step.join(seen.select("anchor", "id"), ["anchor", "id"], "left_anti")
        frontier = step.withColumn("depth", F.lit(depth))
        if depth % CUT_EVERY == 0 and depth < depth_limit:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
        if depth % CUT_EVERY == 0 and depth < depth_limit:
            seen = cut(seen)
    return seen.where(F.col("depth").between(max(min_depth, 0 if min_depth == 0 else 1), depth_limit))


def optional_match(left: DataFrame, pattern: DataFrame, on: list[str]) -> DataFrame:
    """Left outer apply: pattern carries its own filters already, so they cannot drop left rows."""
    return left.join(pattern, on, "left")


def match_pattern(hops: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """A pattern of edges [(from variable, edges, to variable), ...] with each edge used once.

    Variables bind to columns of their name, edges to e0, e1, ...; shared variables are
    equi-joins, so only a pattern that falls apart is a product (refused).
    """
    out: DataFrame | None = None
    for k, (a, edges, b) in enumerate(hops):
        loop = a == b
        own = edges.where("src = dst") if loop else edges
        own = own.select(F.col("eid").alias(f"e{k}"), F.col("src").alias(a), *([] if loop else [F.col("dst").alias(b)]))
        if out is None:
            out = own
            continue
        shared = [c for c in own.columns if c in out.columns]
        if not shared:
            raise ValueError("the pattern's parts share no variable")
        out = out.join(own, shared)
        out = out.where(reduce(lambda x, y: x & y, [F.col(f"e{k}") != F.col(f"e{j}") for j in range(k)]))
    return out


def order_by(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """(column, descending) keys; nulls last when ascending, first when descending."""
    return df.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys])


def page(df: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    out = df.offset(skip) if skip else df
    return out if limit is None else out.limit(limit)


def distinct_entities(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.dropDuplicates([id_col])


def aggregate(df: DataFrame, keys: list[str], **aggregates: tuple) -> DataFrame:
    """name=(function, column or '*', distinct) with the engine's rules: an empty sum is 0, collect skips nulls."""
    out = []
    for name, (func, col, *rest) in aggregates.items():
        distinct = bool(rest and rest[0])
        if func == "count":
            agg = F.count("*") if col == "*" else F.count_distinct(F.col(col)) if distinct else F.count(col)
        elif func == "sum":
            agg = F.coalesce(F.sum_distinct(F.col(col)) if distinct else F.sum(col), F.lit(0))
        elif func == "collect":
            agg = F.sort_array(F.collect_set(col) if distinct else F.collect_list(col))
        else:
            agg = {"avg": F.avg, "min": F.min, "max": F.max}[func](col)
        out.append(agg.alias(name))
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def union_entities(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return a.unionByName(b).dropDuplicates([id_col])


def intersect_entities(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return a.join(b.select(id_col), id_col, "left_semi")


def except_entities(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return a.join(b.select(id_col), id_col, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select("dst", F.lit(0), F.lit(1))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def shortest_costs(anchors: DataFrame, hops: DataFrame, max_hops: int | None = None, goal: int | None = None) -> DataFrame:
    """Least-cost paths by relaxation, to a fixed point or of at most max_hops; with a goal, paths dearer than its best are given up.  anchors: anchor; hops: src, dst, cost >= 0.
    Rows (anchor, id, cost, path): the least cost and, among equals, the least path."""
    best = anchors.select("anchor", F.col("anchor").alias("id"), F.lit(0.0).alias("cost"), F.array("anchor").alias("path"))
    frontier = best
    for k in itertools.count() if max_hops is None else range(max_hops):
        step = frontier.join(hops.withColumnRenamed("cost", "hop"), F.col("id") == F.col("src")).select(
            "anchor", F.col("dst").alias("id"), (F.col("cost") + F.col("hop")).alias("cost"), F.concat("path", F.array("dst")).alias("path")
        )
        step = step.groupBy("anchor", "id").agg(F.min(F.struct("cost", "path")).alias("s")).select("anchor", "id", "s.*")
        old = best.select("anchor", "id", F.col("cost").alias("old"))
        frontier = step.join(old, ["anchor", "id"], "left").where("old is null or cost < old").drop("old")
        best = best.unionByName(frontier).groupBy("anchor", "id").agg(F.min(F.struct("cost", "path")).alias("s"))
        best = best.select("anchor", "id", "s.*")
        if k % CUT_EVERY == CUT_EVERY - 1:
            best = cut(best)
            if goal is not None:
                known = best.where(F.col("id") == goal).select("anchor", F.col("cost").alias("known"))
                frontier = frontier.join(known, "anchor", "left").where("known is null or cost <= known").drop("known")
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
    return best


def property_join(a: DataFrame, b: DataFrame, equal: list[tuple[str, str]], also: Column | None = None) -> DataFrame:
    """Entities of a and b whose properties agree, by an equi-join; also: a further test of the pairs.

    A value that many share has as many pairs as the product of its rows.  So the rows of such values are dealt
    to blocks of about JOIN_BLOCK by a hash of the whole row, and every pair of blocks is a key of its own; the
    tasks are as many as the pairs need.  Each row goes once to every block of the other side.
    """
    keys = [f"_k{n}" for n in range(len(equal))]
    sizes = [t.groupBy(*[t[c].alias(k) for c, k in zip(cols, keys)]).agg(F.count("*").alias(n)) for t, cols, n in zip((a, b), zip(*equal), ("_na", "_nb"))]
    # values with more than one block: at most a JOIN_BLOCK-th of the rows of each side
    met = sizes[0].join(sizes[1], keys)
    blocks = [F.ceil(F.col(n) / JOIN_BLOCK).cast("int") for n in ("_na", "_nb")]
    pairs = met.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0] or 0
    on = reduce(lambda x, y: x & y, [a[p] == b[q] for p, q in equal])
    if pairs <= JOIN_PAIRS:
        return a.join(b, on if also is None else on & also)
    hot = cut(met.select(*keys, blocks[0].alias("_da"), blocks[1].alias("_db")).where("_da > 1 or _db > 1"))

    def dealt(t: DataFrame, cols: tuple[str, ...], own: str, other: str, at: str, to: str) -> DataFrame:
        named = hot.select(*[F.col(k) for k in keys], F.col(own).alias(f"{own}_"), F.col(other).alias(f"{other}_"))
        plain = [c for c in t.columns if not isinstance(t.schema[c].dataType, MapType)]
        j = t.join(F.broadcast(named), reduce(lambda x, y: x & y, [t[c] == F.col(k) for c, k in zip(cols, keys)]), "left")
        block = F.coalesce(F.pmod(F.xxhash64(*[t[c] for c in plain]), F.col(f"{own}_")).cast("int"), F.lit(0))
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_"), F.lit(1)) - 1))
        return j.select(*[t[c] for c in t.columns], block.alias(at), every.alias(to))

    left, right = zip(*equal)
    x = dealt(a, left, "_da", "_db", "_xa", "_xb")
    y = dealt(b, right, "_db", "_da", "_yb", "_ya")
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(JOIN_TASKS, pairs // JOIN_PAIRS))
    x = x.repartition(tasks, *[x[c] for c in left], "_xa", "_xb")
    y = y.repartition(tasks, *[y[c] for c in right], "_ya", "_yb")
    on = reduce(lambda p, q: p & q, [x[p] == y[q] for p, q in equal]) & (F.col("_xa") == F.col("_ya")) & (F.col("_xb") == F.col("_yb"))
    return x.join(y.hint("shuffle_hash"), on if also is None else on & also).drop("_xa", "_xb", "_ya", "_yb")


def unique_violations(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the values of a key that several entities share; entities that lack a part of it are exempt."""
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return nodes.where(whole).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conformance(nodes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows, and for each rule how many entities break it (its test is true)."""
    return nodes.agg(F.count("*").alias("rows"), *[F.count(F.when(test, 1)).alias(name) for name, test in rules.items()])
