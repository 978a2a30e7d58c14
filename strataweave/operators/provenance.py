"""Provenance, lineage, trust and the analyses of histories of writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE, RETRACT
from ..scratch import cut

LINEAGE_DEPTH = 32
#: Ranges of lives in which survival's running sums are taken.
SURVIVAL_RANGES = 64


def provenance_filter(df: DataFrame, sources: list[str] | None = None, min_confidence: float | None = None, include_unattributed: bool = False) -> DataFrame:
    """Rows whose bundle (columns source, confidence) passes both tests; a missing part fails a test."""
    bundle = F.col("source").isNotNull() | F.col("confidence").isNotNull()
    keep = F.lit(True)
    if sources is not None:
        keep = keep & F.coalesce(F.col("source").isin(*sources), F.lit(False))
    if min_confidence is not None:
        keep = keep & F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    return df.where((bundle & keep) | (~bundle & F.lit(include_unattributed)))


def _in_order() -> Window:
    return Window.partitionBy("id").orderBy("tf", "version_id")


def belief_revisions(writes: DataFrame, columns: list[str]) -> DataFrame:
    """writes with source: how each write revises the one before."""
    w = _in_order()
    changed = ~F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w))
    before = F.lag("source").over(w)
    top = F.max("vf").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # the op column, not a closed interval, tells a retraction: backfills are closed too
    revision = (
        F.when(F.row_number().over(w) == 1, "InitialAssertion")
        .when(F.col("op").isin(RETRACT, DELETE), "Retraction")
        .when(~changed & (F.col("source") != before), "Reaffirmation")
        .when(F.col("vf") > top, "WorldChange")
        .otherwise("Correction")
    )
    return writes.withColumn("revision", revision)


def contradictions(writes: DataFrame, column: str) -> DataFrame:
    """(id, earlier, later, kind): pairs of one entity's writes that assert different values over common valid time.

    Writes keep their open interval, so any two overlap; the pairs of one entity are what is asked for.
    """
    w = writes.where(~F.col("op").isin(RETRACT, DELETE)).withColumn("n", F.row_number().over(_in_order()))
    a = w.select("id", F.col("n").alias("na"), F.col("version_id").alias("earlier"), F.col("vf").alias("va"), F.col(column).alias("xa"))
    b = w.select("id", F.col("n").alias("nb"), F.col("version_id").alias("later"), F.col("vf").alias("vb"), F.col(column).alias("xb"))
    kind = F.when(F.col("vb") <= F.col("va"), "RetroactiveCorrection").otherwise("Supersession")
    return a.join(b, "id").where("na < nb and xa <> xb").select("id", "earlier", "later", kind.alias("kind"))


def lifespans(writes: DataFrame, by: str, now: int) -> DataFrame:
    """(by, life, event): how long each assertion held; those still held are censored at now."""
    nxt = F.lead("vf").over(Window.partitionBy("id").orderBy("vf", "version_id"))
    rows = writes.withColumn("next", nxt).where(~F.col("op").isin(RETRACT, DELETE))
    return rows.select(by, (F.coalesce("next", F.lit(now)) - F.col("vf")).alias("life"), F.col("next").isNotNull().alias("event"))


def kaplan_meier(spans: DataFrame, by: str) -> DataFrame:
    """(by, life, deaths, at_risk, survival) at each distinct life; equal lives are summed before the windows.

    Running sums are taken within ranges of lives and shifted by the sums of the ranges before, so that a
    few groups do not mean a few tasks.
    """
    steps = spans.groupBy(by, "life").agg(F.count(F.when(F.col("event"), 1)).alias("deaths"), F.count("*").alias("n"))
    steps = cut(steps)
    ends = steps.agg(F.min("life").alias("low"), F.max("life").alias("high"))  # one row
    steps = steps.join(F.broadcast(ends)).withColumn("range", F.floor((F.col("life") - F.col("low")) * (SURVIVAL_RANGES - 1) / F.greatest(F.lit(1), F.col("high") - F.col("low"))))
    steps = _summed(steps, by, "n", "gone").withColumn("at_risk", F.col("total_n") - F.col("gone") + F.col("n"))
    # survival is 0 once all at risk have died
    term = F.when(F.col("deaths") >= F.col("at_risk"), -1e9).otherwise(F.log(1 - F.col("deaths") / F.col("at_risk")))
    steps = _summed(steps.withColumn("term", term), by, "term", "log_survival")
    return steps.select(by, "life", "deaths", "at_risk", F.exp("log_survival").alias("survival"))


def _summed(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """rows (by, range, life, ...) with the running sum of value by life as name, and the sum of all as total_<value>."""
    sums = rows.groupBy(by, "range").agg(F.sum(value).alias("part"))
    w = Window.partitionBy(by).orderBy("range")  # at most SURVIVAL_RANGES rows a group
    sums = sums.select(by, "range", (F.sum("part").over(w) - F.col("part")).alias("base"), F.sum("part").over(Window.partitionBy(by)).alias(f"total_{value}"))
    own = F.sum(value).over(Window.partitionBy(by, "range").orderBy("life").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, [by, "range"]).withColumn(name, F.col("base") + own).drop("base")


def counterfactual(writes: DataFrame, columns: list[str], excluded: Column) -> DataFrame:
    """Current values had the excluded writes not been made: (id, columns).

    A fold of deltas: each key takes its last value among surviving writes that changed
    it against their real predecessor.  An entity whose surviving writes are updates
    only, with no surviving base, is orphaned and left out.
    """
    w = _in_order()
    rows = writes.withColumn("first", F.row_number().over(w) == 1)
    for c in columns:
        rows = rows.withColumn(f"d_{c}", F.col("first") | ~F.col(c).eqNullSafe(F.lag(c).over(w)))
    gone = F.coalesce(excluded, F.lit(False))
    order = F.struct("tf", "version_id")
    out = rows.where(~gone).groupBy("id").agg(
        F.max("first").alias("based"),
        F.max_by("op", order).alias("op"),
        *[F.max_by(F.when(F.col(f"d_{c}"), F.col(c)), F.when(F.col(f"d_{c}"), order)).alias(c) for c in columns],
    )
    return out.where(F.col("based") & ~F.col("op").isin(RETRACT, DELETE)).select("id", *columns)


def lineage_closure(lineage: DataFrame, roots: DataFrame, depth: int = LINEAGE_DEPTH, upstream: bool = True) -> DataFrame:
    """lineage: derived, source.  (root, version, depth): all that the roots derive from, or that derives from them."""
    a, b = ("derived", "source") if upstream else ("source", "derived")
    hops = lineage.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    seen = frontier = roots.select("root", F.col("root").alias("version"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = frontier.join(hops, F.col("version") == F.col("at")).select("root", F.col("to").alias("version")).distinct()
        frontier = step.join(seen.select("root", "version"), ["root", "version"], "left_anti").withColumn("depth", F.lit(d))
        if d % 3 == 0:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        else:
            seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def trust(confidence: DataFrame, lineage: DataFrame, policy: str = "weakest", missing: float | None = 0.0, depth: int = LINEAGE_DEPTH) -> DataFrame:
    """confidence: version, confidence.  (version, trust) combined over the whole lineage of each version.

    weakest: the least confidence of itself and its sources; noisy_or: 1 - product(1 - c).
    missing: value for versions without confidence, or None to leave them out (0.5 if nothing is left).

    Where every version has one source at most, spans of 1, 2, 4, ... versions are combined, so the rows are those
    of the versions, not of the closure; only versions whose lineage is longer, or a cycle, take the closure.
    """
    c = F.col("confidence") if missing is None else F.coalesce("confidence", F.lit(missing))
    if policy != "weakest":
        c = F.when(c.isNotNull(), F.log(1 - F.least(c, F.lit(1 - 1e-12))))  # least() would skip a null
    own = confidence.select("version", c.alias("part"))
    hops = lineage.where("derived <> source").select(F.col("derived").alias("version"), F.col("source").alias("to")).distinct()
    spans = cut(own.withColumn("asked", F.lit(True)).join(hops, "version", "full"))
    rest = own.select(F.col("version").alias("root"))
    out = None
    if spans.groupBy("version").count().where("count > 1").isEmpty():
        for _ in range(depth.bit_length() - 1):
            ahead = spans.select(F.col("version").alias("to"), F.col("part").alias("part_"), F.col("to").alias("to_"))
            both = F.least("part", "part_") if policy == "weakest" else F.coalesce(F.col("part") + F.col("part_"), "part", "part_")
            longer = spans.where("to is not null").join(ahead, "to", "left").select("version", both.alias("part"), "asked", F.col("to_").alias("to"))
            spans = cut(spans.where("to is null").select("version", "part", "asked", "to").unionByName(longer))
        out = spans.where("asked and to is null").select("version", "part")
        rest = spans.where("asked and to is not null").select(F.col("version").alias("root"))
    if out is None or not rest.isEmpty():
        closure = lineage_closure(lineage, rest, depth).select("root", "version")
        every = closure.union(rest.select("root", F.col("root").alias("version")))
        agg = F.min("part") if policy == "weakest" else F.sum("part")
        walked = every.join(own, "version", "left").groupBy(F.col("root").alias("version")).agg(agg.alias("part"))
        out = walked if out is None else out.unionByName(walked)
    value = F.col("part") if policy == "weakest" else 1 - F.exp("part")
    return out.select("version", F.coalesce(value, F.lit(0.5)).alias("trust"))


def hash_chain(writes: DataFrame, columns: list[str]) -> DataFrame:
    """Per entity, each write's digest over its content and the digest before it: (id, version_id, digest)."""
    content = F.sha2(F.to_json(F.struct(*columns)), 256)
    rows = writes.select("id", "version_id", "tf", content.alias("own"))
    parts = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tf", "version_id", "own"))).alias("w"))
    # an entity's chain is sequential by nature; entities are chained in parallel
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<version_id:bigint,digest:string>>").alias("out"))

    def link(acc: Column, x: Column) -> Column:
        digest = F.sha2(F.concat(acc["last"], x["own"]), 256)
        return F.struct(digest.alias("last"), F.concat(acc["out"], F.array(F.struct(x["version_id"].cast("bigint").alias("version_id"), digest.alias("digest")))).alias("out"))

    return parts.select("id", F.inline(F.aggregate("w", start, link, lambda acc: acc["out"])))


def verify_chain(writes: DataFrame, columns: list[str], recorded: DataFrame) -> DataFrame:
    """Versions whose recorded digest (id, version_id, digest) differs from the chain's."""
    fresh = hash_chain(writes, columns).withColumnRenamed("digest", "fresh")
    return recorded.join(fresh, ["id", "version_id"], "full").where("not (digest <=> fresh)").select("id", "version_id")


def kept_versions(writes: DataFrame, threshold: float, column: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Versions that moved at least threshold from the last one kept: a fold over each entity's history in time order."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        import numpy as np

        rows = pd.concat(list(parts)).sort_values(["vf", "version_id"])
        last, kept = None, []
        for v, e in zip(rows["version_id"], rows[column]):
            e = np.asarray(e, float)
            if last is not None:
                if metric == "cosine":
                    norm = np.linalg.norm(e) * np.linalg.norm(last)
                    moved = 1 - (float(e @ last) / norm if norm > 1e-12 else 0.0)
                else:
                    moved = float(np.linalg.norm(e - last))
                if moved < threshold:
                    continue
            last = e
            kept.append(v)
        return pd.DataFrame({"id": key[0], "version_id": kept})

    rows = writes.select("id", "version_id", "vf", column)
    return rows.groupBy("id").applyInPandas(lambda key, rows: fold(key, iter([rows])), "id long, version_id long")


def unattributed(df: DataFrame, part: str | None = None) -> DataFrame:
    """Rows without a bundle (columns source, confidence), or without one part of it: IS NULL on provenance."""
    if part is not None:
        return df.where(F.col(part).isNull())
    return df.where(F.col("source").isNull() & F.col("confidence").isNull())


def with_provenance(df: DataFrame, keys: list[str], parts: tuple[str, ...] = ("source", "confidence")) -> DataFrame:
    """The keys and a struct provenance of the parts, null where the whole bundle is: ProjectProvenance."""
    known = F.lit(False)
    for p in parts:
        known = known | F.col(p).isNotNull()
    return df.select(*keys, F.when(known, F.struct(*parts)).alias("provenance"))


def lineage_page(lineage: DataFrame, roots: DataFrame, depth: int, limit: int, upstream: bool = True) -> DataFrame:
    """(root, version, depth, has_more): the first limit versions of each root by depth and id; has_more tells whether
    the root has others, within the depth or one hop beyond it."""
    closure = lineage_closure(lineage, roots, depth + 1, upstream)
    w = Window.partitionBy("root").orderBy("depth", "version")
    numbered = closure.withColumn("n", F.row_number().over(w)).withColumn("inside", (F.col("n") <= limit) & (F.col("depth") <= depth))
    more = numbered.groupBy("root").agg(F.max(~F.col("inside")).alias("has_more"))
    return numbered.where("inside").join(more, "root").select("root", "version", "depth", "has_more")


def trusted(confidence: DataFrame, lineage: DataFrame, least: float, policy: str = "weakest", missing: float | None = 0.0) -> DataFrame:
    """Versions whose confidence, computed over their lineage, is at least this."""
    return trust(confidence, lineage, policy, missing).where(F.col("trust") >= least)
