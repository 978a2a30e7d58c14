"""Bi-temporal operators over tables of writes (id, version_id, vf, tf, op, properties).

Belief at (v, t) is the write with tf <= t and vf <= v of the greatest (vf, tf,
version_id); a retraction or deletion hides the entity.  One aggregate answers it,
with partial aggregation before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE, OPEN, RETRACT

MAX_WINDOWS = 100_000
DAY = 86_400_000_000
UNITS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": DAY, "week": 7 * DAY}


def _last(writes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in writes.columns if c not in keys]
    order = F.struct("vf", "tf", "version_id")
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def as_of(writes: DataFrame, valid: int, tx: int = OPEN) -> DataFrame:
    """The entities believed at (valid, tx), one row each."""
    seen = writes.where((F.col("tf") <= tx) & (F.col("vf") <= valid))
    return _last(seen, ["id"]).where(~F.col("op").isin(RETRACT, DELETE))


def as_of_batch(points: DataFrame, writes: DataFrame) -> DataFrame:
    """points: point, id, v, t.  The version of each id at its point; nulls where there is none."""
    seen = points.join(writes, "id").where("tf <= t and vf <= v")
    found = _last(seen.drop("v", "t"), ["point", "id"]).where(~F.col("op").isin(RETRACT, DELETE))
    return points.join(found, ["point", "id"], "left")


def slices(writes: DataFrame, tx: int = OPEN) -> DataFrame:
    """The believed partition of valid time at tx: each row holds over [vf, valid_to)."""
    seen = _last(writes.where(F.col("tf") <= tx), ["id", "vf"])
    nxt = F.lead("vf").over(Window.partitionBy("id").orderBy("vf"))
    out = seen.withColumn("valid_to", F.coalesce(nxt, F.lit(OPEN)))
    return out.where(~F.col("op").isin(RETRACT, DELETE))


def between(writes: DataFrame, start: int, end: int, tx: int = OPEN) -> DataFrame:
    """Slices believed at tx that overlap [start, end)."""
    return slices(writes, tx).where((F.col("vf") < end) & (F.col("valid_to") > start) & F.lit(start < end))


def history(writes: DataFrame) -> DataFrame:
    """One row per write, oldest first, numbered from 1; believed over [tf, tx_to)."""
    w = Window.partitionBy("id").orderBy("tf", "version_id")
    return writes.withColumns({"version_number": F.row_number().over(w), "tx_to": F.coalesce(F.lead("tf").over(w), F.lit(OPEN))})


def version_number(writes: DataFrame, n: int) -> DataFrame:
    return history(writes).where(F.col("version_number") == n)


def version_diffs(writes: DataFrame, columns: list[str]) -> DataFrame:
    """id, version_number, key, change (added, removed, modified), old, new against the write before."""
    w = Window.partitionBy("id").orderBy("tf", "version_id")
    rows = history(writes)
    pairs = [F.struct(F.lit(c).alias("key"), F.lag(F.col(c).cast("string")).over(w).alias("old"), F.col(c).cast("string").alias("new")) for c in columns]
    rows = rows.select("id", "version_number", F.array(*pairs).alias("p")).select("id", "version_number", F.inline("p"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return rows.where("not (old <=> new)").withColumn("change", change)


def graph_diff(writes: DataFrame, before: tuple[int, int], after: tuple[int, int], columns: list[str]) -> DataFrame:
    """id, change: what differs between two coordinates."""
    digest = F.struct(*columns)
    a = as_of(writes, *before).select("id", digest.alias("a"))
    b = as_of(writes, *after).select("id", digest.alias("b"))
    j = a.join(b, "id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return j.select("id", change.alias("change")).where("change is not null")


def extent(writes: DataFrame, by: str | None = None) -> DataFrame:
    aggs = [F.min("vf").alias("vf_min"), F.max("vf").alias("vf_max"), F.min("tf").alias("tf_min"), F.max("tf").alias("tf_max"), F.count("*").alias("n")]
    return writes.groupBy(by).agg(*aggs) if by else writes.agg(*aggs)


def changefeed(writes: DataFrame, start: int, end: int, limit: int | None = None, after: tuple[int, int, int] | None = None, where: Column | None = None) -> DataFrame:
    """Changes recorded in [start, end), ordered by (tf, id, version_id); after: the last row of the page before;
    where: a test of the changes, such as one of label or of valid time."""
    out = writes.where((F.col("tf") >= start) & (F.col("tf") < end))
    if where is not None:
        out = out.where(where)
    # the first write of an entity, by a minimum over the past of the range's entities only
    first = writes.where(F.col("tf") < end).join(out.select("id").distinct(), "id", "left_semi")
    first = first.groupBy("id").agg(F.min(F.struct("tf", "version_id")).alias("_first"))
    kind = F.when(F.col("op").isin(RETRACT, DELETE), "Deleted").when(F.struct("tf", "version_id") == F.col("_first"), "Created").otherwise("Modified")
    out = out.join(first, "id").withColumn("change_type", kind).drop("_first")
    if after is not None:
        last = [F.lit(x).cast(out.schema[c].dataType).alias(c) for c, x in zip(("tf", "id", "version_id"), after)]
        out = out.where(F.struct("tf", "id", "version_id") > F.struct(*last))
    out = out.orderBy("tf", "id", "version_id")
    return out if limit is None else out.limit(limit)


def _instant(us: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def _us(t: dt.datetime) -> int:
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def window_bounds(start: int, end: int, count: int, unit: str) -> list[tuple[int, int]]:
    """Tumbling windows of [start, end); calendar units step from the last bound, with days clamped; the last end is clamped."""
    if count <= 0:
        raise ValueError("a window needs a positive count")
    if end <= start:
        raise ValueError("a window range must end after it starts")
    bounds, at = [], start
    while at < end:
        if unit in UNITS:
            nxt = at + count * UNITS[unit]
        else:
            t = _instant(at)
            months = t.year * 12 + t.month - 1 + count * {"month": 1, "quarter": 3, "year": 12}[unit]
            year, month = divmod(months, 12)
            first = dt.datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)
            nxt = _us(t.replace(year=year, month=month + 1, day=min(t.day, first.day)))
        bounds.append((at, min(nxt, end)))
        if len(bounds) > MAX_WINDOWS:
            raise ValueError(f"more than {MAX_WINDOWS} windows")
        at = nxt
    return bounds


def beliefs(writes: DataFrame, tx: int = OPEN) -> DataFrame:
    """Per id and vf the write of the greatest tf, with next_vf; retractions are kept as samples."""
    seen = _last(writes.where(F.col("tf") <= tx), ["id", "vf"])
    nxt = F.lead("vf").over(Window.partitionBy("id").orderBy("vf"))
    return seen.withColumn("next_vf", F.coalesce(nxt, F.lit(OPEN)))


def window_aggregate(writes: DataFrame, start: int, end: int, count: int, unit: str, column: str, tx: int = OPEN) -> DataFrame:
    """Per window: entities, samples, sum, avg, min, max of the value held at its start, and changes within it.

    Each belief meets the windows that start while it holds: an array of window
    numbers, exploded, not a range join.  Windows without rows are kept.
    """
    spark = writes.sparkSession
    bounds = window_bounds(start, end, count, unit)
    spine = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(bounds)], "w int, window_start long, window_end long")
    starts = F.lit([a for a, _ in bounds])
    held = beliefs(writes, tx)
    prev = F.lag(column).over(Window.partitionBy("id").orderBy("vf"))
    first = F.lag("vf").over(Window.partitionBy("id").orderBy("vf")).isNull()
    held = held.withColumn("changed", first | ~prev.eqNullSafe(F.col(column)))
    # window numbers by bisection: [first start >= vf, first start >= next_vf)
    low = _rank(F.col("vf"), starts, len(bounds))
    high = _rank(F.col("next_vf"), starts, len(bounds))
    samples = held.withColumn("w", F.explode(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))))
    v = F.col(column)
    sampled = samples.groupBy("w").agg(
        F.count("*").alias("entities"), F.count(v).alias("samples"), F.sum(v).alias("total"), F.avg(v).alias("average"), F.min(v).alias("low"), F.max(v).alias("high")
    )
    inside = held.where((F.col("vf") >= start) & (F.col("vf") < end)).withColumn("w", (_rank(F.col("vf") + 1, starts, len(bounds)) - 1).cast("int"))
    changes = inside.groupBy("w").agg(F.count("*").alias("changes"), F.count(F.when(F.col("changed"), 1)).alias("value_changes"))
    # the spine and both sides have a row per window at most
    out = spine.join(sampled, "w", "left").join(changes, "w", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("entities", "samples", "changes", "value_changes")}
    return out.withColumns(zero).drop("w")


def _rank(value: Column, starts: Column, n: int) -> Column:
    """How many starts are below value: arithmetic would miss calendar steps, so the sorted literal is searched."""
    if n <= 64:
        return F.size(F.filter(starts, lambda s: s < value))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(max(1, n.bit_length()))),
        F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda acc, _: F.when(
            acc["lo"] < acc["hi"],
            F.when(
                F.get(starts, F.shiftright(acc["lo"] + acc["hi"], 1)) < value,
                F.struct((F.shiftright(acc["lo"] + acc["hi"], 1) + 1).alias("lo"), acc["hi"].alias("hi")),
            ).otherwise(F.struct(acc["lo"].alias("lo"), F.shiftright(acc["lo"] + acc["hi"], 1).alias("hi"))),
        ).otherwise(acc),
        lambda acc: acc["lo"],
    )


def align_events(driver: DataFrame, others: dict[str, DataFrame], start: int, end: int, tx: int = OPEN) -> DataFrame:
    """As-of join at the driver's change points.  driver, others: key plus writes of one entity per key.

    Rows (key, at, driver value, other values): other values hold at that instant, or are
    null.  Each side's changes are merged in time order and the last value is carried
    forward, so no range join is needed.
    """
    points = driver.where((F.col("tf") <= tx) & (F.col("vf") >= start) & (F.col("vf") < end) & ~F.col("op").isin(RETRACT, DELETE))
    out = points.groupBy("key", F.col("vf").alias("at")).agg(F.max_by("value", F.struct("tf", "version_id")).alias("driver_value"))
    for name, writes in others.items():
        seen = writes.where(F.col("tf") <= tx).groupBy("key", "vf").agg(F.max_by(F.struct("op", "value"), F.struct("tf", "version_id")).alias("s"))
        marks = seen.select("key", F.col("vf").alias("at"), F.lit(0).alias("side"), "s").unionByName(
            out.select("key", "at", F.lit(1).alias("side"), F.lit(None).cast(seen.schema["s"].dataType).alias("s"))
        )
        w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
        carried = marks.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("side = 1")
        value = F.when(~F.col("s.op").isin(RETRACT, DELETE), F.col("s.value"))
        out = out.join(carried.select("key", "at", value.alias(name)), ["key", "at"])
    return out


def align_overlap(parts: dict[str, DataFrame], start: int, end: int, tx: int = OPEN) -> DataFrame:
    """Maximal sub-intervals of [start, end) over which all parts hold.  parts: key plus writes, one entity per key.

    Sweep by windows: every bound of any part, then the value carried forward at each.
    """
    sides = []
    for k, (name, writes) in enumerate(parts.items()):
        seen = writes.where(F.col("tf") <= tx).groupBy("key", "vf").agg(F.max_by(F.struct("op", "value"), F.struct("tf", "version_id")).alias("s"))
        sides.append(seen.select("key", F.greatest("vf", F.lit(start)).alias("at"), F.col("vf").alias("order"), F.lit(k).alias("side"), "s").where(F.col("at") < end))
    marks = sides[0]
    for s in sides[1:]:
        marks = marks.unionByName(s)
    w = Window.partitionBy("key").orderBy("at", "order", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.select("key", "at", "order", "side", *[F.last(F.when(F.col("side") == k, F.col("s")), ignorenulls=True).over(w).alias(name) for k, name in enumerate(parts)])
    # of rows at one instant the last has seen all of them
    held = held.groupBy("key", "at").agg(F.max_by(F.struct(*parts), F.struct("order", "side")).alias("v")).select("key", "at", "v.*")
    nxt = F.coalesce(F.lead("at").over(Window.partitionBy("key").orderBy("at")), F.lit(end))
    held = held.withColumn("until", nxt)
    for name in parts:
        held = held.where(F.col(name).isNotNull() & ~F.col(f"{name}.op").isin(RETRACT, DELETE))
    values = [F.col(f"{n}.value").alias(n) for n in parts]
    return held.select("key", F.col("at").alias("overlap_from"), F.col("until").alias("overlap_to"), *values)


def rfc3339(us: Column) -> Column:
    whole = F.floor(us / 1_000_000).cast("long")
    base = F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.lit("."), F.lpad((us - whole * 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def adjacent_at(edge_writes: DataFrame, ids: DataFrame, valid: int, tx: int = OPEN, direction: str = "out") -> DataFrame:
    """The edges believed at (valid, tx) that leave (out) or reach (in) the ids, one row each.  ids: id.

    The ids narrow the writes before the belief is taken: an edge's ends never change.
    """
    end = {"out": "src", "in": "dst"}[direction]
    own = edge_writes.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return as_of(own, valid, tx)


def schema_at(writes: dict[str, DataFrame], valid: int, tx: int = OPEN) -> DataFrame:
    """(label, key, type, present): the keys that any entity of a label carries at (valid, tx), and how many do."""
    rest = {"id", "version_id", "vf", "tf", "op"}
    out = None
    for label, rows in writes.items():
        keys = [f for f in rows.schema.fields if f.name not in rest]
        seen = as_of(rows, valid, tx).agg(*[F.count(f.name).alias(f.name) for f in keys])
        entries = [F.struct(F.lit(label).alias("label"), F.lit(f.name).alias("key"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("present")) for f in keys]
        part = seen.select(F.inline(F.array(*entries))).where("present > 0")
        out = part if out is None else out.unionByName(part)
    return out


class Snapshots:
    """Names for coordinates of belief; a snapshot holds no data, since a history answers for any of them."""

    def __init__(self) -> None:
        self.at: dict[str, tuple[int, int]] = {}

    def create(self, name: str, valid: int, tx: int = OPEN) -> None:
        if name in self.at:
            raise ValueError(f"there is a snapshot {name} already")
        self.at[name] = (valid, tx)

    def drop(self, name: str) -> None:
        del self.at[name]

    def read(self, name: str, writes: DataFrame) -> DataFrame:
        return as_of(writes, *self.at[name])

    def diff(self, before: str, after: str, writes: DataFrame, columns: list[str]) -> DataFrame:
        return graph_diff(writes, self.at[before], self.at[after], columns)


def track_changes(writes: DataFrame, columns: list[str], start: int, end: int, tx: int = OPEN) -> DataFrame:
    """(id, at, key, old, new): each change of belief in a column between two valid times, as slices follow each other."""
    held = slices(writes, tx)
    w = Window.partitionBy("id").orderBy("vf")
    pairs = [F.struct(F.lit(c).alias("key"), F.lag(F.col(c).cast("string")).over(w).alias("old"), F.col(c).cast("string").alias("new")) for c in columns]
    rows = held.select("id", F.col("vf").alias("at"), F.row_number().over(w).alias("n"), F.array(*pairs).alias("p"))
    rows = rows.where((F.col("at") >= start) & (F.col("at") < end)).select("id", "at", "n", F.inline("p"))
    return rows.where("n > 1 and not (old <=> new)").drop("n")
