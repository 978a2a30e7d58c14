"""Queries of the temporal operators over the users' histories in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..operators import provenance as PV
from ..operators import temporal as TP
from .catalog import query

OPEN = M.OPEN
JAN = 1_704_067_200_000_000  # 2024-01-01
V, X = JAN + 20 * TP.DAY, JAN + 20 * TP.DAY + 120_000_000
WRITES = """w AS (SELECT user_id AS id, event_id AS version_id, epoch_us(ts) AS vf, epoch_us(ts) + (event_id % 7) * 60000000 AS tf,
  CASE WHEN event_type = 'error' THEN 'retract' ELSE 'update' END AS op, event_type AS kind, value FROM events)"""
SLICES = f"""{WRITES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, vf ORDER BY tf DESC, version_id DESC) AS rn FROM w) WHERE rn = 1),
 s AS (SELECT * EXCLUDE (rn), coalesce(lead(vf) OVER (PARTITION BY id ORDER BY vf), {OPEN}) AS valid_to FROM b)"""


def _as_of(v: int, t: int, name: str = "x") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vf DESC, tf DESC, version_id DESC) AS rn "
        f"FROM w WHERE tf <= {t} AND vf <= {v}) WHERE rn = 1 AND op <> 'retract')"
    )


@query("as_of", f"WITH {WRITES}, {_as_of(V, X)} SELECT id, version_id, kind, value, vf, tf FROM x")
def as_of(spark, d):
    return TP.as_of(M.event_writes(spark, d), V, X).select("id", "version_id", "kind", "value", "vf", "tf")


@query("as_of_valid_only", f"WITH {WRITES}, {_as_of(V, OPEN)} SELECT kind, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1")
def as_of_valid_only(spark, d):
    return TP.as_of(M.event_writes(spark, d), V).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("as_of_tx_only", f"WITH {WRITES}, {_as_of(OPEN, X)} SELECT id, version_id FROM x WHERE kind = 'purchase'")
def as_of_tx_only(spark, d):
    return TP.as_of(M.event_writes(spark, d), OPEN, X).where("kind = 'purchase'").select("id", "version_id")


@query("as_of_batch", f"""WITH {WRITES}, p AS (SELECT o_orderkey AS point, o_custkey AS id, {V} - (o_orderkey % 9) * {TP.DAY} AS v, {X} AS t FROM orders),
 j AS (SELECT p.point, p.id, p.v, p.t, w.version_id, w.op, row_number() OVER (PARTITION BY p.point ORDER BY w.vf DESC, w.tf DESC, w.version_id DESC) AS rn
  FROM p JOIN w ON w.id = p.id AND w.tf <= p.t AND w.vf <= p.v)
 SELECT p.point, p.id, j.version_id FROM p LEFT JOIN j ON j.point = p.point AND rn = 1 AND op <> 'retract'""")
def as_of_batch(spark, d):
    p = M.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("id"), (F.lit(V) - (F.col("o_orderkey") % 9) * TP.DAY).alias("v"), F.lit(X).alias("t")
    )
    return TP.as_of_batch(p, M.event_writes(spark, d)).select("point", "id", "version_id")


@query("valid_time_between", f"WITH {SLICES} SELECT id, version_id, vf, valid_to FROM s WHERE op <> 'retract' AND vf < {V} AND valid_to > {V - 2 * TP.DAY}")
def valid_time_between(spark, d):
    return TP.between(M.event_writes(spark, d), V - 2 * TP.DAY, V).select("id", "version_id", "vf", "valid_to")


@query("valid_time_slices", f"WITH {SLICES} SELECT id, version_id, vf, valid_to, value FROM s WHERE op <> 'retract'")
def valid_time_slices(spark, d):
    return TP.slices(M.event_writes(spark, d)).select("id", "version_id", "vf", "valid_to", "value")


@query("history", f"""WITH {WRITES} SELECT id, version_id, row_number() OVER (PARTITION BY id ORDER BY tf, version_id) AS version_number,
 coalesce(lead(tf) OVER (PARTITION BY id ORDER BY tf, version_id), {OPEN}) AS tx_to FROM w""")
def history(spark, d):
    return TP.history(M.event_writes(spark, d)).select("id", "version_id", F.col("version_number").cast("long"), "tx_to")


@query("version_by_number", f"WITH {WRITES} SELECT id, version_id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf, version_id) AS n FROM w) WHERE n = 3")
def version_by_number(spark, d):
    return TP.version_number(M.event_writes(spark, d), 3).select("id", "version_id", "value")


@query("version_diffs", f"""WITH {WRITES}, h AS (SELECT *, row_number() OVER o AS n, lag(kind) OVER o AS old FROM w WINDOW o AS (PARTITION BY id ORDER BY tf, version_id))
 SELECT id, n AS version_number, 'kind' AS key, CASE WHEN old IS NULL THEN 'added' ELSE 'modified' END AS change, old, kind AS new FROM h WHERE old IS DISTINCT FROM kind""")
def version_diffs(spark, d):
    return TP.version_diffs(M.event_writes(spark, d), ["kind"]).withColumn("version_number", F.col("version_number").cast("long"))


@query("graph_diff", f"""WITH {WRITES}, {_as_of(V - 5 * TP.DAY, X, 'a')}, {_as_of(V, X, 'b')}
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.kind <> b.kind OR a.value <> b.value""")
def graph_diff(spark, d):
    return TP.graph_diff(M.event_writes(spark, d), (V - 5 * TP.DAY, X), (V, X), ["kind", "value"])


@query("temporal_extent", f"WITH {WRITES} SELECT kind, min(vf) AS vf_min, max(vf) AS vf_max, min(tf) AS tf_min, max(tf) AS tf_max, count(*) AS n FROM w GROUP BY 1")
def temporal_extent(spark, d):
    return TP.extent(M.event_writes(spark, d), "kind")


@query("changefeed_page", f"""WITH {WRITES}, c AS (SELECT *, CASE WHEN op = 'retract' THEN 'Deleted' WHEN row_number() OVER (PARTITION BY id ORDER BY tf, version_id) = 1 THEN 'Created' ELSE 'Modified' END AS change_type FROM w)
 SELECT tf, id, version_id, change_type FROM c WHERE tf >= {V - 6 * TP.DAY} AND tf < {V} ORDER BY tf, id, version_id LIMIT 100""")
def changefeed_page(spark, d):
    return TP.changefeed(M.event_writes(spark, d), V - 6 * TP.DAY, V, 100).select("tf", "id", "version_id", "change_type")


@query("changefeed_all", f"""WITH {WRITES}, c AS (SELECT *, CASE WHEN op = 'retract' THEN 'Deleted' WHEN row_number() OVER (PARTITION BY id ORDER BY tf, version_id) = 1 THEN 'Created' ELSE 'Modified' END AS change_type FROM w)
 SELECT change_type, count(*) AS n FROM c GROUP BY 1""")
def changefeed_all(spark, d):
    return TP.changefeed(M.event_writes(spark, d), 0, OPEN).groupBy("change_type").agg(F.count("*").alias("n"))


def _window_sql(step: str, end: str) -> str:
    return f"""WITH {SLICES}, n AS (SELECT *, valid_to AS next_vf, lag(vf) OVER o IS NULL OR lag(value) OVER o IS DISTINCT FROM value AS changed FROM s WINDOW o AS (PARTITION BY id ORDER BY vf)),
 p AS (SELECT epoch_us(a) AS a, least(epoch_us(a + INTERVAL {step}), epoch_us(TIMESTAMP '{end}')) AS b FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{end}', INTERVAL {step}) g(a) WHERE a < TIMESTAMP '{end}')
 SELECT p.a AS window_start, p.b AS window_end, x.entities, x.average, y.changes, y.value_changes FROM p
 LEFT JOIN (SELECT a, count(n.id) AS entities, round(avg(value), 6) AS average FROM p LEFT JOIN n ON vf <= a AND a < next_vf GROUP BY 1) x ON x.a = p.a
 LEFT JOIN (SELECT a, count(n.id) AS changes, count(*) FILTER (WHERE changed) AS value_changes FROM p LEFT JOIN n ON vf >= a AND vf < b GROUP BY 1) y ON y.a = p.a"""


@query("window_daily", _window_sql("1 DAY", "2024-01-31"))
def window_daily(spark, d):
    w = TP.window_aggregate(M.event_writes(spark, d), JAN, JAN + 30 * TP.DAY, 1, "day", "value")
    return w.select("window_start", "window_end", "entities", F.round("average", 6).alias("average"), "changes", "value_changes")


@query("window_weekly", _window_sql("7 DAY", "2024-01-31"))
def window_weekly(spark, d):
    w = TP.window_aggregate(M.event_writes(spark, d), JAN, JAN + 30 * TP.DAY, 1, "week", "value")
    return w.select("window_start", "window_end", "entities", F.round("average", 6).alias("average"), "changes", "value_changes")


@query("window_monthly", _window_sql("1 MONTH", "2024-05-01"))
def window_monthly(spark, d):
    w = TP.window_aggregate(M.event_writes(spark, d), JAN, JAN + 121 * TP.DAY, 1, "month", "value")
    return w.select("window_start", "window_end", "entities", F.round("average", 6).alias("average"), "changes", "value_changes")


_PART = "(SELECT id AS key, vf, op, value, lead(vf, 1, {o}) OVER (PARTITION BY id ORDER BY vf) AS nxt FROM w WHERE {c})"


@query("align_events", f"""WITH {WRITES}, dr AS (SELECT id AS key, vf AS at, value AS driver_value FROM w WHERE kind = 'purchase' AND vf >= {JAN + TP.DAY} AND vf < {V}),
 o AS {_PART.format(o=OPEN, c="kind IN ('view', 'error')")}
 SELECT dr.key, dr.at, dr.driver_value, CASE WHEN o.op <> 'retract' THEN o.value END AS seen FROM dr LEFT JOIN o ON o.key = dr.key AND o.vf <= dr.at AND dr.at < o.nxt""")
def align_events(spark, d):
    w = M.event_writes(spark, d).withColumnRenamed("id", "key")
    return TP.align_events(w.where("kind = 'purchase'"), {"seen": w.where("kind in ('view', 'error')")}, JAN + TP.DAY, V)


@query("align_overlap", f"""WITH {WRITES}, a AS {_PART.format(o=OPEN, c="kind IN ('view', 'error')")}, b AS {_PART.format(o=OPEN, c="kind IN ('click', 'signup')")}
 SELECT a.key, greatest(a.vf, b.vf, {JAN + TP.DAY}) AS overlap_from, least(a.nxt, b.nxt, {V}) AS overlap_to, a.value AS x, b.value AS y
 FROM a JOIN b ON a.key = b.key AND a.op <> 'retract' AND b.op <> 'retract' WHERE greatest(a.vf, b.vf, {JAN + TP.DAY}) < least(a.nxt, b.nxt, {V})""")
def align_overlap(spark, d):
    w = M.event_writes(spark, d).withColumnRenamed("id", "key")
    parts = {"x": w.where("kind in ('view', 'error')"), "y": w.where("kind in ('click', 'signup')")}
    return TP.align_overlap(parts, JAN + TP.DAY, V)


@query("belief_revision", f"""WITH {WRITES}, h AS (SELECT *, lag(value) OVER o AS pv, lag(kind) OVER o AS pk, row_number() OVER o AS n,
  max(vf) OVER (PARTITION BY id ORDER BY tf, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w WINDOW o AS (PARTITION BY id ORDER BY tf, version_id))
 SELECT id, version_id, CASE WHEN n = 1 THEN 'InitialAssertion' WHEN op = 'retract' THEN 'Retraction' WHEN value = pv AND kind <> pk THEN 'Reaffirmation' WHEN vf > top THEN 'WorldChange' ELSE 'Correction' END AS revision FROM h""")
def belief_revision(spark, d):
    w = M.event_writes(spark, d).withColumn("source", F.col("kind"))
    return PV.belief_revisions(w, ["value"]).select("id", "version_id", "revision")


@query("contradictions", f"""WITH {WRITES}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf, version_id) AS n FROM w WHERE kind = 'purchase')
 SELECT a.id, a.version_id AS earlier, b.version_id AS later, CASE WHEN b.vf <= a.vf THEN 'RetroactiveCorrection' ELSE 'Supersession' END AS kind
 FROM k a JOIN k b ON a.id = b.id AND a.n < b.n WHERE a.value <> b.value""")
def contradictions(spark, d):
    w = M.event_writes(spark, d).where("kind = 'purchase'")
    return PV.contradictions(w, "value")


@query("half_life", f"""WITH {WRITES}, h AS (SELECT *, lead(vf) OVER (PARTITION BY id ORDER BY vf, version_id) AS nxt FROM w),
 o AS (SELECT kind, CASE WHEN nxt IS NULL THEN {JAN + 31 * TP.DAY} - vf ELSE nxt - vf END AS life, nxt IS NOT NULL AS event FROM h WHERE op <> 'retract'),
 t AS (SELECT kind, life, count(*) FILTER (WHERE event) AS d, count(*) AS n FROM o GROUP BY 1, 2),
 r AS (SELECT kind, life, d, sum(n) OVER (PARTITION BY kind ORDER BY life DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM t),
 s AS (SELECT kind, life, exp(sum(CASE WHEN d >= at_risk THEN -1e9 ELSE ln(1 - d / at_risk) END) OVER (PARTITION BY kind ORDER BY life ROWS UNBOUNDED PRECEDING)) AS survival FROM r)
 SELECT kind, min(life) FILTER (WHERE survival <= 0.5) AS median, count(*) AS steps FROM s GROUP BY 1""")
def half_life(spark, d):
    life = PV.lifespans(M.event_writes(spark, d), "kind", JAN + 31 * TP.DAY)
    curve = PV.kaplan_meier(life, "kind")
    return curve.groupBy("kind").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("life"))).alias("median"), F.count("*").alias("steps"))


_PLACED = """p AS (SELECT o_orderkey * 8 + 1 AS id, o_orderkey * 2 AS version_id, epoch_us(o_orderdate) AS vf, epoch_us(o_orderdate) + 3600000000 AS tf, 'update' AS op, o_custkey * 8 + 1 AS src, o_orderkey * 8 + 2 AS dst FROM orders
 UNION ALL SELECT o_orderkey * 8 + 1, o_orderkey * 2 + 1, epoch_us(o_orderdate) + 604800000000, epoch_us(o_orderdate) + 608400000000, 'retract', o_custkey * 8 + 1, o_orderkey * 8 + 2 FROM orders WHERE o_orderkey % 10 = 9)"""
_MID = 883_612_800_000_000  # 1998-01-01


def _adjacent(valid: int) -> str:
    return f"""{_PLACED}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vf DESC, tf DESC, version_id DESC) AS rn FROM p WHERE vf <= {valid}) WHERE rn = 1 AND op <> 'retract')"""


@query("adjacent_at", f"WITH {_adjacent(_MID)} SELECT id, src, dst FROM b JOIN customer ON c_custkey * 8 + 1 = src WHERE c_mktsegment = 'BUILDING'")
def adjacent_at(spark, d):
    ids = M.shop_nodes(spark, d)["Customer"].where("c_mktsegment = 'BUILDING'")
    return TP.adjacent_at(M.placed_writes(spark, d), ids, _MID).select("id", "src", "dst")


@query("traverse_at", f"WITH {_adjacent(_MID)} SELECT src AS anchor, dst AS id, 1 AS depth FROM b WHERE src % 80 = 9")
def traverse_at(spark, d):
    from ..operators import graph as G

    anchors = M.shop_nodes(spark, d)["Customer"].where("id % 80 = 9").select(F.col("id").alias("anchor"))
    edges = TP.as_of(M.placed_writes(spark, d), _MID).withColumnRenamed("id", "eid")
    return G.traverse(anchors, edges, "out", 1, 1)


@query("schema_at", f"WITH {WRITES}, {_as_of(V, X)} SELECT 'User' AS label, key, type, present FROM (SELECT 'kind' AS key, 'string' AS type, count(kind) AS present FROM x UNION ALL SELECT 'value', 'double', count(value) FROM x) WHERE present > 0")
def schema_at(spark, d):
    return TP.schema_at({"User": M.event_writes(spark, d)}, V, X)


@query("snapshot_diff", f"""WITH {WRITES}, {_as_of(V, X)}, {_as_of(V + 10 * TP.DAY, X + 10 * TP.DAY, 'y')}
 SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR (x.kind, x.value) IS DISTINCT FROM (y.kind, y.value)""")
def snapshot_diff(spark, d):
    s = TP.Snapshots()
    s.create("early", V, X)
    s.create("late", V + 10 * TP.DAY, X + 10 * TP.DAY)
    return s.diff("early", "late", M.event_writes(spark, d), ["kind", "value"])


@query("track_changes", f"""WITH {SLICES}, t AS (SELECT *, lag(kind) OVER o AS before, row_number() OVER o AS n FROM s WHERE op <> 'retract' WINDOW o AS (PARTITION BY id ORDER BY vf))
 SELECT id, vf AS at, 'kind' AS key, before AS old, kind AS new FROM t WHERE n > 1 AND before IS DISTINCT FROM kind AND vf >= {JAN + TP.DAY} AND vf < {JAN + 9 * TP.DAY}""")
def track_changes(spark, d):
    return TP.track_changes(M.event_writes(spark, d), ["kind"], JAN + TP.DAY, JAN + 9 * TP.DAY)


@query("changefeed_where", f"""WITH {WRITES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf, version_id) AS rn FROM w)
 SELECT tf, id, version_id, CASE WHEN op = 'retract' THEN 'Deleted' WHEN rn = 1 THEN 'Created' ELSE 'Modified' END AS change_type FROM r
 WHERE tf >= {JAN + 5 * TP.DAY} AND tf < {JAN + 8 * TP.DAY} AND kind = 'view' AND vf < {JAN + 7 * TP.DAY} ORDER BY tf, id, version_id LIMIT 60""")
def changefeed_where(spark, d):
    where = (F.col("kind") == "view") & (F.col("vf") < JAN + 7 * TP.DAY)
    return TP.changefeed(M.event_writes(spark, d), JAN + 5 * TP.DAY, JAN + 8 * TP.DAY, 60, where=where).select("tf", "id", "version_id", "change_type")
