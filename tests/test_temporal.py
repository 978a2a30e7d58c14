"""Hand-computed answers of the temporal operators."""

import datetime as dt

import pytest

from strataweave.lang.aql import run_aql
from strataweave.lang.core import Graph
from strataweave.operators import temporal as TP


def us(text):
    return (dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


SCHEMA = "id long, version_id long, vf long, tf long, op string, value long"


def writes(spark, *rows):
    return spark.createDataFrame([(r[0], k, us(r[1]), us(r[2]), r[3], r[4]) for k, r in enumerate(rows)], SCHEMA)


def test_window_monthly_average_is_the_value_at_each_start(spark):
    w = writes(spark, (1, "2024-01-01", "2024-01-01", "update", 100), (1, "2024-02-15", "2024-02-15", "update", 200), (1, "2024-04-01", "2024-04-01", "update", 300))
    out = TP.window_aggregate(w, us("2024-01-01"), us("2024-05-01"), 1, "month", "value").orderBy("window_start").collect()
    assert [r["average"] for r in out] == [100, 100, 200, 300]
    assert [r["samples"] for r in out] == [1, 1, 1, 1]
    assert [r["changes"] for r in out] == [1, 1, 0, 1]
    assert out[-1]["window_end"] == us("2024-05-01")


def test_window_with_no_entity_keeps_its_row(spark):
    w = writes(spark, (1, "2024-03-10", "2024-03-10", "update", 5))
    out = TP.window_aggregate(w, us("2024-01-01"), us("2024-04-01"), 1, "month", "value").orderBy("window_start").collect()
    assert [(r["entities"], r["total"]) for r in out] == [(0, None), (0, None), (0, None)]
    assert [r["changes"] for r in out] == [0, 0, 1]


def test_many_windows_are_found_by_bisection(spark):
    w = writes(spark, (1, "2024-01-01", "2024-01-01", "update", 1), (1, "2024-02-10", "2024-02-10", "update", 2))
    out = TP.window_aggregate(w, us("2024-01-01"), us("2024-06-01"), 1, "day", "value").orderBy("window_start").collect()
    assert len(out) > 64
    assert [r["low"] for r in out] == [1 if k < 40 else 2 for k in range(len(out))]
    assert sum(r["changes"] for r in out) == 2


def test_month_ends_step_from_the_last_bound():
    bounds = TP.window_bounds(us("2024-01-31"), us("2024-05-15"), 1, "month")
    assert [a for a, _ in bounds] == [us(x) for x in ("2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29")]
    assert bounds[-1][1] == us("2024-05-15")
    assert [a for a, _ in TP.window_bounds(us("2023-11-30"), us("2024-05-01"), 1, "quarter")] == [us("2023-11-30"), us("2024-02-29")]


@pytest.mark.parametrize("args", [(0, 10, 0, "day"), (10, 10, 1, "day"), (0, 10**15, 1, "minute")])
def test_window_errors(args):
    with pytest.raises(ValueError):
        TP.window_bounds(*args)


def test_supersession(spark):
    w = writes(spark, (1, "2024-01-01", "2024-01-01", "update", 1), (1, "2024-06-01", "2024-02-01", "update", 2), (1, "2024-03-01", "2024-03-01", "update", 3))
    value = lambda v, t: [r["value"] for r in TP.as_of(w, us(v), us(t)).collect()]
    assert value("2024-07-01", "2024-01-15") == [1]
    assert value("2024-07-01", "2024-02-15") == [2]
    assert value("2024-04-01", "2024-02-15") == [1]
    assert value("2024-04-01", "2024-03-15") == [3]
    assert value("2023-12-31", "2024-03-15") == []
    slices = TP.slices(w).orderBy("vf").collect()
    assert [(r["value"], r["valid_to"]) for r in slices] == [(1, us("2024-03-01")), (3, us("2024-06-01")), (2, TP.OPEN)]


def test_retraction_and_same_valid_from(spark):
    w = writes(spark, (1, "2024-01-01", "2024-01-01", "update", 1), (1, "2024-01-01", "2024-02-01", "update", 7), (1, "2024-05-01", "2024-03-01", "retract", 0))
    assert [r["value"] for r in TP.as_of(w, us("2024-04-01")).collect()] == [7]
    assert TP.as_of(w, us("2024-06-01")).count() == 0
    assert [(r["value"], r["valid_to"]) for r in TP.slices(w).collect()] == [(7, us("2024-05-01"))]


def test_align_events_takes_the_other_value_at_the_drivers_instants(spark):
    keyed = lambda *rows: writes(spark, *rows).withColumnRenamed("id", "key")
    driver = keyed((1, "2024-02-01", "2024-02-01", "update", 10), (1, "2024-09-01", "2024-09-01", "update", 20), (2, "2024-03-01", "2024-03-01", "update", 30))
    tier = keyed((1, "2024-01-01", "2024-01-01", "update", 1), (1, "2024-06-01", "2024-06-01", "update", 2), (2, "2024-04-01", "2024-04-01", "update", 9))
    out = TP.align_events(driver, {"tier": tier}, us("2024-01-01"), us("2025-01-01")).orderBy("at").collect()
    assert [(r["driver_value"], r["tier"]) for r in out] == [(10, 1), (30, None), (20, 2)]


def test_align_overlap_is_piecewise(spark):
    keyed = lambda *rows: writes(spark, *rows).withColumnRenamed("id", "key")
    a = keyed((1, "2024-01-01", "2024-01-01", "update", 100), (1, "2024-06-01", "2024-06-01", "update", 110))
    b = keyed((1, "2024-03-01", "2024-03-01", "update", 5), (1, "2024-09-01", "2024-09-01", "retract", 0))
    out = TP.align_overlap({"a": a, "b": b}, us("2024-01-01"), us("2024-12-01")).orderBy("overlap_from").collect()
    got = [(r["overlap_from"], r["overlap_to"], r["a"], r["b"]) for r in out]
    assert got == [(us("2024-03-01"), us("2024-06-01"), 100, 5), (us("2024-06-01"), us("2024-09-01"), 110, 5)]


def test_changefeed_pages_join_up(spark):
    w = writes(spark, *[(k % 3, f"2024-01-{k + 1:02d}", f"2024-01-{k + 1:02d}", "retract" if k == 7 else "update", k) for k in range(9)])
    whole = TP.changefeed(w, 0, TP.OPEN).collect()
    assert [r["change_type"] for r in whole] == ["Created"] * 3 + ["Modified"] * 4 + ["Deleted", "Modified"]
    page, seen = None, []
    while True:
        rows = TP.changefeed(w, 0, TP.OPEN, 4, page).collect()
        if not rows:
            break
        seen += rows
        page = (rows[-1]["tf"], rows[-1]["id"], rows[-1]["version_id"])
    assert seen == whole


def test_aql_window_and_align(spark):
    price = writes(spark, (1, "2024-01-01", "2024-01-01", "update", 100), (1, "2024-02-15", "2024-02-15", "update", 200))
    g = Graph({"Product": TP.as_of(price, TP.OPEN)}, None, {"Product": price})
    out = run_aql(spark, g, "MATCH (p:Product) WINDOW 1 MONTH OVER VALID_TIME FROM '2024-01-01' TO '2024-04-01' RETURN AVG(p.value) AS mean, COUNT(*) AS n").collect()
    assert [(r["window_start"], r["mean"], r["n"]) for r in out] == [
        ("2024-01-01T00:00:00.000000Z", 100.0, 1), ("2024-02-01T00:00:00.000000Z", 100.0, 1), ("2024-03-01T00:00:00.000000Z", 200.0, 1)
    ]
    edges = spark.createDataFrame([(1, 1, 2, "SUPPLIED_BY")], "eid long, src long, dst long, label string")
    rating = writes(spark, (2, "2024-02-01", "2024-02-01", "update", 5))
    g = Graph({"Product": TP.as_of(price, TP.OPEN), "Supplier": TP.as_of(rating, TP.OPEN)}, edges, {"Product": price, "Supplier": rating})
    text = "MATCH (p:Product)-[:SUPPLIED_BY]->(s:Supplier) ALIGN EVENTS DRIVER p OVER VALID_TIME FROM '2024-01-01' TO '2025-01-01' RETURN p.value AS price, s.value AS rating"
    assert [(r["price"], r["rating"]) for r in run_aql(spark, g, text).orderBy("align_valid_time").collect()] == [(100, None), (200, 5)]
    text = text.replace("EVENTS DRIVER p", "OVERLAP")
    assert [(r["overlap_from"][:10], r["price"], r["rating"]) for r in run_aql(spark, g, text).orderBy("overlap_from").collect()] == [("2024-02-01", 100, 5), ("2024-02-15", 200, 5)]
