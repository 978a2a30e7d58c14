"""Import and export round trips, and streams run to completion."""

import json

import pytest
from pyspark.sql import functions as F

from strataweave.operators import provenance as PV
from strataweave.sources import exporting, importing
from strataweave.streaming import changefeed


def test_csv_import_reports_what_it_skips(spark, tmp_path):
    (tmp_path / "n.csv").write_text("key,age\na,30\nb,x\n,5\nc,\n")
    m = importing.Mapping(label="Person", columns={"age": "bigint"}, on_error="skip")
    nodes, bad = importing.import_nodes(spark, "csv", str(tmp_path / "n.csv"), m)
    assert sorted((r["key"], r["age"]) for r in nodes.collect()) == [("a", 30), ("c", None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["age is no bigint", "no key"]
    m.on_error = "abort"
    with pytest.raises(Exception, match="bigint|key"):
        importing.import_nodes(spark, "csv", str(tmp_path / "n.csv"), m)[0].collect()


def test_edges_find_their_ends(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text("\n".join(json.dumps({"key": k}) for k in "abc"))
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(e) for e in ({"src_key": "a", "dst_key": "b", "w": "1.5"}, {"src_key": "a", "dst_key": "z"})))
    nodes, _ = importing.import_nodes(spark, "json", str(tmp_path / "n.jsonl"), importing.Mapping(label="N"))
    edges, bad = importing.import_edges(spark, "json", str(tmp_path / "e.jsonl"), importing.Mapping(label="L", columns={"w": "double"}, on_error="skip"), nodes)
    assert [r["w"] for r in edges.collect()] == [1.5]
    assert [(r["dst_key"], r["reason"]) for r in bad.collect()] == [("z", "unknown target")]


def test_admin_header():
    assert importing.admin_csv_header("personId:ID,name,age:int,tags:string[],:LABEL") == {"personId": "ID", "name": "string", "age": "bigint", "tags": "array<string>", "label": "LABEL"}


def test_history_export(spark, tmp_path):
    w = spark.createDataFrame([(1, 0, 10, 10, "update", 5.0), (1, 1, 20, 20, "retract", 0.0)], "id long, version_id long, vf long, tf long, op string, value double")
    exporting.export_history(w, str(tmp_path / "h"), ["value"])
    out = spark.read.parquet(str(tmp_path / "h")).orderBy("version").collect()
    assert [(r["valid_from"], r["tombstone"], r["tx_to"] > r["tx_time"], r["value"]) for r in out] == [(10, False, True, 5.0), (20, True, True, 0.0)]
    assert json.loads(out[0]["properties_json"])["op"] == "update"


def test_change_stream_resumes_from_its_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([(1, "update", True, "A"), (1, "update", False, "A"), (2, "retract", False, "B")], "id long, op string, first boolean, label string")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: changefeed.subscribe(
        changefeed.change_stream(spark, str(tmp_path / "in"), rows.schema, change_types=["Created", "Deleted"]), str(tmp_path / "out"), str(tmp_path / "c")
    ).awaitTermination(120)
    run()
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["change_type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Created", "Created", "Deleted"]


def test_drift_alarms_fire_once_until_resolved(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (1, 10, [1.0, 0.0]), (1, 20, [0.0, 1.0]), (1, 25, [0.0, 1.0]), (1, 40, [0.0, 1.0]), (1, 55, [1.0, 0.0])], "id long, vf long, embedding array<double>"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = changefeed.drift_alarm_stream(stream, 0.5, 10).writeStream.format("memory").queryName("alarms").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["vf"] for r in spark.table("alarms").orderBy("vf").collect()] == [20, 55]


def test_hash_chain_finds_a_changed_row(spark):
    w = spark.createDataFrame([(1, k, k, k, "update", float(k)) for k in range(4)], "id long, version_id long, vf long, tf long, op string, value double")
    chain = PV.hash_chain(w, ["version_id", "value"])
    assert PV.verify_chain(w, ["version_id", "value"], chain).count() == 0
    forged = w.withColumn("value", F.when(F.col("version_id") == 2, 9.0).otherwise(F.col("value")))
    assert sorted(r["version_id"] for r in PV.verify_chain(forged, ["version_id", "value"], chain).collect()) == [2, 3]
