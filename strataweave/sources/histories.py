"""Imports of other databases' histories: document versions and datom logs, both in EDN.

Each import gives (node writes, edge writes, rejected).  Node writes are a history
(id, version_id, vf, tf, op) with key, label and properties_json; edge writes have eid as
id, src, dst and label.  A file is parsed by one task, value by value, so a large export
should be split into files of whole entities or datoms; a file is at most 2 GB.
on_error "abort" fails the job at the first bad value, "skip" lists it in rejected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RETRACT
from ..shipping import ship
from . import edn

BATCH = 2_000
#: Bytes of an attribute schema that the driver reads.
MAX_SCHEMA = 10 << 20


def _read(spark: SparkSession, path: str, rows: Callable[[Any], Iterator[tuple]], schema: str, on_error: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected: reason).  rows turns one element of a file into tuples of the schema."""
    ship(spark)
    names = [c.split()[0] for c in schema.split(", ")]

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                out: list[tuple] = []
                try:
                    for element in edn.elements(bytes(content).decode()):
                        try:
                            if not isinstance(element, dict):
                                raise edn.EdnError(f"{element!r} is no map")
                            out.extend((*row, None) for row in rows(element))
                        except (edn.EdnError, TypeError, ValueError, KeyError, AttributeError) as e:
                            out.append((*[None] * len(names), f"{e}"[:200]))
                        if len(out) >= BATCH:
                            yield pd.DataFrame(out, columns=[*names, "reason"], dtype=object)
                            out = []
                except (edn.EdnError, UnicodeDecodeError) as e:
                    out.append((*[None] * len(names), f"unreadable: {e}"[:200]))
                yield pd.DataFrame(out, columns=[*names, "reason"], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    all_rows = files.mapInPandas(parsed, f"{schema}, reason string")
    if on_error == "abort":
        all_rows = all_rows.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("boolean")).otherwise(True))
    return all_rows.where("reason is null").drop("reason"), all_rows.where("reason is not null").select("reason")


def _text(v: Any) -> str | None:
    """A scalar as business key; None for other values."""
    return None if v is None or isinstance(v, bool | float | list | dict) else str(v)


def _node_id(key: str):
    return F.xxhash64(F.lit("node"), F.col(key))


def import_document_history(
    spark: SparkSession, path: str, label_field: str = "type", default_label: str = "Entity", refs: dict[str, str] | None = None, detect_refs: bool = True, on_error: str = "abort"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities {:xt/id key :history [{:valid-time :valid-to :tx-time :tx-id :doc}]}; keys are read by local name.

    A segment is a write at its valid time, recorded at its transaction time; one without a
    document retracts the entity, and so does a valid-to that the next segment does not meet.
    A field of refs (field -> edge label), or by detect_refs any that holds another entity's
    key, alone or in a collection, is an edge and no property.  An edge is written by each
    segment that has it and retracted when either end is.  Fields without a known target
    stay properties; those in refs are rejected instead.
    """
    refs = dict(refs or {})

    def segments(entity: dict) -> Iterator[tuple]:
        key = _text(local_id := edn.local_get(entity, "id"))
        if key is None:
            raise edn.EdnError(f"an entity without id: {local_id!r}")
        for s in edn.local_get(entity, "history") or []:
            vf, tx, doc = edn.local_get(s, "valid-time"), edn.local_get(s, "tx-id") or 0, edn.local_get(s, "doc")
            if not isinstance(vf, int):
                raise edn.EdnError(f"{key}: a segment without valid time")
            tf = edn.local_get(s, "tx-time")
            tf = vf if tf is None else tf
            if doc is None:
                yield key, vf, tf, tx, None, None, None, None
                continue
            if not isinstance(doc, dict):
                raise edn.EdnError(f"{key}: a document that is no map")
            own = {edn.Keyword(k).local: v for k, v in doc.items() if edn.Keyword(k).local not in ("id", "content-hash")}
            label = _text(own.pop(label_field, None)) or default_label
            targets = {f: [x for x in map(_text, v if isinstance(v, list) else [v]) if x is not None] for f, v in own.items()}
            targets = {f: v for f, v in targets.items() if v and (detect_refs or f in refs)}
            yield key, vf, tf, tx, edn.local_get(s, "valid-to"), label, {f: json.dumps(v) for f, v in own.items()}, targets

    schema = "key string, vf long, tf long, tx long, valid_to long, label string, doc map<string,string>, targets map<string,array<string>>"
    rows, rejected = _read(spark, path, segments, schema, on_error)
    order = Window.partitionBy("key").orderBy("vf", "tx")
    rows = rows.withColumns({"version_id": 2 * F.row_number().over(order), "next_vf": F.lead("vf").over(order)})
    links = rows.where("targets is not null").select("key", "version_id", "vf", "tf", F.explode("targets").alias("field", "ends"))
    links = links.select("key", "version_id", "vf", "tf", "field", F.explode(F.array_distinct("ends")).alias("end"))
    keys = rows.select(F.col("key").alias("end")).distinct().withColumn("known", F.lit(True))
    links = links.join(keys, "end", "left")
    named = F.col("field").isin(*refs) if refs else F.lit(False)
    lost = links.where(named & F.col("known").isNull())
    rejected = rejected.unionByName(lost.select(F.concat_ws(" ", "key", "field", "end", F.lit("has no target")).alias("reason")).distinct())
    hit = links.where(F.col("known"))
    # fields that became edges leave the properties of their version
    gone = links.where(named | F.col("known")).groupBy("key", "version_id").agg(F.collect_set("field").alias("gone"))
    live = rows.where("doc is not null").join(gone, ["key", "version_id"], "left")
    kept = F.map_filter("doc", lambda f, _: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), f))
    closing = F.col("valid_to").isNotNull() & (F.col("next_vf").isNull() | (F.col("next_vf") > F.col("valid_to")))
    columns = ["key", "version_id", "vf", "tf", "op", "label", "properties_json"]
    nothing = F.lit(None).cast("string")
    ends = rows.where("doc is null").select("key", "version_id", "vf", "tf")
    ends = ends.unionByName(rows.where(F.col("doc").isNotNull() & closing).select("key", (F.col("version_id") + 1).alias("version_id"), F.col("valid_to").alias("vf"), "tf"))
    writes = live.select("key", "version_id", "vf", "tf", F.lit("update").alias("op"), "label", _json(kept))
    ends = ends.withColumns({"op": F.lit(RETRACT), "label": nothing, "properties_json": nothing})
    nodes = writes.unionByName(ends).select(_node_id("key").alias("id"), *columns)

    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in refs.items() for x in kv]), F.col("field")), F.upper("field")) if refs else F.upper("field")
    hit = hit.select("key", "end", "version_id", "vf", "tf", label.alias("label"))
    pairs = hit.select("key", "end", "label").distinct()
    stops = [pairs.join(ends.select(F.col("key").alias(side), "version_id", "vf", "tf"), side) for side in ("key", "end")]
    edges = hit.withColumn("op", F.lit("update"))
    for stop in stops:
        edges = edges.unionByName(stop.withColumn("op", F.lit(RETRACT)))
    edges = edges.select(F.xxhash64("key", "label", "end").alias("id"), _node_id("key").alias("src"), _node_id("end").alias("dst"), "label", "version_id", "vf", "tf", "op")
    return nodes, edges, rejected


def _json(properties):
    """A map of JSON texts as one JSON object, keys in order."""
    entries = F.array_sort(F.map_entries(properties))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}")).alias("properties_json")


def attribute_schema(spark: SparkSession, path: str) -> dict[str, dict[str, Any]]:
    """{attribute: {ref, many, edge_label}} of a schema map; the file is at most MAX_SCHEMA bytes (checked)."""
    rows = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= MAX_SCHEMA, F.col("content")).alias("content")).limit(2).collect()
    if len(rows) != 1 or rows[0]["content"] is None:
        raise ValueError(f"an attribute schema is one file of at most {MAX_SCHEMA} bytes")
    out = {}
    for name, about in (kv for m in edn.parse(bytes(rows[0]["content"]).decode()) for kv in m.items()):
        kind, many = edn.local_get(about, "valueType"), edn.local_get(about, "cardinality")
        out[str(name)] = {"ref": str(kind).endswith("ref"), "many": str(many).endswith("many"), "edge_label": edn.local_get(about, "edge-label")}
    return out


def import_datoms(
    spark: SparkSession, path: str, schema: dict[str, dict[str, Any]], label_attribute: str | None = None, valid_time_attribute: str | None = None, many: str = "last", on_error: str = "abort"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datoms {:e :a :v :tx :tx-instant :op}: one write per entity and transaction that touches it.

    A write carries all properties in force, under their local names.  Valid time is the instant
    of the transaction, or the value that it asserts for valid_time_attribute.  Attributes of the
    schema that are references make edges, closed by their retraction.  Scalars of many values
    keep the last one asserted, or with many="list" the array of those in force, in order.  The label is the value
    of label_attribute or the namespace of the entity's first attribute.  Attributes of the
    database itself (:db/..., :db.install/...) and references to unknown entities are rejected.
    """

    def datom(d: dict) -> Iterator[tuple]:
        e, a, v = _text(d["e"]), str(d["a"]), d["v"]
        if e is None or not isinstance(d["tx"], int) or not isinstance(d["tx-instant"], int) or not isinstance(d["op"], bool):
            raise edn.EdnError(f"a datom without entity, transaction, instant or op: {d}")
        own = a.startswith("db/") or a.startswith("db.")
        yield e, a, json.dumps(v), _text(v), d["tx"], d["tx-instant"], d["op"], own

    rows, rejected = _read(spark, path, datom, "e string, a string, v string, target string, tx long, at long, op boolean, own boolean", on_error)
    rejected = rejected.unionByName(rows.where("own").select(F.concat(F.lit("unsupported attribute "), "a").alias("reason")))
    rows = rows.where("not own").drop("own")
    ref_names, many_names = [a for a, s in schema.items() if s["ref"]], [a for a, s in schema.items() if s["many"]]
    is_ref = F.col("a").isin(*ref_names) if ref_names else F.lit(False)
    of_many = F.col("a").isin(*many_names) if many_names else F.lit(False)

    named = F.when(F.col("a") == label_attribute, F.get_json_object(F.concat(F.lit('{"x": '), "v", F.lit("}")), "$.x")) if label_attribute else F.lit(None).cast("string")
    space = F.initcap(F.when(F.contains("a", F.lit("/")), F.substring_index("a", "/", 1)))
    labels = rows.groupBy("e").agg(F.coalesce(F.max(named), F.min_by(space, F.struct("tx", "a")), F.lit("Entity")).alias("label"))
    said = F.when((F.col("a") == valid_time_attribute) & F.col("op"), F.col("v").cast("long")) if valid_time_attribute else F.lit(None).cast("long")
    versions = rows.groupBy("e", "tx").agg(F.max("at").alias("tf"), F.coalesce(F.max(said), F.max("at")).alias("vf"))

    # of one transaction, an assertion counts more than a retraction
    slot = F.when(of_many, F.col("v")).otherwise(F.lit(""))
    scalars = rows.where(~is_ref).groupBy("e", "a", slot.alias("slot"), "tx").agg(F.max_by(F.struct("op", "v", "tx"), F.struct("op", "v")).alias("said"))
    # each property's last word is carried over the entity's later versions: as many rows as the result has values
    grid = versions.select("e", "tx").join(scalars.groupBy("e", "a", "slot").agg(F.min("tx").alias("first")), "e").where("tx >= first")
    carried = F.last("said", ignorenulls=True).over(Window.partitionBy("e", "a", "slot").orderBy("tx"))
    state = grid.join(scalars, ["e", "a", "slot", "tx"], "left").withColumn("said", carried).where("said.op")
    values = state.groupBy("e", "tx", F.substring_index("a", "/", -1).alias("k")).agg(
        F.array_sort(F.collect_list("said.v")).alias("vs"), F.max_by("said.v", F.struct("said.tx", "said.v")).alias("last"), F.max(of_many).alias("of_many")
    )
    value = F.when(F.col("of_many") & F.lit(many == "list"), F.concat(F.lit("["), F.array_join("vs", ", "), F.lit("]"))).otherwise(F.col("last"))
    properties = values.groupBy("e", "tx").agg(F.map_from_entries(F.collect_list(F.struct("k", value.alias("v")))).alias("m"))
    out = versions.join(properties, ["e", "tx"], "left").join(labels, "e")
    empty = F.coalesce(F.col("m"), F.create_map().cast("map<string,string>"))
    nodes = out.select(_node_id("e").alias("id"), F.col("e").alias("key"), F.col("tx").alias("version_id"), "vf", "tf", F.lit("update").alias("op"), "label", _json(empty))

    label_of = {a: s["edge_label"] or edn.Keyword(a).local.upper() for a, s in schema.items() if s["ref"]}
    label = F.element_at(F.create_map(*[F.lit(x) for kv in label_of.items() for x in kv]), F.col("a")) if label_of else F.lit(None).cast("string")
    said = rows.where(is_ref).groupBy("e", "a", "target", "tx").agg(F.max("op").alias("op"))
    said = said.join(versions, ["e", "tx"]).join(versions.select(F.col("e").alias("target")).distinct().withColumn("known", F.lit(True)), "target", "left")
    rejected = rejected.unionByName(said.where("known is null").select(F.concat_ws(" ", "e", "a", "target", F.lit("has no target")).alias("reason")))
    edges = said.where("known").select(
        F.xxhash64("e", "a", "target").alias("id"), _node_id("e").alias("src"), _node_id("target").alias("dst"), label.alias("label"), F.col("tx").alias("version_id"), "vf", "tf",
        F.when(F.col("op"), "update").otherwise(RETRACT).alias("op"),
    )
    return nodes, edges, rejected
