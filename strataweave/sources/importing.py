"""Bulk import of nodes and edges from CSV, JSON lines and Parquet, with reports of what was skipped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import OPEN

CORRUPT = "_corrupt_record"


@dataclass
class Mapping:
    """Which columns hold the key (or the ends), the label, valid time and typed properties."""

    label: str | None = None
    label_column: str | None = None
    key: str = "key"
    source_key: str = "src_key"
    target_key: str = "dst_key"
    columns: dict[str, str] = field(default_factory=dict)
    valid_time: str | None = None
    on_error: str = "abort"


def _read(spark: SparkSession, kind: str, path: str, mapping: Mapping, own: list[str]) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    extra = [c for c in (mapping.label_column, mapping.valid_time) if c]
    names = list(dict.fromkeys([*own, *extra, *mapping.columns]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if mapping.on_error == "abort" else "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("header", True).option("enforceSchema", False).csv(path) if kind == "csv" else reader.json(path)


def _typed(raw: DataFrame, mapping: Mapping, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected with reason): values that do not fit their type reject the row, or fail the import."""
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("unreadable"))] if CORRUPT in raw.columns else []
    reasons += [F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in own]
    typed = {c: F.expr(f"try_cast(`{c}` AS {kind})") for c, kind in mapping.columns.items()}
    reasons += [F.when(F.col(c).isNotNull() & v.isNull(), F.lit(f"{c} is no {mapping.columns[c]}")) for c, v in typed.items()]
    marked = raw.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")) if reasons else F.lit(None).cast("string"))
    if mapping.on_error == "abort":
        bad = F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason"))).otherwise(F.lit(True))
        marked = marked.where(bad.cast("boolean"))
    good = marked.where("reason is null")
    label = F.col(mapping.label_column) if mapping.label_column else F.lit(mapping.label)
    vf = F.expr(f"try_cast(`{mapping.valid_time}` AS BIGINT)") if mapping.valid_time else F.lit(0)
    rows = good.select(*own, label.alias("label"), F.coalesce(vf.cast("long"), F.lit(0)).alias("valid_from"), F.lit(OPEN).alias("valid_to"), *[v.alias(c) for c, v in typed.items()])
    return rows, marked.where("reason is not null").select(*own, "reason")


def import_nodes(spark: SparkSession, kind: str, path: str, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """kind: csv, json or parquet.  (nodes with id and key, rejected).  The id is a hash of label and key, so imports are repeatable."""
    rows, rejected = _typed(_read(spark, kind, path, mapping, [mapping.key]), mapping, [mapping.key])
    return rows.withColumn("id", F.xxhash64("label", F.col(mapping.key).cast("string"))), rejected


def import_edges(spark: SparkSession, kind: str, path: str, mapping: Mapping, nodes: DataFrame, node_key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): ends are found by business key; edges without one are reported."""
    ends = [mapping.source_key, mapping.target_key]
    rows, rejected = _typed(_read(spark, kind, path, mapping, ends), mapping, ends)
    keys = nodes.select(F.col(node_key).cast("string").alias("k"), F.col("id").alias("i"))
    out = rows.join(keys.toDF(ends[0], "src"), ends[0], "left").join(keys.toDF(ends[1], "dst"), ends[1], "left")
    lost = F.when(F.col("src").isNull(), "unknown source").when(F.col("dst").isNull(), "unknown target")
    rejected = rejected.unionByName(out.where(lost.isNotNull()).select(*ends, lost.alias("reason")))
    edges = out.where(lost.isNull()).withColumn("eid", F.xxhash64("label", *ends, "valid_from"))
    return edges.drop(*ends), rejected


def admin_csv_header(header: str) -> dict[str, str]:
    """Columns of a typed admin-import header, name:TYPE, as Spark types; ids, labels and ends keep their marker."""
    kinds = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string", "": "string"}
    out = {}
    for part in header.split(","):
        name, _, kind = part.strip().partition(":")
        kind = kind.partition("(")[0]
        out[name or kind.lower()] = kind if kind in ("ID", "LABEL", "START_ID", "END_ID", "TYPE", "IGNORE") else "array<string>" if kind.endswith("[]") else kinds[kind.lower()]
    return out


def import_admin_nodes(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Nodes of a headerless admin CSV: key, label (first of a list) and typed properties."""
    columns = admin_csv_header(header)
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in columns])).csv(path)
    out = []
    for name, kind in columns.items():
        if kind == "ID":
            out.append(F.col(name).alias("key"))
        elif kind == "LABEL":
            out.append(F.split(name, ";")[0].alias("label"))
        elif kind == "array<string>":
            out.append(F.split(name, ";").alias(name))
        elif kind != "IGNORE":
            out.append(F.expr(f"try_cast(`{name}` AS {kind})").alias(name))
    return raw.select(*out)
