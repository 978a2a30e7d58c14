"""Export of nodes, edges and histories to Parquet, and text forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal as TP


def _overflow(df: DataFrame, own: list[str], typed: list[str]) -> DataFrame:
    """own and typed columns as they are, all others as JSON in properties_json."""
    rest = [c for c in df.columns if c not in own and c not in typed]
    json = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return df.select(*own, *typed, json.alias("properties_json"))


def export_nodes(nodes: DataFrame, path: str, typed: list[str] = (), partition_by_label: bool = True) -> None:
    out = _overflow(nodes, [c for c in ("id", "label", "valid_time") if c in nodes.columns], list(typed))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy("label") if partition_by_label and "label" in out.columns else writer).parquet(path)


def export_edges(edges: DataFrame, path: str, typed: list[str] = ()) -> None:
    _overflow(edges, ["eid", "src", "dst", "label"], list(typed)).write.mode("errorifexists").parquet(path)


def history_rows(writes: DataFrame, typed: list[str] = ()) -> DataFrame:
    """One row per write: version, valid and transaction intervals, tombstone, provenance and properties."""
    h = TP.history(writes)
    gone = F.col("op").isin("delete", "retract")
    own = h.withColumns(
        {
            "version": F.col("version_number"), "valid_from": F.col("vf"), "valid_to": F.when(gone, F.col("vf")).otherwise(F.lit(TP.OPEN)),
            "tx_time": F.col("tf"), "tombstone": gone, "provenance_source": F.col("source") if "source" in writes.columns else F.lit(None).cast("string"),
        }
    )
    keep = ["id", "version", "valid_from", "valid_to", "tx_time", "tx_to", "tombstone", "provenance_source"]
    return _overflow(own.drop("vf", "tf", "version_number"), keep, list(typed))


def export_history(writes: DataFrame, path: str, typed: list[str] = ()) -> None:
    history_rows(writes, typed).write.mode("errorifexists").parquet(path)


def audit_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, digest): a digest of each row's canonical JSON, for later comparison."""
    return df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))
