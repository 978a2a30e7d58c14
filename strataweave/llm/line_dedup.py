"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id.  The line keys of a batch are
merge-anti-joined with the runs of earlier batches: a key found there has a smaller
holder, so all its lines in the batch go; a new key keeps its lines in its smallest
document of the batch, and joins the runs.  Runs are tables of 128-bit hashes, bucketed
and sorted by hash, so that a batch's keys, which their aggregation has bucketed alike,
meet them in merge joins without moving or sorting a run again.  When a level has FANOUT
runs they are merged, bucket by bucket, into one of the next.  All of it is built-in column expressions; no Python runs on the executors.

Defined results
* null or empty text: one empty line, which is too short to be dropped.
* null doc_id: a document that comes after all others; such rows count as one.
* rows that share a doc_id are one document: they do not make each other's lines go.
* doc_id must be of an integer type (checked): batches are ranges of it.
* an empty table gives an empty result; extra columns are ignored unless carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, release, shared_dir, spool

SPACES = " \t\n\x0b\f\r"
MIN_CODE_POINTS = 10
BATCHES = 3
FANOUT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 63) - 1


class LineRuns:
    """Levels of bucketed, sorted runs of line hashes (h1, h2) in a shared folder; no hash is in two runs."""

    #: Lets the planner rely on the order of buckets of one file each.
    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.was = spark.conf.get(self.ORDERED)
        spark.conf.set(self.ORDERED, "true")

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with known: whether a run holds the key.  An anti-join that keeps both sides."""
        known = F.lit(False)
        for k, name in enumerate(name for level in self.levels for name in level):
            run = self.spark.table(name).withColumn(f"in_{k}", F.lit(True))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
            known = known | F.col(f"in_{k}").isNotNull()
        return keys.withColumn("known", known)

    def add(self, keys: DataFrame) -> None:
        """Add keys that no run holds as a run; compact the levels that are full."""
        self._write(keys.repartition(self.buckets, "h1", "h2"), 0)

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}")
        writer.format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:  # buckets of equal hashes are merged where they lie
                merged = merged.join(self.spark.table(other).hint("merge"), ["h1", "h2"], "full_outer")
            self._write(merged.select("h1", "h2"), level + 1)
            for old in full:
                self._drop(old)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        for name in (name for level in self.levels for name in level):
            self._drop(name)
        drop_path(self.spark, self.root)
        self.spark.conf.set(self.ORDERED, self.was)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str]) -> DataFrame:
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be of an integer type, not {kind.simpleString()}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("at_doc"),
        F.xxhash64(text).alias("at_text"),
        text.alias("text"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
    )


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(at_doc, at_text, pos) of each line that goes: document, text hash, position from 0."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col, ())
    cuts = rows.agg(F.percentile_approx("at_doc", [k / batches for k in range(1, batches)], 10000).alias("c")).first()["c"]
    batch = sum((F.when(F.col("at_doc") > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    lines = (
        rows.select("at_doc", "at_text", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("at_doc", "at_text", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= MIN_CODE_POINTS)
        .select(
            "at_doc",
            "at_text",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            batch.cast("int").alias("batch"),
        )
    )
    lines = spool(lines, "batch")
    runs = LineRuns(spark, f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}")
    out = None
    try:
        for b in range(batches):
            own = lines.where(F.col("batch") == b).drop("batch")
            keys = own.groupBy("h1", "h2").agg(F.min("at_doc").alias("first"), F.max("at_doc").alias("last"))
            keys = spool(runs.marked(keys).select("h1", "h2", "first", "last", "known"))
            if b + 1 < batches:
                runs.add(keys.where(~F.col("known")).select("h1", "h2"))
            repeated = spool(keys.where(F.col("known") | (F.col("last") > F.col("first"))))
            release(keys)
            drops = (
                own.join(repeated.hint("merge"), ["h1", "h2"])
                .where(F.col("known") | (F.col("at_doc") > F.col("first")))
                .select("at_doc", "at_text", "pos")
            )
            out = drops if out is None else out.unionByName(drops)
    finally:
        runs.close()
    return out


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = BATCHES,
    carry: Iterable[str] = (),
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the carried columns, one row per input row."""
    carry = list(carry)
    drops = dropped_lines(docs, id_col, text_col, batches)
    drops = drops.groupBy("at_doc", "at_text").agg(F.collect_set("pos").alias("gone"))
    rows = _rows(docs, id_col, text_col, carry).join(drops.hint("merge"), ["at_doc", "at_text"], "left")
    rows = rows.select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"), "carried")
    lines = F.col("lines")
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(rest, lambda i: lines[i]), "\n"))
        .alias("kept_text"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT l.*, coalesce(k.n >= 2 AND l.doc_id > k.first, false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
