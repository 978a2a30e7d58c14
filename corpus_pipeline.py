"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet in the shared folder and rereads them as the next one's docs.
All stages but the last return the columns of `documents`.

Defined results
* null and empty texts go through every stage by its operator's rule.
* rows with a null doc_id are judged like others; where a decision is joined back by
  doc_id, nulls match nulls.
* rows that share a doc_id share that document's decisions.
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import registry
from strataweave.llm.bpe import bpe
from strataweave.llm.common import spool, table
from strataweave.llm.decontamination import benchmark_leaks
from strataweave.llm.line_dedup import line_dedup
from strataweave.llm.near_dedup import near_duplicates
from strataweave.llm.quality_classifier import quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is among wanted's (left_semi), or is not (left_anti); nulls match nulls."""
    wanted = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scores = quality_classifier(docs, table(spark, sf_dir, "labels"))
    return _only(docs.select(*COLUMNS), scores.where("predicted = 0"), "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document whose lines have all gone goes too."""
    out = line_dedup(docs, carry=("lang", "source"))
    out = out.where((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_dropped") == 0))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id; of wholly equal rows one."""
    classes = near_duplicates(docs)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    out = _only(docs.select(*COLUMNS), kept, "left_semi").withColumn("_text", F.xxhash64("text"))
    return out.dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return _only(docs.select(*COLUMNS), benchmark_leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids, and of the text decoded from them."""
    return bpe(docs, registry.tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("BPE", tokens),
]

#: SQL cannot express the classifier, the signatures or the latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
    return docs
