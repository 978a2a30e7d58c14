"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from .bpe import bpe
from .common import table
from .decontamination import benchmark_leaks
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .near_dedup import near_duplicates
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .secret_scan import digest, secret_scan
from .sharding import shard_documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op5_line_dedup": lines.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding,
        op2_decontamination,
        op3_quality_classifier,
        op4_license_scan,
        op5_line_dedup,
        op6_bpe,
        op7_lm_scoring,
        op8_secret_scan,
        op9_near_dedup,
        op10_quality_rules,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
