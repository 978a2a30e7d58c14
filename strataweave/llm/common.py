"""Helpers shared by the training-data operators: inputs, spooled tables, settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

__all__ = ["drop_path", "release", "shared_dir", "ship", "spool", "table"]

_spools: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may do without the setting; it then gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spool(df: DataFrame, *partition_by: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors, as checkpoint() does, but keeps
    the columns prunable and compressed.  The files go with release(), or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    _spools[path] = spark
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def release(*spooled: DataFrame) -> None:
    """Delete the files of spooled tables that nothing reads any more."""
    for df in spooled:
        path = getattr(df, "_spool_path", None)
        if path in _spools:
            drop_path(_spools.pop(path), path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_spools() -> None:
    for path, spark in _spools.items():
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the JVM may be gone by now; the folder is scratch space
            return


atexit.register(_drop_spools)
