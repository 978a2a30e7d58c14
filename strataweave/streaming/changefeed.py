"""Change streams over an append-only folder of writes, and drift alarms on a stream of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def change_stream(
    spark: SparkSession, path: str, schema: StructType, labels: list[str] | None = None, change_types: list[str] | None = None, namespaces: list[str] | None = None
) -> DataFrame:
    """Changes as they are appended; a write's kind comes from its op and from whether it opens its entity (column first)."""
    rows = spark.readStream.schema(schema).parquet(path)
    kind = F.when(F.col("op").isin("retract", "delete"), "Deleted").when(F.col("first"), "Created").otherwise("Modified")
    rows = rows.withColumn("change_type", kind)
    for column, wanted in (("label", labels), ("change_type", change_types), ("namespace", namespaces)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows


def subscribe(changes: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append changes to a Parquet sink; the checkpoint is the resume token, and gives each change once."""
    writer = changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(changes: DataFrame, time_column: str, size: str, late: str) -> DataFrame:
    """Changes per tumbling window and kind; rows later than the watermark are left out."""
    return changes.withWatermark(time_column, late).groupBy(F.window(time_column, size), "change_type").agg(F.count("*").alias("n"))


def drift_alarm_stream(vectors: DataFrame, theta: float, window_us: int) -> DataFrame:
    """vectors: id, vf, embedding.  (id, vf, distance): fires where a vector lies strictly further than theta, in cosine
    distance, from the entity's vector window_us before; an entity with an open alarm stays silent until a vector
    comes back within theta.  The state holds the vectors of one window and the last before it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        times, values, open_alarm = state.get if state.exists else ([], [], False)
        times, values = list(times), [list(v) for v in values]
        fired = []
        for r in pd.concat(list(parts)).sort_values("vf").itertuples():
            times.append(int(r.vf))
            values.append([float(x) for x in r.embedding])
            while len(times) > 1 and times[1] <= r.vf - window_us:
                times.pop(0)
                values.pop(0)
            if times[0] <= r.vf - window_us:
                a, b = np.array(values[-1]), np.array(values[0])
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1 - (float(a @ b) / norm if norm > 1e-12 else 0.0)
                if d > theta and not open_alarm:
                    fired.append((key[0], int(r.vf), d))
                open_alarm = d > theta
        state.update((times, values, open_alarm))
        yield pd.DataFrame(fired, columns=["id", "vf", "distance"])

    return vectors.groupBy("id").applyInPandasWithState(
        step,
        "id long, vf long, distance double",
        "times array<long>, vectors array<array<double>>, open boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )
