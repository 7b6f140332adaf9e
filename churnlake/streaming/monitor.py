"""Structured Streaming: score arriving customers, watch churn indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from churnlake.functions.expressions import ratio


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def score_stream(arriving: DataFrame, rescore: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Stateless scoring: the batch scorer applied to a stream."""
    return rescore(arriving).select(id_col, "score")


def indicator_windows(
    events: DataFrame,
    time: str = "ts",
    indicator: str = "event_type",
    window: str = "1 day",
    lateness: str = "1 hour",
) -> DataFrame:
    """Events per time window and indicator. On a stream, rows later than the watermark are dropped
    and a window is emitted once it is closed; on a batch the watermark has no effect."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, lateness)
        .groupBy(F.window(time, window), indicator)
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            indicator,
            "n",
            "total",
        )
    )


def alert_share(windows: DataFrame, indicator: str = "event_type", alert: str = "error") -> DataFrame:
    """Share of the alert indicator per window."""
    return windows.groupBy("window_start").agg(
        F.sum("n").alias("n"),
        ratio(F.sum(F.when(F.col(indicator) == alert, F.col("n")).otherwise(0)), F.sum("n")).alias("alert_share"),
    )


def append_to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet folder, with progress kept in ``checkpoint`` for restarts."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
