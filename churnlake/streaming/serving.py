"""Serving scores from a stream that survives restarts and takes up new models between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from churnlake.functions.expressions import quoted
from churnlake.operators.models import Fitted, load_model, save_model

VERSIONS = "version int, path string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _versions(spark: SparkSession, registry: str) -> DataFrame:
    folder = f"{registry}/versions"
    return spark.read.schema(VERSIONS).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], VERSIONS)


def publish_model(spark: SparkSession, fitted: Fitted, registry: str) -> int:
    """Save a model as the next version of a registry folder. It is listed only once it is complete, so a stream never
    sees half of it."""
    version = (_versions(spark, registry).agg(F.max("version")).first()[0] or 0) + 1
    path = f"{registry}/models/{version}"
    save_model(fitted, path)
    spark.createDataFrame([(version, path)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{registry}/versions")
    return version


def newest_model(spark: SparkSession, registry: str) -> tuple[int, Fitted]:
    row = _versions(spark, registry).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError("no model is published")
    return row["version"], load_model(spark, row["path"])


def serve_scores(
    arriving: DataFrame,
    registry: str,
    target: str,
    checkpoint: str,
    id_col: str,
    once: bool = False,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Score a stream with the newest published model; read the results with ``served_scores``.

    Every batch has a folder of its own, named by its number. A batch that is replayed after a failure finds its folder
    complete and leaves it, or overwrites an incomplete one, so no row is lost or doubled and none changes its model. A
    model published between two batches serves from the next one on. ``after_batch`` is called with the number of each
    batch once it is written.
    """
    loaded: dict[int, Fitted] = {}

    def write(rows: DataFrame, batch: int) -> None:
        spark, path = rows.sparkSession, f"{target}/batch={batch}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            newest = _versions(spark, registry).agg(F.max("version")).first()[0]
            if newest not in loaded:
                loaded.clear()
                loaded[newest] = newest_model(spark, registry)[1]
            scored = loaded[newest].score(rows).select(F.col(quoted(id_col)), "score", F.lit(newest).alias("version"))
            scored.write.mode("overwrite").parquet(path)
        if after_batch:
            after_batch(batch)

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def served_scores(spark: SparkSession, target: str) -> DataFrame:
    """id, score, version, batch of all batches that are complete."""
    return spark.read.parquet(target)
