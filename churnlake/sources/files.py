"""Reading and writing customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from churnlake.functions.expressions import nan_to_null
from churnlake.schema import BANK


def read_customers(spark: SparkSession, path: str, schema: T.StructType = BANK, source: str = "csv") -> DataFrame:
    """Customers with a fixed schema; NaN becomes NULL. CSV headers are checked against the schema."""
    reader = spark.read.schema(schema)
    if source == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return nan_to_null(reader.format(source).load(path))


def write_customers(df: DataFrame, path: str, source: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(source)
    if source == "csv":
        writer = (
            writer.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.save(path)


def preview(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    return df.orderBy(id_col).limit(n)
