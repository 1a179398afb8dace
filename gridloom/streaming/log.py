"""The attempt log as a stream: appended records flow into a table, exactly once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def status_counts(spark: SparkSession, log_path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(log_path).groupBy("status").agg(F.count("*").alias("n"))


def copy_new(spark: SparkSession, log_path: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is new in the log to another table and stop."""
    return spark.readStream.schema(schema).parquet(log_path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
