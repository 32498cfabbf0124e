"""Nightly refresh: take in newly landed snapshot files and serve the newest copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.sources.files import file_path, keep_latest


def ingest_snapshots(spark: SparkSession, landing: str, schema: str, table: str, progress: str) -> None:
    """Append every new dated CSV file to one table partitioned by the date in its name, then stop.

    `progress` is the folder that remembers which files were taken; both folders must be shared.
    """
    date = F.to_date(F.regexp_extract(F.regexp_extract(file_path(), r"[^/]*$", 0), r"(\d{4}-\d{2}-\d{2})", 1))
    landed = spark.readStream.schema(schema).option("header", True).csv(landing)
    query = (
        landed.withColumn("snapshot_date", date)
        .writeStream.format("parquet")
        .partitionBy("snapshot_date")
        .option("path", table)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_snapshot(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Rows of the newest snapshot of each key."""
    return keep_latest(spark.read.parquet(table), keys, "snapshot_date")
