"""Incremental runs: each start takes the files that have arrived since the last one and ends.

The checkpoint remembers files, the state table remembers which (dataverse, repo_id, package) have been counted, so a batch that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.operators import imports, statuses

SCRIPT = "path STRING, text STRING"
KEYS = ["dataverse", "repo_id", "package"]


def incremental_tally(spark: SparkSession, landing: str, state: str, checkpoint: str, schema: str = SCRIPT) -> DataFrame:
    """Takes in the scripts (Parquet, path and text) that are new in landing, and gives the tally of all so far."""
    def add(batch: DataFrame, batch_id: int) -> None:
        found = imports.import_rows(batch).where(F.col("dataverse").isNotNull() & F.col("repo_id").isNotNull()).select(*KEYS).distinct()
        known = _known(batch.sparkSession, state)
        if known is not None:  # what this batch wrote in an earlier try is replaced, not joined away
            found = found.join(known.where(F.col("batch") != batch_id).select(*KEYS), KEYS, "left_anti")
        found.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={batch_id}")

    query = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    known = _known(spark, state)
    if known is None:
        return spark.createDataFrame([], "package string, count bigint")
    return known.groupBy("package").agg(F.count("*").alias("count"))


def _known(spark: SparkSession, state: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("dataverse string, repo_id string, package string, batch long").parquet(state)


def streaming_tally(scripts: DataFrame) -> DataFrame:
    """The same tally as one streaming query, for complete output mode: state holds one row for each key counted."""
    found = imports.import_rows(scripts).where(F.col("dataverse").isNotNull() & F.col("repo_id").isNotNull())
    return found.select(*KEYS).dropDuplicates(KEYS).groupBy("package").agg(F.count("*").alias("count"))


def resume(spark: SparkSession, todo: DataFrame, done_path: str, work, force: bool = False) -> DataFrame:
    """Runs work (DataFrame of repo_id -> DataFrame of repo_id, status, …) over what has no status yet, appends its statuses and gives them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    left = statuses.remaining(todo, spark.read.parquet(done_path), force=force) if exists else todo
    work(left).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def windowed_statuses(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: statuses by event time, late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
