"""The event log as a stream: files of JSON lines in, appended lines or the latest state of every job out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.operators.events import latest, states_of

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)


def job_states(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The newest event of each job in update mode: the state kept is one row a job, and every batch writes the jobs that it changed."""
    rows = latest(events, "user_id")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The jobs' states as of the last batch: a batch that was tried again has written the same rows to the same place."""
    changes = spark.read.parquet(path).drop("batch")
    newest = changes.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")).select("user_id", "last.*")
    return states_of(newest)
