"""Results of cases as a stream: each case is appended once, however often the stream is stopped, started again or fed with it; and progress.

A batch is written beside the store and then renamed into it, so that readers see whole batches only, and a batch that is tried again
after that is passed over. Of rows of one case in a batch the first by an order stays, and none if an earlier batch has the case. Rows
without a case aren't results and are dropped. Renaming has to be atomic, as in HDFS and local file systems; one stream writes a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def moved(spark: SparkSession, source: str, target: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be renamed to {target}")


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_batch(rows: DataFrame, number: int, path: str, case: str, order: list[str]) -> bool:
    """Appends what a batch has of new cases; False where the store has the batch."""
    spark, target = rows.sparkSession, f"{path}/batch={number:09d}"
    if there(spark, target):
        return False
    first = F.row_number().over(Window.partitionBy(case).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    new = rows.where(F.col(case).isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    if there(spark, path):
        # the batch is small beside the store: the store's cases are cut to the batch's before they meet its rows
        seen = spark.read.schema(rows.select(case).schema).parquet(path).join(rows.select(case).distinct(), case, "left_semi")
        new = new.join(seen, case, "left_anti")
    beside = f"{path}/_batch-{number:09d}"
    new.select(rows.columns).write.mode("overwrite").parquet(beside)
    moved(spark, beside, target)
    return True


def append_once(results: DataFrame, path: str, checkpoint: str, case: str, order: list[str]) -> StreamingQuery:
    """Starts appending a stream of results to the store; takes what is there and ends."""
    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch.persist(), number, path, case, order)
        batch.unpersist()

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(results: DataFrame, totals: DataFrame, path: str, checkpoint: str, group: str, at: str) -> StreamingQuery:
    """Starts following the results of a store as a stream: by group how many there are, of totals (group, total; a row a group), and since when.
    Every batch writes the groups that it changed."""
    counts = results.groupBy(group).agg(F.count("*").alias("done"), F.min(at).alias("first"), F.max(at).alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        batch.join(totals, group, "left").withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def current(spark: SparkSession, path: str, group: str) -> DataFrame:
    """By group: done, total, the share that is done (1 at most), the seconds so far and those that the rest takes at this pace."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(group).agg(F.max_by(F.struct("done", "total", "first", "last"), "number").alias("s")).select(group, "s.*")
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0)
    elapsed = F.expr("timestampdiff(MICROSECOND, first, last)") / 1_000_000
    return last.select(group, "done", "total", share.alias("share"), elapsed.alias("elapsed"), F.when(share > 0, elapsed * (1 - share) / share).alias("eta"))
