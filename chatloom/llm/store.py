"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the tables of this process are, oldest first.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only where it is unset and all runs on one machine, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="chatloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def table_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again: cuts its lineage, and later readers don't repeat its work."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_buckets(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Like kept, in as many buckets by key as a shuffle has partitions, each sorted: joins and sums by the key need no shuffle. The
    catalog's entry only tells the buckets and goes at once."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(entry)
    out = spark.table(entry)
    out.schema  # noqa: B018  resolved before the entry goes
    spark.sql(f"drop table {entry}")
    return out


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such of the tables made. Only for when nothing reads them any more: results of operators are lazy."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with its columns named c0, c1, ..., so that no name clashes, and what gives each its name again."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain, {c: F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)}


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
