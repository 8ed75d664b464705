"""Sources: driver tables, JSON lines, JSON documents, CSV reports and directories of them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """Objects of the JSON-lines files under path; blank lines count towards each file's limit, anything but a whole object is dropped."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if limit is not None:
        by = Window.partitionBy("file").orderBy("block", F.monotonically_increasing_id())
        lines = lines.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    row = F.from_json("value", T.StructType([*fields.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.btrim("value").startswith("{")).select(row.alias("row"), "value").where("row is not null and row._bad is null").select("row.*").drop("_bad")


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON files: a list, an object with a list under `data`, or one object."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    row = schema if isinstance(schema, str) else schema.simpleString()
    lists = F.from_json("value", f"array<struct<{row}>>")
    nested = F.from_json("value", f"struct<data:array<struct<{row}>>>").getField("data")
    return whole.select(F.explode(F.when(F.ltrim("value").startswith("["), lists).otherwise(F.coalesce(nested, F.array(F.from_json("value", f"struct<{row}>"))))).alias("row")).select("row.*")


def dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset by what is there: all Parquet files of a folder if it has any, else its JSON files; a single file by its suffix."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names: list[str] = []
    if fs.getFileStatus(fs_path).isDirectory():
        files = fs.listFiles(fs_path, True)
        while files.hasNext():
            names.append(files.next().getPath().getName())
        kind = next((k for k in ("parquet", "json") if any(n.endswith((f".{k}", f".{k}l")) for n in names)), None)
    else:
        kind = "parquet" if path.endswith(".parquet") else "json" if path.endswith((".json", ".jsonl")) else None
    if kind is None:
        raise ValueError(f"no Parquet or JSON data under {path}")
    if kind == "parquet":
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    found = [(glob, many) for glob, many in (("*.jsonl", False), ("*.json", True)) if any(n.endswith(glob[1:]) for n in (names or [path]))]
    parts = [spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path, schema=schema, multiLine=many) for glob, many in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_objects(spark: SparkSession, path: str, schema: str, glob: str = "*") -> DataFrame:
    """The first non-blank line of every file, where it is an object."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    lines = lines.where("btrim(value) <> ''").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("path", "file").agg(F.min_by("value", F.struct("block", "n")).alias("value"))
    return first.where(F.btrim("value").startswith("{")).select("file", F.from_json("value", schema).alias("row")).where("row is not null").select("file", "row.*")


def union_csv(parts: Iterable[DataFrame], path: str) -> None:
    """One CSV of rows whose columns differ; the header is their union in the order first seen. No parts, no file."""
    parts = list(parts)
    if parts:
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").csv(path, header=True)
