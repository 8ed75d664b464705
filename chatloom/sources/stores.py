"""Stores of JSON lines, documents, registries, results, scores and reports. Contents and names of documents stay distributed; names of other files and single rows come to the driver."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions.text import SECRETS
from chatloom.sources.readers import first_objects, json_lines
from chatloom.sources.shared import kept
from chatloom.sources.versions import Log

#: A task that reads files sends on what it has from so many bytes.
READ = 1 << 22
#: How a source names a file of a hosted dataset, and how a failed result begins.
HOSTED, FAILED = "hf-file:", "Error during inference:"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def content_hash(rows: DataFrame) -> str:
    """Sensitive to rows and repeats, not to their order: sums of two hashes of each row and their number."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    parts = rows.select(F.xxhash64(line).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), line).cast("decimal(38,0)").alias("b")).agg(F.sum("a"), F.sum("b"), F.count("*")).head()
    return ":".join(map(str, parts))


def write_lines(rows: DataFrame, path: str, frozen: bool = False) -> bool:
    """Writes JSON lines unless they are there already; a frozen folder with other rows is never written over. Whether it wrote."""
    spark = rows.sparkSession
    if exists(spark, path):
        if content_hash(read_lines(spark, path, rows.schema)) == content_hash(rows):
            return False
        if frozen:
            raise ValueError(f"{path} holds other rows")
        rows = kept(rows, "lines")  # rows may come from what is written over
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return True


def read_lines(spark: SparkSession, path: str, schema, required: str | None = None) -> DataFrame:
    """Objects of JSON lines; with `required`, a row without it is an error."""
    rows = json_lines(spark, path, schema)
    if required is None:
        return rows
    return rows.withColumn(required, F.when(F.col(required).isNotNull(), F.col(required)).otherwise(F.raise_error(F.lit(f"a row without {required}")).cast(rows.schema[required].dataType)))


def append_events(rows: DataFrame, path: str) -> None:
    """One JSON line an event with the time in seconds; many writers may append."""
    rows.withColumn("time", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def hosted(source: Column) -> Column:
    """dataset and file of a hosted source; null for others."""
    body = F.when(source.startswith(HOSTED) & source.contains("::"), F.substring(source, len(HOSTED) + 1, 1 << 20))
    return F.struct(F.split(body, "::", 2)[0].alias("dataset"), F.split(body, "::", 2)[1].alias("file"))


def write_splits(rows: DataFrame, split: str, path: str) -> None:
    """A folder of Parquet files for each split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


# Results and scores.


def family(category: Column, version: str) -> Column:
    c = F.lower(category)
    out = F.when(c.contains("memory") | c.contains("web_search"), "agentic").when(c.contains("multi_turn"), "multi_turn").when(c.contains("live"), "live")
    return (out.when(c.contains("exec"), "executable") if version == "v3" else out).when(c.contains("format_sensitivity"), "format_sensitivity").otherwise("non_live")


def category_scores(spark: SparkSession, root: str, version: str, needed: bool = False) -> DataFrame:
    """Scores of the files BFCL_<version>_<category>_score.json below root: their first line has the counts; files without are left out.

    With `needed`, that there are none is an error.
    """
    if version not in ("v3", "v4"):
        raise ValueError(f"unknown version {version}")
    rows = first_objects(spark, root, "total_count long, correct_count long", f"BFCL_{version}_*_score.json").where("total_count is not null and correct_count is not null")
    if needed and rows.isEmpty():
        raise ValueError(f"no scores below {root}")
    rows = rows.select(F.regexp_extract("file", f"^BFCL_{version}_(.*)_score[.]json$", 1).alias("category"), F.col("total_count").alias("total"), F.col("correct_count").alias("correct"))
    return rows.withColumn("family", family(F.col("category"), version)).withColumn("accuracy", F.col("correct") / F.greatest(F.lit(1), F.col("total")))


def score_summary(spark: SparkSession, root: str) -> DataFrame:
    """All rows of all CSV files below root, whatever their columns: file, row (a map); the overall table is told by its file's name."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, {k: v for k, v in r.items() if k is not None and isinstance(v, str)}) for f, t in zip(frame["file"], frame["value"], strict=True) for r in csv.DictReader(io.StringIO(t))]
            yield pd.DataFrame(rows, columns=["file", "row"])

    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), "value").mapInPandas(run, "file string, row map<string,string>")


def case_count(spark: SparkSession, root: str) -> DataFrame:
    """How many non-blank lines all JSON files below root have: one row, n."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    return lines.agg(F.count_if(F.trim("value") != "").alias("n"))


def seeded_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Result lines (file, id, line) that can be kept, and by file how many are kept and how many are tried again.

    Kept is what parses and whose result is no text that begins with a failure.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(root).where("trim(value) <> ''").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", "id string, result string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("p", parsed).withColumn("good", F.col("p._bad").isNull() & F.col("p").isNotNull() & ~F.coalesce(F.col("p.result").startswith(FAILED), F.lit(False)))
    return rows.where("good").select("file", "p.id", "line"), rows.groupBy("file").agg(F.count_if("good").alias("retained"), F.count_if(~F.col("good")).alias("retry"))


def located(spark: SparkSession, root: str) -> str:
    """root as pyarrow reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Few bytes may be many files, so they are dealt by their paths."""
    return rows.select("path", *columns).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name[0] == "." or name.endswith("._COPYING_") or (name[0] == "_" and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def files_below(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """path and mtime (milliseconds) of all files below root with such an ending. Tasks list the folders of a level; the driver sees none of their names."""
    where = located(spark, root)

    def inside(folder: str) -> Iterator[tuple[str, str, bool, int]]:
        from pyarrow import fs

        if where.startswith("file:"):  # one by one
            with os.scandir(folder) as found:
                yield from ((e.name, e.path, True, 0) if e.is_dir() else (e.name, e.path, False, e.stat().st_mtime_ns if e.name.endswith(ending) else 0) for e in found)
        else:
            yield from ((e.base_name, e.path, e.type == fs.FileType.Directory, e.mtime_ns or 0) for e in fs.FileSystem.from_uri(where)[0].get_file_info(fs.FileSelector(folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = ((path, is_folder, mtime // 1_000_000) for name, path, is_folder, mtime in inside(folder) if not hidden(name) and (is_folder or name.endswith(ending)))
                while some := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], names=["path", "folder", "mtime"])

    from pyarrow import fs

    base = fs.FileSystem.from_uri(where)[1]
    if (of := fs.FileSystem.from_uri(where)[0].get_file_info(base)).type != fs.FileType.Directory:
        if of.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        return spark.createDataFrame([(base, of.mtime_ns // 1_000_000)] * base.endswith(ending), "path string, mtime long")
    levels, folders = [], spark.createDataFrame([(base,)], "path string")
    while not levels or folders.head(1):
        here = kept(spread(folders).mapInArrow(run, "path string, folder boolean, mtime long"), "files")
        levels.append(here.where("not folder").select("path", "mtime"))
        folders = here.where("folder").select("path")
    return reduce(DataFrame.unionAll, levels)


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, mtime) with what each holds; a task holds some of its files at a time."""
    where = located(files.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(where)[0]
        for batch in batches:
            lo, size, some = 0, 0, []
            for hi, path in enumerate(batch.column(0).to_pylist(), 1):
                with system.open_input_stream(path, compression=None) as found:
                    some.append(found.read())
                size += len(some[-1])
                if size >= READ or hi == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(some, pa.binary())], names=["path", "mtime", "content"])
                    lo, size, some = hi, 0, []

    return spread(files, "mtime").mapInArrow(run, "path string, mtime long, content binary")


def listed(spark: SparkSession, root: str, schema: str, *times: str) -> DataFrame:
    """One row for each readable JSON document below root, newest first by the first of its times that is given."""
    whole = contents(files_below(spark, root, ".json"), root).select(F.col("content").cast("string").alias("value"), F.timestamp_millis("mtime").alias("mtime"))
    rows = whole.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "mtime").where("r is not null and r._bad is null")
    return kept(rows.select("r.*", "mtime").drop("_bad"), "listed").orderBy(F.desc(F.coalesce(*times, F.col("mtime").cast("string"))))


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row (path below root, content) as a file, from executors; how many there were. A file that is there is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(where)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{base}/{name}"
                if (folder := at.rpartition("/")[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(at) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    where = located(rows.sparkSession, root)
    return spread(rows.withColumn("content", F.col("content").cast("binary")), "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n


# Keyed stores.


def numbered(keys: DataFrame, key: str, above: int) -> DataFrame:
    """key and new_id, the key's place among keys above a number: sorted by ranges, each of which counts on from those before."""
    placed = kept(keys.repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "keys")
    before = placed.groupBy("part").agg(F.count("*").alias("own"))
    before = before.withColumn("before", F.sum("own").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("own")).drop("own")  # a row a partition
    return placed.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("at") + above + 1).alias("new_id"))


class Registry:
    """Rows by a key with an id and the times of their making and last change, as numbered versions of a Parquet table.

    A change works out all rows from a version's and becomes the next one; if another writer was faster, it is worked out again from theirs.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key, self.log = spark, path, key, Log(spark, f"{path}/_log")
        self.schema = spark.createDataFrame([], f"id long, {key} string, {schema}, created_at timestamp, updated_at timestamp").schema

    def rows(self, version: int | None = None) -> DataFrame:
        version = self.log.last() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.log.entries(version)[0]['folder']}")

    def changed(self, change: Callable[[DataFrame], DataFrame]) -> None:
        while True:
            version, folder = self.log.last(), f"rows-{uuid.uuid4().hex}"
            change(self.rows(version)).select(self.schema.fieldNames()).write.parquet(f"{self.path}/{folder}")
            if self.log.add(version + 1, {"folder": folder}):
                return

    def upsert(self, new: DataFrame) -> None:
        """Rows of a known key keep their id and the time of their making; new keys get the next ids in order of the key."""
        new, own = new.dropDuplicates([self.key]), [c for c in self.schema.fieldNames() if c not in ("id", self.key, "created_at", "updated_at")]

        def change(old: DataFrame) -> DataFrame:
            now, top = F.current_timestamp(), old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).head().top
            fresh = new.join(old.select(self.key), self.key, "left_anti").select(self.key)
            sides = [new[c].alias(f"n_{c}") for c in own]
            both = old.join(new.select(self.key, F.lit(True).alias("given"), *sides), self.key, "full").join(numbered(fresh, self.key, top), self.key, "left")
            chosen = {c: F.when(F.col("given"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in own}
            return both.select(F.coalesce("id", "new_id").alias("id"), self.key, *[x.alias(c) for c, x in chosen.items()], F.coalesce("created_at", now).alias("created_at"), F.when(F.col("given"), now).otherwise(F.col("updated_at")).alias("updated_at"))

        self.changed(change)

    def update(self, ids: list[int], **values: object) -> None:
        """Sets columns of some rows; the others stay."""
        hit = F.col("id").isin(ids)
        self.changed(lambda old: old.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()} | {"updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))}))

    def delete(self, keys: DataFrame) -> None:
        self.changed(lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def newest(self) -> DataFrame:
        return self.rows().orderBy(F.desc("id"))

    def resolve(self, name: str) -> DataFrame:
        """The newest row whose key is the name, or whose id is, written out."""
        return self.rows().where((F.col(self.key) == name) | (F.col("id").cast("string") == name)).orderBy(F.desc("id")).limit(1)


# Files.


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and modificationTime of files; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


def latest_file(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    return files(spark, root).where(F.regexp_extract("path", "([^/]*)$", 1).isin(names)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def checkpoint_bytes(spark: SparkSession, root: str) -> DataFrame:
    """How many bytes the checkpoint folders below root hold: one row, bytes."""
    return files(spark, root).where(F.col("path").rlike("/checkpoint-[^/]*/")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def tensor_headers(paths: DataFrame) -> DataFrame:
    """paths (path): the tensors that each file's header names: path, name, dtype, shape. Only headers are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
                rows += [(path, name, x.get("dtype", "unknown"), [int(n) for n in x.get("shape", [])]) for name, x in head.items() if name != "__metadata__"]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["path", "name", "dtype", "shape"])

    return paths.select("path").mapInArrow(run, "path string, name string, dtype string, shape array<long>")


def inspected(spark: SparkSession, root: str, limit: int | None = 100) -> DataFrame:
    """A dataset folder in one row: bytes, lines of its JSON-lines files (blank ones too; null without any JSON), the columns and secret hits of the first lines of each part of a file
    (of all lines without a limit), and a fingerprint of names and sizes. Lines are counted where they are read; none are brought together."""
    every = files(spark, root)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    sizes = every.agg(F.sum("length").alias("bytes"), F.count_if(name.rlike("[.]jsonl?$")).alias("json_files"))
    prints = every.select(F.xxhash64(name, "length").cast("decimal(38,0)").alias("h")).agg(F.sum("h").cast("string").alias("fingerprint"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    count = lines.agg(F.count("*").alias("lines"))
    first = lines
    if limit is not None:  # the first lines of a file are among the first of the part of it that begins at byte 0
        some = lines.where("_metadata.file_block_start = 0").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
        first = some.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("k") <= limit)  # cut before the shuffle
    keys = F.json_object_keys("value")
    hits = sum((F.col("value").rlike(p).cast("long") for p in SECRETS), F.lit(0))
    named = first.where(keys.isNotNull())
    columns = named.select(F.explode(keys).alias("k")).distinct().agg(F.array_sort(F.collect_list("k")).alias("columns"))  # a name a row
    sample = named.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("secret_hits"))
    return sizes.join(prints).join(count).join(columns).join(sample).withColumn("row_count", F.when(F.col("json_files") > 0, F.col("lines"))).drop("lines", "json_files")  # one row each


# Reports.


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table for people; shares named *accuracy are shown in percent. Reports are short: more than `most` rows are an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda c, v: "N/A" if v is None else f"{100 * v:.2f}%" if c.endswith("accuracy") and isinstance(v, int | float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in rows.columns) + " |" for r in got])


def markdown_lines(rows: DataFrame) -> DataFrame:
    """The body of such a table as lines, for rows of any number."""
    cell = lambda c, t: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.2f%%", 100 * F.col(c).cast("double")) if c.endswith("accuracy") and t in ("double", "float") else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, t) for c, t in rows.dtypes]), F.lit(" |")).alias("line"))
