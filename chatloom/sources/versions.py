"""Stores that several writers may change at once: a log of commits, each a file that only one writer can create.

A writer puts its rows in a folder of their own, then tries to create the log's next entry, which names the folder. If another was faster,
it looks at the store again, checks what it has to check, and tries the entry after that. So no commit is lost, readers see whole commits
only, and what was written without an entry counts for nothing. The entry is written beside the log and then linked or renamed into it, which
has to fail where the name is taken, as in local file systems and HDFS."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Log:
    """Numbered entries, from 1."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def last(self) -> int:
        fs, at = self._at(self.path)
        if not fs.exists(at):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def add(self, number: int, entry: dict) -> bool:
        """Whether the entry was added; False where there is one of this number."""
        fs, beside = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(entry | {"number": number}).encode()))
        out.close()
        target = self._at(f"{self.path}/{number:09d}.json")[1]
        whole = fs.makeQualified(target).toString()
        try:
            if whole.startswith("file:"):
                try:
                    os.link(unquote(urlparse(fs.makeQualified(beside).toString()).path), unquote(urlparse(whole).path))
                except FileExistsError:
                    return False
                return True
            return not fs.exists(target) and fs.rename(beside, target)
        finally:
            fs.delete(beside, False)

    def entries(self, since: int = 1) -> list[dict]:
        """Those from a number on: one small file a commit."""
        last = self.last()
        if last < since:
            return []
        paths = [f"{self.path}/{n:09d}.json" for n in range(since, last + 1)]
        return sorted((json.loads(r.value) for r in self.spark.read.text(paths, wholetext=True).collect()), key=lambda e: e["number"])


class Documents:
    """Rows by a key: put in or replaced, deleted, and read as of any commit. Every `every` commits a writer puts all rows in one folder, from
    which readers start."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, every: int = 50) -> None:
        self.spark, self.path, self.key, self.every = spark, path, key, every
        self.schema = spark.createDataFrame([], schema).schema
        self.kept = T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType())])
        self.log = Log(spark, f"{path}/_log")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows as of a commit, or now."""
        entries = [e for e in self.log.entries() if number is None or e["number"] <= number]
        base = max((k for k, e in enumerate(entries) if e["base"]), default=0)
        entries = entries[base:]
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.kept).parquet(*[f"{self.path}/{e['folder']}" for e in entries])
        order = F.create_map(*[F.lit(x) for e in entries for x in (e["folder"], e["number"])])  # a pair a commit since the last base
        own = F.element_at(order, F.regexp_extract(F.col("_metadata.file_path"), "/(rows-[0-9a-f]+)/[^/]*$", 1))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.kept.fieldNames()), own).alias("r"))
        return newest.where("not r._deleted").select("r.*").select(self.schema.fieldNames())

    def _commit(self, rows: DataFrame, check: Callable[[DataFrame], None] | None, base_of: int | None = None) -> int:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(self.kept.fieldNames()).write.parquet(f"{self.path}/{folder}")
        while True:
            last = self.log.last()
            if base_of is not None and last != base_of:
                return 0  # others were faster; what they wrote isn't in these rows
            if check is not None:
                check(self.read(last))
            if self.log.add(last + 1, {"folder": folder, "base": base_of is not None}):
                if base_of is None and (last + 1) % self.every == 0:
                    self.compact()
                return last + 1

    def put(self, rows: DataFrame, new: bool = False) -> int:
        """Adds rows or replaces those of their keys; new forbids keys that are there. A key twice, or none, is an error."""
        bad = rows.groupBy(self.key).count().where(F.col("count").__gt__(1) | F.col(self.key).isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"{self.key} {bad[0][0]!r} isn't the key of one row")

        def check(old: DataFrame) -> None:
            known = old.join(rows.select(self.key), self.key, "left_semi").limit(1).collect()
            if known:
                raise ValueError(f"{self.key} {known[0][self.key]!r} is there already")

        return self._commit(rows.withColumn("_deleted", F.lit(False)), check if new else None)

    def delete(self, keys: DataFrame) -> int:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        return self._commit(keys.select(self.key).distinct().select(self.key, *empty, F.lit(True).alias("_deleted")), None)

    def compact(self) -> int:
        last = self.log.last()
        return self._commit(self.read(last).withColumn("_deleted", F.lit(False)), None, base_of=last) if last else 0
