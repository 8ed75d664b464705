"""Sealed suites: test sources whose content must never be trained on, kept with the hashes of all their examples.

A suite is registered once a source. Its hashes are a table of their own, in buckets by their first byte; the suites' records are a store for
several writers, so a suite whose record was refused counts for nothing. The guard asks a Bloom filter of all hashes before the join,
so that a large training set is read once and all but the rows in question go at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import api
from chatloom.functions import bloom
from chatloom.functions.text import sha, skeleton
from chatloom.operators import calls as K
from chatloom.operators import conversations as C
from chatloom.operators import sampling as S
from chatloom.operators.tables import fingerprint, suite_profile
from chatloom.sources.shared import kept
from chatloom.sources.versions import Documents

SUITE = "source string, id string, name string, raw_rows long, n long, distinct_n long, fingerprint string, tools map<string,long>, tool_samples long, skeletons long, warnings array<string>, created_at timestamp"


class Sealed:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.store = Documents(spark, f"{path}/suites", "source", SUITE)

    def suites(self) -> DataFrame:
        return self.store.read().orderBy(F.desc("created_at"), "id")

    def register(self, source: str, name: str = "", max_rows: int | None = 1000, seed: int = 1776) -> str:
        """The new suite's id; a source that is registered is an error."""
        def refuse(known: DataFrame) -> None:
            if not known.where(F.col("source") == source).isEmpty():
                raise ValueError(f"{source} is registered as a sealed suite already")

        refuse(self.store.read())
        raw = api.records(self.spark, source, max_rows, seed)
        rows = kept(api.normalized(raw), "sealed")  # read several times below
        ident = f"sealed-{uuid.uuid4().hex[:10]}"
        hashes = rows.select("example_hash").distinct().withColumn("bucket", F.conv(F.substring("example_hash", 1, 2), 16, 10).cast("int"))
        hashes.repartition("bucket").sortWithinPartitions("bucket", "example_hash").write.partitionBy("bucket").parquet(f"{self.path}/hashes/suite={ident}")
        called = rows.withColumn("tools", K.tool_names(C.text_of(F.col("completion")))).withColumn("skeleton", sha(skeleton(F.to_json("prompt"))))
        profile = suite_profile(called, F.size("tools") > 0, "skeleton")
        tools = called.select(F.explode("tools").alias("tool")).groupBy("tool").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "count")))).alias("tools"))  # a pair a tool
        order = S.ranked(rows, "place", F.conv(F.substring("example_hash", 1, 4), 16, 10).cast("long"), [F.col("example_hash")])
        record = profile.join(tools).join(fingerprint(order, "place", ["place"], "example_hash"))  # one row each
        record = record.select(F.lit(source).alias("source"), F.lit(ident).alias("id"), F.lit(name.strip() or source.rstrip("/").rpartition("/")[2]).alias("name"), F.lit(raw.count()).alias("raw_rows"), "n", F.lit(self.hashes([ident]).count()).alias("distinct_n"), "fingerprint", "tools", "tool_samples", "skeletons", "warnings", F.current_timestamp().alias("created_at"))
        try:
            self.store.put(record, new=True)
        except ValueError as e:
            raise ValueError(f"{source} is registered as a sealed suite already") from e
        self.__dict__.pop("filter", None)
        return ident

    def hashes(self, ids: Iterable[str] | None = None) -> DataFrame:
        """The hashes of suites, of all by default, each once."""
        ids = [r.id for r in self.store.read().select("id").collect()] if ids is None else list(ids)
        if not ids:
            return self.spark.createDataFrame([], "example_hash string")
        return self.spark.read.option("basePath", f"{self.path}/hashes").parquet(*[f"{self.path}/hashes/suite={i}" for i in ids]).select("example_hash").distinct()

    @cached_property
    def filter(self) -> bytes:
        return bloom.built(self.hashes(), "example_hash")

    def refuse_sources(self, sources: Iterable[str]) -> None:
        """Sources that are sealed suites are an error."""
        given = self.spark.createDataFrame([(s,) for s in sources], "source string")
        found = sorted(r.source for r in self.store.read().join(given.distinct(), "source", "left_semi").select("source").collect())
        if found:
            raise ValueError(f"sealed test sources can't be trained on: {found}")

    def hits(self, examples: DataFrame) -> DataFrame:
        """The examples (with an example_hash) that a suite holds."""
        return examples.where(bloom.may_hold(self.filter, F.col("example_hash"))).join(self.hashes(), "example_hash", "left_semi")

    def refuse_content(self, *sides: DataFrame) -> None:
        n = sum(self.hits(side).count() for side in sides)
        if n:
            raise ValueError(f"training blocked: {n} examples are in sealed test suites")
