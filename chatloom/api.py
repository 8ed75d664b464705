"""The way from sources to training and validation sets, and a look at a source. All steps are DataFrame plans; errors name what is wrong."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions.text import sha
from chatloom.operators import calls as K
from chatloom.operators import conversations as C
from chatloom.operators import generators as G
from chatloom.operators import sampling as S
from chatloom.sources.readers import dataset

MESSAGES = "array<struct<role:string,content:string>>"
#: Of a record; what a source lacks is null.
RECORD = f"messages {MESSAGES}, instruction string, question string, output string, answer string, reference_answer string, prompt string, completion string, category string, prompt_messages {MESSAGES}, completion_messages {MESSAGES}"


class Guard(Protocol):
    """What knows which sources and which examples are sealed; sources.sealed.Sealed is one."""

    def refuse_sources(self, sources: Iterable[str]) -> None: ...

    def refuse_content(self, *sides: DataFrame) -> None: ...


def records(spark: SparkSession, source: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """The records of a source, `most` drawn ones at most, each with the hash of its content as group_id."""
    raw = dataset(spark, source)
    fields, have = spark.createDataFrame([], RECORD).schema.fields, dict(raw.dtypes)

    def column(name: str, kind: T.DataType) -> Column:
        """A field by its name; prompts and completions are texts or lists of messages, and each kind has a column."""
        own = name.removesuffix("_messages") if name.endswith("_messages") else name
        if own not in have or have[own].startswith("array") != isinstance(kind, T.ArrayType):
            return F.lit(None).cast(kind)
        if isinstance(kind, T.ArrayType):
            return F.transform(own, lambda m: F.struct(m["role"].cast("string").alias("role"), m["content"].cast("string").alias("content")))
        return F.col(own).cast(kind)

    rows = raw.select(*[column(f.name, f.dataType).alias(f.name) for f in fields])
    rows = rows.withColumn("group_id", sha(F.to_json(F.struct(*[f.name for f in fields]))))
    return rows if most is None else S.shuffled_limit(rows, "group_id", most, str(seed)).drop("drawn")


def normalized(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """prompt and completion messages of each answer in records, with group_id, category and example_hash; only calls of allowed tools."""
    kept = F.filter("messages", lambda m: m["role"].isNotNull())
    talks = rows.where("messages is not null").withColumn("m", F.transform(kept, lambda m: F.struct(F.coalesce(m["content"], F.lit("")).alias("content"), m["role"].alias("role"))))
    turns = talks.select("group_id", "category", "m", F.posexplode("m").alias("pos", "one")).where("one.role = 'assistant' and pos > 0")
    turns = turns.select("group_id", "category", F.slice("m", F.lit(1), F.col("pos")).alias("prompt"), F.array("one").alias("completion"))
    single = C.instruction_pairs(rows.where("messages is null"))
    message = lambda c, role: F.array(F.struct(F.col(c).alias("content"), F.lit(role).alias("role")))
    single = single.select("group_id", "category", message("ask", "user").alias("prompt"), message("reply", "assistant").alias("completion"))
    swap = lambda c: F.transform(c, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    pairs = rows.where("messages is null and prompt_messages is not null and completion_messages is not null").select("group_id", "category", swap("prompt_messages").alias("prompt"), swap("completion_messages").alias("completion"))
    out = turns.unionByName(single).unionByName(pairs).withColumn("example_hash", C.example_hash(F.col("completion"), F.col("prompt")))
    if allowed is None:
        return out
    names = K.tool_names(C.text_of(F.concat("prompt", "completion")))
    out = out.where(F.size(F.array_except(names, F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"))) == 0)
    if out.isEmpty():
        raise ValueError("no row is left with allowed tools only")
    return out


def mixed(rows: DataFrame, stratum: str, ratio: float, total: int, seed: str) -> DataFrame:
    """total draws: a share of them from the stratum, the rest from the others, each without repeats until its pool is used up."""
    again = int(round(total * ratio))
    pool = lambda c, n, s: S.drawn_with_replacement(rows.where(c).select("example_hash").distinct(), "example_hash", n, f"{seed}:{s}") if n else None
    is_replay = F.coalesce(F.col("category") == stratum, F.lit(False))
    parts = [p for p in (pool(is_replay, again, "replay"), pool(~is_replay, total - again, "rest")) if p is not None]
    return rows.dropDuplicates(["example_hash"]).join(reduce(DataFrame.unionByName, parts), "example_hash").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def load_training_data(spark: SparkSession, sources: list[str], eval_ratio: float = 0.05, seed: int = 42, max_source_rows: int = 25_000, max_training_samples: int = 50_000, allowed_tools: list[str] | None = None,
                       validation_sources: list[str] | None = None, max_validation_samples: int = 512, menu: bool = False, replay_ratio: float | None = None, replay_stratum: str = "rehearsal", sealed: Guard | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and validation examples. Whole records go to one side; validation sources must share neither records nor content with training,
    and neither side may be or hold what is sealed."""
    if sealed is not None:
        sealed.refuse_sources([*sources, *(validation_sources or [])])

    def read(names: list[str], most: int, offset: int) -> DataFrame:
        parts = [normalized(records(spark, s, most, seed + offset + k), allowed_tools) for k, s in enumerate(names)]
        out = reduce(DataFrame.unionByName, parts)
        if not menu or not allowed_tools:
            return out
        return C.menu_conditioned(out, G.menu_prompt("", allowed_tools).removeprefix("List of tools: [").removesuffix("]"))

    rows = read(sources, max_source_rows, 0)
    if validation_sources:
        held = read(validation_sources, max_validation_samples, 10_000)
        if not rows.select("group_id").intersect(held.select("group_id")).isEmpty():
            raise ValueError("training and validation hold the same records")
        shared = held.join(rows.select("example_hash").distinct(), "example_hash", "left_semi").count()
        if shared:
            raise ValueError(f"training and validation share {shared} examples")
    else:
        sides = S.group_split(rows, "group_id", eval_ratio, str(seed))
        rows, held = sides.where("side = 'train'").drop("side"), sides.where("side = 'eval'").drop("side")
    if replay_ratio is not None:
        rows = mixed(rows, replay_stratum, replay_ratio, min(rows.count(), max_training_samples), str(seed))
    else:
        rows = S.shuffled_limit(rows, "example_hash", max_training_samples, str(seed)).drop("drawn")
    held = S.shuffled_limit(held, "example_hash", max_validation_samples, str(seed + 1)).drop("drawn")
    if sealed is not None:
        sealed.refuse_content(rows, held)
    return rows.drop("group_id"), held.drop("group_id")


def validate_training_source(spark: SparkSession, source: str, rows: int = 5, allowed_tools: list[str] | None = None) -> dict:
    """A few rows of a source, and what they become."""
    raw = dataset(spark, source)
    some = normalized(records(spark, source, rows), allowed_tools)
    first = some.head()
    if first is None:
        raise ValueError(f"{source} gives no example")
    return {"source": source, "raw_columns": raw.columns, "normalized_rows": some.count(), "sample_prompt_roles": [m.role for m in first.prompt], "sample_completion": str(first.completion[0].content)[:500]}
