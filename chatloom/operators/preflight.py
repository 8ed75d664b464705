"""What is known about training sources before a run: a profile of each, warnings by rules, and a verdict. Everything is grouped, nothing is gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.metrics import nearest_ranks

LENGTHS = ("prompt", "completion", "total")


def profile(examples: DataFrame, allowed: list[str], limit: int, sealed: DataFrame) -> DataFrame:
    """examples: source, group_id, tools, completion_tools, roles, prompt_tokens, completion_tokens, h; sealed: h. One row a source."""
    known = F.array(*map(F.lit, allowed))
    rows = examples.withColumn("fits", F.size(F.array_except("tools", known)) == 0).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    rows = rows.join(sealed.select("h").distinct().withColumn("is_sealed", F.lit(True)), "h", "left")
    initial = ~F.arrays_overlap("roles", F.array(F.lit("assistant"), F.lit("tool")))
    calls = F.size("completion_tools") > 0
    count = lambda c, name: F.count_if(c).alias(name)
    out = rows.groupBy("source").agg(
        F.count("*").alias("normalized"), F.countDistinct("group_id").alias("groups"), count("fits", "compatible"), count(F.col("total_tokens") > limit, "truncated"), count(F.col("prompt_tokens") >= limit - 8, "prompt_overflow"),
        count(F.col("fits") & F.coalesce("is_sealed", F.lit(False)), "sealed_overlap"), count(initial & calls, "initial_calls"), count(initial & ~calls, "initial_direct"), count(~initial & F.array_contains("roles", "tool") & ~calls, "after_tool_direct"),
        count(F.array_contains("roles", "system"), "with_system"), F.max("total_tokens").alias("total_max"),
    )
    ranks = [nearest_ranks(rows, "source", f"{k}_tokens", {f"{k}_p50": 0.5, f"{k}_p95": 0.95}) for k in LENGTHS]
    return reduce(lambda a, b: a.join(b, "source"), ranks, out)


def tool_counts(examples: DataFrame, allowed: list[str]) -> DataFrame:
    """How often each source's answers name each tool, and how often its examples name one that isn't allowed: source, tool, n, unknown."""
    known = F.array(*map(F.lit, allowed))
    named = examples.select("source", F.explode("completion_tools").alias("tool"), F.lit(0).alias("unknown"))
    strange = examples.select("source", F.explode(F.array_except("tools", known)).alias("tool"), F.lit(1).alias("unknown"))
    return named.unionByName(strange).groupBy("source", "tool").agg(F.count_if(F.col("unknown") == 0).alias("n"), F.count_if(F.col("unknown") == 1).alias("unknown"))


def said(severity: str, code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def listed(rows: DataFrame, *rules: Column) -> DataFrame:
    return rows.select("source", F.explode(F.array_compact(F.array(*rules))).alias("w")).select("source", "w.*")


def warnings(profiles: DataFrame, tools: DataFrame, allowed: list[str], sealed_sources: DataFrame, filtered: bool = True, coverage: bool = True) -> DataFrame:
    """Rules over profile() and tool_counts(): source (null for all), severity, code. The codes and their thresholds."""
    strange = tools.groupBy("source").agg(F.sum("unknown").alias("unknown"))
    each = profiles.join(strange, "source", "left").join(sealed_sources.select("source").distinct().withColumn("reused", F.lit(True)), "source", "left")
    own = listed(
        each, said("error", "SEALED_SOURCE_REUSE", F.col("reused")), said("warning", "UNKNOWN_TOOLS", (F.col("unknown") > 0) & F.lit(filtered)), said("warning", "NO_INITIAL_ABSTENTION_EXAMPLES", (F.col("initial_calls") > 0) & (F.col("initial_direct") == 0)),
        said("warning", "NO_SCHEMA_CONDITIONED_EXAMPLES", (F.col("initial_calls") > 0) & (F.col("with_system") == 0)), said("warning", "HIGH_TOOL_FILTER_REJECTION", F.lit(filtered) & ((F.col("normalized") - F.col("compatible")) / F.greatest(F.lit(1), F.col("normalized")) >= 0.5)),
        said("warning", "LOW_COMPATIBLE_SAMPLE_COUNT", F.col("compatible") < 100),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = profiles.agg(*map(total, ("normalized", "compatible", "truncated", "prompt_overflow", "sealed_overlap")))
    by_tool = tools.groupBy("tool").agg(F.sum("n").alias("n"))
    share = by_tool.agg((F.max("n") / F.greatest(F.lit(1), F.sum("n"))).alias("dominant"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.count_if(F.col("tool").isin(*allowed) & (F.col("n") > 0)).alias("covered"))
    ratio = F.col("truncated") / F.greatest(F.lit(1), F.col("normalized"))
    over, some = F.col("prompt_overflow") > 0, F.col("truncated") > 0
    whole = listed(
        sums.join(share).withColumn("source", F.lit(None).cast("string")), said("error", "SEALED_CONTENT_OVERLAP", F.col("sealed_overlap") > 0), said("error", "PROMPT_OVERFLOW", over), said("error", "EXCESSIVE_TRUNCATION", ~over & (ratio > 0.25)),  # one row each
        said("warning", "SOME_TRUNCATION", ~over & (ratio <= 0.25) & some), said("warning", "MISSING_TOOL_COVERAGE", F.lit(coverage) & (F.col("covered") < len(set(allowed)))), said("warning", "TOOL_IMBALANCE", (F.col("calls") > 0) & (F.col("dominant") > 0.75)),
        said("error", "NO_COMPATIBLE_SAMPLES", F.col("compatible") == 0),
    )
    return own.unionByName(whole)


def verdict(found: DataFrame) -> DataFrame:
    """blocked with an error, warning with any warning, else ready."""
    return found.agg(F.when(F.count_if(F.col("severity") == "error") > 0, "blocked").when(F.count("*") > 0, "warning").otherwise("ready").alias("status"))


def recipe(training: DataFrame, validation: DataFrame, train_hashes: DataFrame, validation_hashes: DataFrame) -> DataFrame:
    """The warnings of both roles, and an error if they share content."""
    shared = train_hashes.intersect(validation_hashes).agg(F.count("*").alias("n")).where("n > 0")
    both = training.withColumn("role", F.lit("training")).unionByName(validation.withColumn("role", F.lit("validation")))
    return both.unionByName(shared.select(F.lit(None).cast("string").alias("source"), F.lit("error").alias("severity"), F.lit("TRAIN_VALIDATION_OVERLAP").alias("code"), F.lit("both").alias("role")))
