"""Scores of predictions in one conditional aggregation each; an empty denominator counts as 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOOL = F.col


def per(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def counts() -> list[Column]:
    tool = F.col("expected_tool").isNotNull()
    return [
        F.count("*").alias("samples"), F.count_if(tool).alias("tool_rows"), F.count_if(~tool).alias("plain_rows"),
        F.count_if(tool & F.col("attempted_tool")).alias("tp"), F.count_if(~tool & ~F.col("attempted_tool")).alias("tn"),
        F.count_if(tool & (F.col("predicted_tool") == F.col("expected_tool"))).alias("named"), F.count_if(tool & F.col("predicted_tool").isNotNull()).alias("parsed"),
        F.count_if(tool & F.col("exact")).alias("exact_rows"), F.count_if(tool & F.col("elastic")).alias("elastic_rows"),
    ]


def rates(rows: DataFrame) -> DataFrame:
    """Adds recall, specificity, accuracy, balanced accuracy and Matthews correlation to rows with counts()."""
    rows = rows.withColumn("fn", F.col("tool_rows") - F.col("tp")).withColumn("fp", F.col("plain_rows") - F.col("tn"))
    rows = rows.withColumn("recall", per(F.col("tp"), F.col("tool_rows"))).withColumn("specificity", per(F.col("tn"), F.col("plain_rows")))
    product = ((F.col("tp") + F.col("fp")).cast("double") * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    top = F.col("tp").cast("double") * F.col("tn") - F.col("fp").cast("double") * F.col("fn")
    return (
        rows.withColumn("accuracy", per(F.col("tp") + F.col("tn"), F.col("samples"))).withColumn("balanced", 0.5 * (F.col("recall") + F.col("specificity")))
        .withColumn("mcc", F.when(product == 0, 0.0).otherwise(top / F.sqrt(product)))
        .withColumn("named_accuracy", per(F.col("named"), F.col("tool_rows"))).withColumn("exact_accuracy", per(F.col("exact_rows"), F.col("tool_rows")))
        .withColumn("elastic_accuracy", per(F.col("elastic_rows"), F.col("tool_rows"))).withColumn("parse_rate", per(F.col("parsed"), F.col("tool_rows")))
    )


def scored(predictions: DataFrame, *by: str) -> DataFrame:
    return rates(predictions.groupBy(*by).agg(*counts()))


def slices(predictions: DataFrame, dimensions: list[str]) -> DataFrame:
    """Scores for every value of each dimension on its own, by grouping sets; null values are left out."""
    sets = [[F.col(d)] for d in dimensions]
    rows = predictions.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(*counts(), *[F.grouping(d).alias(f"g_{d}") for d in dimensions])
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        which, value = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(which), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return rates(rows.withColumn("dimension", which).withColumn("value", value).where("value is not null"))


def fitness(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A weighted sum of score columns, less a tenth of the gap between tolerant and strict."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return rows.withColumn("fitness", total - 0.10 * F.greatest(F.lit(0.0), F.col("elastic_accuracy") - F.col("exact_accuracy")))


def nearest_ranks(rows: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """For each `by` and fraction the value at index min(n - 1, round((n - 1) * fraction)) of the sorted list, half to even.

    Equal values are counted first, so the window runs over distinct values alone.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    at = {name: F.least(F.col("all") - 1, F.bround((F.col("all") - 1) * F.lit(f))) for name, f in fractions.items()}
    hit = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("n") <= i), F.col(value)))
    return counts.groupBy(by).agg(*[hit(i).alias(name) for name, i in at.items()])


def classifier(rows: DataFrame, label: str, p: str, threshold: float = 0.5) -> DataFrame:
    """auroc (ties count half; null without both labels), precision, recall, f1 and specificity of scores p for label 1.

    Equal scores are counted first; the rank sum runs over distinct scores.
    """
    y = F.col(label) == 1
    counts = rows.groupBy(p).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(F.lit(0)).orderBy(p)) - F.col("neg")
    area = counts.withColumn("below", below).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))
    hit = F.col(p) >= threshold
    parts = rows.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    both = area.join(parts)  # one row each
    return both.select("auroc", per(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), per(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), per(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), per(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


OUTCOMES = ("strict", "elastic", "routing", "format")


def category_scores(rows: DataFrame) -> DataFrame:
    """rows (stratum, category and a flag for each outcome): successes and shares by stratum, else category, else unclassified."""
    named = F.coalesce(F.nullif("stratum", F.lit("")), F.nullif("category", F.lit("")), F.lit("unclassified"))
    out = rows.groupBy(named.alias("_c")).agg(F.count("*").alias("total"), *[F.count_if(F.col(k)).alias(f"{k}_success") for k in OUTCOMES]).withColumnRenamed("_c", "category")
    return out.withColumns({f"{k}_accuracy": F.col(f"{k}_success") / F.col("total") for k in OUTCOMES})


def legacy_scores(metrics: DataFrame) -> DataFrame:
    """metrics (total, routing_accuracy, format_accuracy) of reports without predictions, in the same columns; without cases there is no row."""
    rows = metrics.where("total > 0").withColumn("category", F.lit("overall-only-legacy"))
    return rows.withColumns({f"{k}_success": F.lit(None).cast("long") for k in OUTCOMES} | {f"{k}_accuracy": F.lit(None).cast("double") for k in OUTCOMES[:2]})
