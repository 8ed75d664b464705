"""Audits of a corpus by declared expectations, all of them in one plan: each row tells every check what it has for it, two aggregations
bring together what equal values and whole checks have, and a small table says what was wanted.

Counts combine before they are shuffled, so a check on one value for all rows costs a row a task. Null values count as a value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import sha


@dataclass
class Expectation:
    """What is to hold, by kind:

    rows: as many rows as `each`; unique: no two rows alike in the columns; balanced: every value of the columns as often (`each` times, if given);
    histogram: exactly these values of a column, each as often as `counts` says; never: no row with the condition;
    apart: no value of the columns on more than one `side`."""

    name: str
    kind: str
    columns: list[str] = field(default_factory=list)
    each: int | None = None
    counts: dict[str, int] = field(default_factory=dict)
    condition: str | None = None
    side: str | None = None

    def told(self) -> Column:
        """What a row has for this check: a value and a side; null where it has nothing to say."""
        if self.kind == "histogram":
            value = F.col(self.columns[0]).cast("string")
        else:
            value = sha(F.to_json(F.struct(*self.columns), {"ignoreNullFields": "false"})) if self.columns else F.lit("all")
        one = F.struct(F.lit(self.name).alias("name"), value.alias("value"), (F.expr(self.side).cast("string") if self.side else F.lit(None).cast("string")).alias("side"))
        return F.when(F.expr(self.condition), one) if self.kind == "never" else one


def audited(rows: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """Of every expectation: name, kind, ok, and what was found: rows, values, the least and the most rows of a value, and how many values are wrong."""
    if len({e.name for e in expectations}) < len(expectations) or not expectations:
        raise ValueError("expectations need names of their own")
    spark = rows.sparkSession
    asked = spark.createDataFrame([(e.name, e.kind, e.each, len(e.counts)) for e in expectations], "name string, kind string, each long, wanted long")
    wanted = spark.createDataFrame([(e.name, v, n) for e in expectations for v, n in e.counts.items()], "name string, value string, due long")
    told = rows.select(F.explode(F.array_compact(F.array(*[e.told() for e in expectations]))).alias("t")).select("t.*")
    values = told.groupBy("name", "value").agg(F.count("*").alias("n"), (F.size(F.collect_set("side"))).alias("sides"))  # sides are few
    values = values.join(F.broadcast(wanted), ["name", "value"], "left")
    sums = values.groupBy("name").agg(F.sum("n").alias("rows"), F.count("*").alias("values"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("sides") > 1).alias("shared"), F.count_if(F.col("due") == F.col("n")).alias("right"))
    out = asked.join(sums, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "values", "least", "most", "shared", "right")})
    rule = {
        "rows": F.col("rows") == F.col("each"), "unique": F.col("most") <= 1, "balanced": (F.col("least") == F.col("most")) & (F.col("each").isNull() | (F.col("most") == F.col("each"))),
        "histogram": (F.col("right") == F.col("wanted")) & (F.col("values") == F.col("wanted")), "never": F.col("rows") == 0, "apart": F.col("shared") == 0,
    }
    kinds = {e.kind for e in expectations}
    if kinds - rule.keys():
        raise ValueError(f"unknown kinds: {sorted(kinds - rule.keys())}")
    ok, wrong = F.lit(None).cast("boolean"), F.lit(0)
    for kind, holds in rule.items():
        ok = F.when(F.col("kind") == kind, holds).otherwise(ok)
    for kind, count in (("never", F.col("rows")), ("apart", F.col("shared")), ("histogram", F.greatest(F.col("values"), F.col("wanted")) - F.col("right")), ("unique", F.col("rows") - F.col("values"))):
        wrong = F.when(F.col("kind") == kind, count).otherwise(wrong)
    return out.select("name", "kind", ok.alias("ok"), "rows", "values", "least", "most", wrong.alias("wrong"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: ready if all holds, else blocked, with the names of what doesn't."""
    problems = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    return found.agg(problems.alias("problems")).select(F.when(F.size("problems") == 0, "ready").otherwise("blocked").alias("status"), "problems")
