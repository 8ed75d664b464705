"""Spans in texts and the tokens that they touch, by document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.batches import read

#: Positions that share a cell meet by an equal key, so an overlap join needs no product of tokens and spans.
CELL = 64


#: What a fence holds, and what stands between single marks. Neither a language nor white space holds a mark, so neither is tried again shorter.
LITERAL = re.compile(r"`(?:``[A-Za-z0-9_-]*+[ \t\n\x0b\f\r]*+([\s\S]*?)```|(?<!``)([^`\n]+)`(?!`))")


def literals(text: str | None) -> list[dict]:
    """Where code stands in a text: within fences, and between single marks outside of them. A fence's language isn't code."""
    return [dict(zip(("start", "stop"), m.span(m.lastindex), strict=True)) for m in LITERAL.finditer(text or "")]


def with_literals(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the literals of a text, an array of (start, stop)."""
    return read(rows, text, name, "array<struct<start:int,stop:int>>", literals)


def literal_spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, stop of all literals."""
    return with_literals(rows.select(key, text), text, "_s").select(key, F.explode("_s").alias("s")).select(key, "s.start", "s.stop")


def overlapping(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, start, stop and what else tells them apart) with the largest role of the spans (key, start, stop, role) that they touch, else 0."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    t = tokens.withColumn("cell", cells("start", "stop"))
    s = spans.where("stop > start").select(F.col(key).alias("_key"), F.col("start").alias("x"), F.col("stop").alias("y"), "role").withColumn("_cell", cells("x", "y"))
    rows = t.join(s, (F.col(key) == F.col("_key")) & (F.col("cell") == F.col("_cell")) & (F.col("x") < F.col("stop")) & (F.col("y") > F.col("start")), "left")
    return rows.groupBy(*tokens.columns).agg(F.coalesce(F.max("role"), F.lit(0)).alias("role"))
