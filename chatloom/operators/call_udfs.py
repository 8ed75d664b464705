"""The Arrow UDFs over chatloom.operators.calls; apart from it, since workers import that module without a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import calls as K
from chatloom.operators.batches import read

CALLS = "array<struct<name:string,arguments:string>>"


@F.pandas_udf("string")
def render_udf(calls: pd.Series, prefix: pd.Series) -> pd.Series:
    return pd.Series([K.render(a, b) for a, b in zip(calls, prefix, strict=True)], dtype=object)


@F.pandas_udf("string")
def reference_udf(text: pd.Series) -> pd.Series:
    return text.map(K.literal_reference)


PARSED = f"struct<content:string,calls:{CALLS}>"


def with_parse(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with content and native calls of a text."""
    return read(rows, text, name, PARSED, K.parsed)


def with_parse_any(rows: DataFrame, text: str, name: str) -> DataFrame:
    return read(rows, text, name, PARSED, K.parsed_any)


def with_spans(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the spans of calls in a text."""
    return read(rows, text, name, "array<struct<start:int,stop:int,role:int>>", K.spans)


@F.pandas_udf("boolean")
def same_udf(key: pd.Series, got: pd.Series, want: pd.Series) -> pd.Series:
    return pd.Series([K.same(k, a, b) for k, a, b in zip(key, got, want, strict=True)], dtype=object)


@F.pandas_udf("strict boolean, elastic boolean")
def legacy_udf(prediction: pd.Series, answer: pd.Series, category: pd.Series, tried: pd.Series) -> pd.DataFrame:
    known = lambda t: None if t is None or pd.isna(t) else bool(t)
    return pd.DataFrame([K.legacy(p, a, c, known(t)) for p, a, c, t in zip(prediction, answer, category, tried, strict=True)], columns=["strict", "elastic"])


@F.pandas_udf("array<string>")
def leaves_udf(text: pd.Series) -> pd.Series:
    return text.map(K.leaf_texts)


@F.pandas_udf("array<struct<role:string,content:string>>")
def messages_udf(text: pd.Series) -> pd.Series:
    return text.map(K.messages_of)


@F.pandas_udf("string")
def indented_udf(text: pd.Series) -> pd.Series:
    return text.map(K.indented)
