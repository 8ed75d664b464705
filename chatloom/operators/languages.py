"""The language of a text by naive Bayes over its runs of three characters, learned from labelled texts.

Characters are lower-cased, and all but letters are one blank. A run falls in one of 65536 places by its characters' codes, and what is counted is
runs by language and place; so the model has 65536 numbers a language however large the corpus is, a task sends as many at most, and a
text is read in one vectorised pass. Equally likely languages: the first by name. A text without letters has no language (null)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 16
GAP = r"[^\p{L}\p{M}]+"


def letters(text: Column) -> Column:
    """Words of letters, each with a blank before and after; empty without any."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, " ")


def places(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = ((c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    """weights: by place and language, the log of the share of a language's runs that fall there."""

    names: list[str]
    weights: np.ndarray

    def detect(self, text: str) -> str | None:
        at = places(text)
        return self.names[int(self.weights[at].sum(axis=0).argmax())] if len(at) and self.names else None

    def column(self, text: Column) -> Column:
        @F.pandas_udf("string")
        def found(texts: pd.Series) -> pd.Series:
            return texts.map(self.detect)

        return found(letters(text))


def learn(rows: DataFrame, text: str, language: str, most: int = 64) -> Model:
    """A model of rows with a language. There may be `most` languages at most."""
    names = sorted(r[0] for r in rows.where(F.col(language).isNotNull()).select(language).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), PLACES), np.int64)
        number = {n: k for k, n in enumerate(names)}
        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[number[n]] += np.bincount(places(t), minlength=PLACES)
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(counts[k, at])], names=["language", "place", "n"])

    labelled = rows.where(F.col(language).isNotNull()).select(letters(F.col(text)).alias("t"), F.col(language).alias("l"))
    sums = labelled.mapInArrow(run, "language long, place long, n long").groupBy("language", "place").agg(F.sum("n").alias("n"))
    counts = np.zeros((PLACES, len(names)))
    found = sums.toArrow()  # at most 65536 rows a language
    counts[found.column("place").to_numpy(), found.column("language").to_numpy()] = found.column("n").to_numpy()
    return Model(names, np.log((counts + 1) / (counts.sum(axis=0) + PLACES)))
