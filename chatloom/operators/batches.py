"""Texts that Python reads in runs of bounded size, however many rows an Arrow batch has; workers import this module without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A run ends before it has more characters or rows; a longer text is a run of its own.
CHARS, ROWS = 1 << 18, 1024


def runs(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """From, to and the texts of each run."""
    lo = 0
    while lo < len(column):
        texts, size = [], 0
        for x in column[lo : lo + ROWS]:
            t = x.as_py()
            size += len(t or "")
            if texts and size > CHARS:
                break
            texts.append(t)
        yield lo, lo + len(texts), texts
        lo += len(texts)


def read(rows: DataFrame, text: str, name: str, kind: str, f: Callable[[str | None], object]) -> DataFrame:
    """rows with what f makes of a text; what a task holds is a run's results."""
    names = rows.columns
    found = T._parse_datatype_string(kind)
    arrow, at = to_arrow_type(found), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in runs(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(map(f, texts), arrow)], names=[*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, found)]))
