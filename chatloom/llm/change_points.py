"""Penalised change points of many daily series at once.

Rows become one total a key and day, and each key's days one row of at most as many entries as its series has days; both sums combine
before their shuffle, so a key with a third of all rows costs a row a day and task. Inside mapInArrow the series, sorted by length, are
padded to tensors of about `CELLS` numbers. One sweep over the days extends all series of a tensor by a day and tries all starts of
the last segment at the same time; starts that would leave a segment too short are masked, and one argmin takes the best.

Sums and squares are whole numbers: where the largest product stays below 2^53 they are kept in float64, which is exact there, and
beyond it as Python integers. Time grows with the square of a series' days, memory with their number.

Rows without a value or a time count nowhere; a null key is a key of its own; repeated rows count repeatedly; days without rows count 0.
An empty table gives an empty one. Other columns are not read. A spread beyond a long's range is given as its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 15
EXACT = 1 << 53
LONG = (1 << 63) - 1
COLUMNS = ["segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]
_ln = np.frompyfunc(lambda v: math.floor(1000 * math.log(v)), 1, 1)


def spreads(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 + floor of the variance, of n days with sum s and sum of squares q."""
    return (n * q - s * s) // (n * n) + 1 if s.dtype == object else np.floor((n * q - s * s) / (n * n)) + 1


def costs(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    return n * (_ln(v) if v.dtype == object else np.floor(1000 * np.log(v)))


def sweep(x: np.ndarray, least: int, penalty: int) -> np.ndarray:
    """x (days, series), whole numbers. For each day and series: where the last segment of the best cut of the days up to it starts.

    A cut's key is its cost times more than there can be segments, plus its number of segments, so that one minimum takes the cheapest
    and then the fewest; the first of equal minima is the earliest start, and what lies before it was chosen by the same rule."""
    days, series = x.shape
    s, q = np.zeros((days + 1, series), x.dtype), np.zeros((days + 1, series), x.dtype)
    s[1:], q[1:] = np.cumsum(x, axis=0), np.cumsum(x * x, axis=0)
    unit, start = days + 1, np.zeros((days + 1, series), np.int64)
    key = np.full((days + 1, series), (1 << 200) if x.dtype == object else np.inf, x.dtype)  # masked: no cut ends here
    key[0] = -penalty * unit
    for end in range(least, days + 1):
        starts = end - least + 1
        n = (end - np.arange(starts)).astype(x.dtype)[:, None]
        v = spreads(n, s[end] - s[:starts], q[end] - q[:starts])
        found = key[:starts] + (costs(n, v) + penalty) * unit + 1
        start[end] = found.argmin(axis=0)
        key[end] = found[start[end], np.arange(series)]
    return start


def is_exact(x: np.ndarray, penalty: int) -> bool:
    """Whether float64 holds all numbers that a sweep over x (days, series) meets."""
    days = len(x)
    size = np.abs(x.astype(np.float64))
    return bool(max(days * (size * size).sum(axis=0).max(), size.sum(axis=0).max() ** 2, (days + 1.0) * days * (44_000 + penalty)) < EXACT / 2)


def cut(x: np.ndarray, lengths: np.ndarray, least: int, penalty: int) -> list[np.ndarray]:
    """x (days, series), padded below each series' length. Arrays, a row a segment: series, then the result's columns, first_day from 0."""
    start = sweep(x, least, penalty)
    days, series = x.shape
    s, q = np.zeros((days + 1, series), x.dtype), np.zeros((days + 1, series), x.dtype)
    s[1:], q[1:] = np.cumsum(x, axis=0), np.cumsum(x * x, axis=0)
    start[:least] = 0  # what is shorter is one segment
    found, at, end = [], np.arange(series), lengths.copy()
    while len(at):  # each turn takes the last segment that a series has left
        begin = start[end, at]
        n = (end - begin).astype(x.dtype)
        total = s[end, at] - s[begin, at]
        v = spreads(n, total, q[end, at] - q[begin, at])
        found.append((at, begin, end - begin, total, v, costs(n, v)))
        at, end = at[begin > 0], begin[begin > 0]
    at, begin, n, total, v, cost = (np.concatenate(c) for c in zip(*found, strict=True))
    whole = [c if c.dtype != object else np.array([max(-LONG - 1, min(int(y), LONG)) for y in c], np.int64) for c in (total, v, cost)]
    total, v, cost = (c.astype(np.int64) for c in whole)
    order = np.lexsort((begin, at))
    at, begin, n, total, v, cost = (c[order] for c in (at, begin, n, total, v, cost))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    many = np.diff(np.append(first, len(at)))
    best = np.add.reduceat(cost, first) + penalty * (many - 1)
    return [at, np.arange(len(at)) - np.repeat(first, many) + 1, begin, n, total, v, cost, np.repeat(many, many), np.repeat(best, many)]


def tensors(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Series by rising length, in runs whose padded tensor has about CELLS numbers; a longer series makes one of its own."""
    order, lo = np.argsort(lengths, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] <= CELLS:
            hi += 1
        yield order[lo:hi]
        lo = hi


def daily(rows: DataFrame) -> DataFrame:
    """rows (key, at, value): key, day (since 1970) and the day's total."""
    taken = rows.where("at is not null and value is not null").select("key", F.unix_date(F.col("at").cast("date")).cast("long").alias("day"), F.col("value").cast("long").alias("value"))
    return taken.groupBy("key", "day").agg(F.sum("value").alias("total"))


def segments(rows: DataFrame, least: int = 14, penalty: int = 40_000) -> DataFrame:
    """rows (key, at, value): the segments of each key's daily series, with key, segment_no and the other COLUMNS."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, for few bytes here are much work
    totals = daily(rows).repartition(parts, "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "total"))).alias("series"))
    series = totals.select("key", F.col("series.day").alias("days"), F.col("series.total").alias("totals"), (F.element_at("series.day", -1) - F.element_at("series.day", 1)).alias("span")).sortWithinPartitions("span")
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, T.IntegerType() if c == "segment_no" else T.LongType()) for c in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, days, totals = batch.column(0), batch.column(1), batch.column(2)
            bounds = days.offsets.to_numpy().astype(np.int64)
            day, total = days.values.to_numpy(), totals.values.to_numpy()
            first, lengths = day[bounds[:-1]], day[bounds[1:] - 1] - day[bounds[:-1]] + 1
            for some in tensors(lengths):
                x = np.zeros((lengths[some[-1]], len(some)), np.int64)
                for j, i in enumerate(some):
                    own = slice(bounds[i], bounds[i + 1])
                    x[day[own] - first[i], j] = total[own]
                fits = is_exact(x, penalty)
                for piece in [some] if fits or len(some) == 1 else np.split(some, len(some)):
                    y = x if len(piece) == len(some) else x[: lengths[piece[0]], some == piece[0]]
                    at, number, begin, *rest = cut(y.astype(np.float64 if fits or is_exact(y, penalty) else object), lengths[piece], least, penalty)
                    of = piece[at]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(number, pa.int32()), pa.array(begin + first[of]), *map(pa.array, rest)], names=["key", *COLUMNS])

    return series.select("key", "days", "totals").mapInArrow(run, schema)
