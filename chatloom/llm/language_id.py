"""Language identification with rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded by a blank) by falling frequency. A text's own
profile is compared with each language's by the out-of-place distance: the sum of rank differences, where an n-gram that the
language lacks costs the profile's length. The nearest language wins, the alphabetically first on a tie.

Null or letterless texts give `und` with score 0. Letters outside the basic plane count as one letter. Rows are judged one by
one, so repeated rows and ids give repeated results; other columns are never read. Without a single labelled text every text is
`und`. Training reads all labelled texts: profiles are sums over them, and bounds of scores come from counts of all their scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.kernel import lean, segment_sum

CHARS, ROWS = 1 << 18, 16_384
#: Scores are counted by steps of 1 / STEPS for bounds.
STEPS = 10_000
#: A language's rows are ranked in so many parts first.
SALTS = 64
UND = "und"


@cache
def letter_ids() -> np.ndarray:
    """For each code point the lower-cased letter as a number from 2, or 0."""
    ids = np.zeros(0x110000, dtype=np.uint16)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            low = c.lower()
            ids[code] = min(ord(low if len(low) == 1 else c), 65535)
    return ids


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all texts, sorted by text and n-gram."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = letter_ids()[codes]
    letter = ids > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each gap only the first blank
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    s = np.concatenate([np.ones(1, dtype=np.uint64), np.maximum(ids[keep], 1).astype(np.uint64)])
    d = np.concatenate([np.zeros(1, dtype=np.uint64), doc[keep]]) << np.uint64(48)
    inner = s > 1
    two = (s[:-1] << np.uint64(16)) | s[1:]
    parts = [(s | d)[inner], (two | d[1:])[inner[1:] | inner[:-1]]]
    if len(s) > 2:
        parts.append(((s[:-2] << np.uint64(32)) | two[1:] | d[2:])[inner[1:-1]])
    keys = np.concatenate(parts).astype(np.int64)
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(at, len(keys)))
    return keys[at] >> 48, keys[at] & ((1 << 48) - 1), counts


def pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    upto = np.append(0, np.cumsum(pc.utf8_length(column).fill_null(0).to_numpy().astype(np.int64)))
    lo = 0
    while lo < len(column):
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHARS, "right")) - 1))
        yield lo, hi, column[lo:hi].fill_null("").to_pylist()
        lo = hi


@dataclass
class Profiles:
    """languages: sorted names; grams: sorted n-grams of all profiles; ranks[g, l]: rank of gram g in language l, or length."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    length: int

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest language, -1 for none, and 1 minus the distance as a share of the largest one."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        doc, gram, count = gram_counts(texts)
        if not len(doc) or not self.languages:
            return best, score
        order = np.argsort((doc << 32) + (0x7FFFFFFF - count), kind="stable")
        doc, gram = doc[order], gram[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        rank = np.arange(len(doc)) - bounds[doc]
        top = rank < self.length
        doc, gram, rank = doc[top], gram[top], rank[top]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        size = np.diff(bounds)
        away = np.empty((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            there = np.where(known, self.ranks[at, k], self.length)
            away[k] = segment_sum(np.where(there < self.length, np.abs(there - rank), self.length), bounds)
        some = size > 0
        best[some] = away[:, some].argmin(axis=0)
        score[some] = 1 - away[:, some].min(axis=0) / (size[some] * self.length)
        return best, np.clip(score, 0, 1)


def least(rows: DataFrame, order: list, salt: Column, n: int, by: str = "lang") -> DataFrame:
    """The first n rows of each value of `by` in that order, with their rank; first of each of SALTS parts, so that no task takes all of a value."""
    parts = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    for keys in ([by, "_salt"], [by]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return parts.drop("_salt")


def length_class(text: Column) -> Column:
    """Texts of 2^k to 2^(k+1) - 1 characters share a class."""
    return F.floor(F.log2(F.greatest(F.char_length(text), F.lit(1)))).cast("int")


def least_scores(labelled: DataFrame, profiles: Profiles, share: float = 0.01, slack: float = 0.7) -> Callable[[Column], Column]:
    """From all rows that the profiles were learned from, the score below which a text of its length is unlike them: slack times what all
    but `share` of them reach, rounded down to 1 / STEPS. A length with fewer than 1 / share learned rows takes no more than what holds
    for all lengths. What comes to the driver is at most STEPS + 1 counts a length."""
    texts = labelled.where("lang is not null and text is not null").select("text")
    rows = judged(texts, profiles).where(F.col("lang_pred") != UND).select(length_class(F.col("text")).alias("k"), F.floor(F.col("score") * STEPS).alias("step"))
    counts: dict[int, np.ndarray] = {}
    for r in rows.groupBy("k", "step").count().collect():
        counts.setdefault(r.k, np.zeros(STEPS + 1, dtype=np.int64))[r.step] = r["count"]
    low = lambda n: float(np.searchsorted(np.cumsum(n), share * (n.sum() - 1), "right")) / STEPS  # noqa: E731  the step of the row that `share` of the others lie below
    every = low(sum(counts.values())) if counts else 0.0
    bounds = {k: slack * (low(n) if n.sum() * share >= 1 else min(low(n), every)) for k, n in counts.items()}

    def bound(text: Column) -> Column:
        out, k = F.lit(slack * every), length_class(text)
        for key, value in sorted(bounds.items()):
            out = F.when(k == key, value).otherwise(out)
        return out

    return bound


def learn(labelled: DataFrame, length: int = 300) -> Profiles:
    """Profiles from rows (id, text, lang) whose lang isn't null. What comes to the driver is `length` rows a language."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], dtype=np.int64)
            for lo, _, texts in pieces(batch.column(1)):
                doc, gram, n = gram_counts(texts)
                key = (of[lo + doc] << 48) | gram
                keys, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keys >> 48], pa.string()), pa.array(keys & ((1 << 48) - 1)), pa.array(np.bincount(at, n, len(keys)).astype(np.int64))], names=["lang", "gram", "n"])

    grams = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = least(grams, [F.desc("n"), "gram"], F.xxhash64("gram"), length).select("lang", "gram", "rank").collect()
    languages, all_grams = sorted({r.lang for r in top}), np.array(sorted({r.gram for r in top}), dtype=np.int64)
    ranks = np.full((len(all_grams), len(languages)), length, dtype=np.int32)
    for r in top:
        ranks[np.searchsorted(all_grams, r.gram), languages.index(r.lang)] = r.rank - 1
    return Profiles(languages, all_grams, ranks, length)


def judged(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All of docs' columns, then lang_pred and score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.languages, UND], dtype=object)
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for lo, hi, texts in pieces(batch.column(at)):
                best[lo:hi], score[lo:hi] = profiles.judge(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def identify(docs: DataFrame, train: Column, length: int = 300) -> DataFrame:
    """Learns from all rows of docs (id, text, lang, ...) where `train` holds and judges every row."""
    profiles = learn(docs.where(train).select("text", "lang"), length)
    return judged(docs, profiles)
