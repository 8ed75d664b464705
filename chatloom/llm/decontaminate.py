"""Benchmark decontamination: rare word n-gram seeds join passages of the training texts to test items, and Smith-Waterman
alignment of the passage with the item scores exact, edited and paraphrased copies.

A seed is the shortest run of 3 to 8 item words whose expected number of chance occurrences, from the frequencies of its words over
all documents, is at most `chance`. So a seed stays rare by its words however often the item itself leaked. Items without any such
run use their longest runs. Besides, of each item six runs of three words that don't overlap, the rarest, are seeds whatever the size of the corpus, so that a
copy with few words left in a row is found in a large corpus as in a small one. Seeds that stand near one another make a passage; it is aligned with the item by words (match 2,
mismatch -1, gap -1), and its score is the alignment's share of the best possible one.

Items are taken in blocks of bounded number and size from the benchmark, all documents against each block, so what a task holds is
bounded. Null and empty texts and items match nothing; long ones are read whole. Repeated rows of an id give one result, the best.
`without_leaks` judges every row by itself and keeps all columns, whatever their names. An empty table gives an empty one, and an empty
benchmark no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.kernel import U, Lookup, Words, chunks, lean, ngrams
from chatloom.llm.store import kept

SHORTEST, LONGEST, PAD = 3, 8, 4
#: So many of an item's shortest runs, the rarest that don't overlap, are always seeds.
ALWAYS = 6
#: Text of a block of items.
BYTES = 1 << 24


@dataclass
class Items:
    """ids and words (hashes) of some items; seeds by length: a lookup, and for each key its places (item, word) as a range of `places`."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: dict[int, tuple[Lookup, np.ndarray, np.ndarray]]


def word_lists(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, w in chunks(pa.array(texts, pa.string())):
        h = w.hashes()
        out += [h[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def frequencies(docs: DataFrame, lookup: Lookup) -> tuple[int, np.ndarray]:
    """The number of words of all documents, and how many of them are each of the items' words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(lookup.keys) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, w in chunks(batch.column(0)):
                total += len(w.start)
                counts += np.bincount(lookup.find(w.hashes()) + 1, minlength=len(counts))
        some = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[1:][some], total))], names=["word", "n"])

    got = {r.word: r.n for r in docs.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(len(lookup.keys))
    total = got.pop(-1, 0)
    for k, n in got.items():
        counts[k] = n
    return total, counts


def prepared(docs: DataFrame, rows: list, chance: float) -> Items:
    lists = word_lists([r.text for r in rows])
    keep = [i for i, x in enumerate(lists) if len(x)]
    ids, lists = [rows[i].id for i in keep], [lists[i] for i in keep]
    vocabulary = np.unique(np.concatenate([*lists, np.zeros(0, dtype=U)]))
    lookup = Lookup(vocabulary)
    total, counts = frequencies(docs, lookup)
    logp = np.log(np.maximum(counts, 0.5) / max(1, total))
    spots: dict[int, list[tuple[int, int]]] = {}
    for i, x in enumerate(lists):
        p = np.append(0, np.cumsum(logp[np.searchsorted(vocabulary, x)]))
        found = []
        for at in range(len(x)):
            for n in range(SHORTEST, min(LONGEST, len(x) - at) + 1):
                if np.log(max(1, total)) + p[at + n] - p[at] <= np.log(chance):
                    found.append((n, at))
                    break
        n = min(LONGEST, len(x))
        found = found or [(n, at) for at in range(len(x) - n + 1)]
        apart: list[int] = []
        for _, at in sorted((p[at + SHORTEST] - p[at], at) for at in range(len(x) - SHORTEST + 1)):
            if len(apart) < ALWAYS and all(abs(at - b) >= SHORTEST for b in apart):
                apart.append(at)
        for n, at in sorted({*found, *((SHORTEST, at) for at in apart)}):
            spots.setdefault(n, []).append((i, at))
    seeds = {}
    for n, places in spots.items():
        hashes = np.array([ngrams(lists[i][at : at + n], np.array([0, n]), n)[0][0] for i, at in places], dtype=U)
        order = np.argsort(hashes, kind="stable")
        keys, start = np.unique(hashes[order], return_index=True)
        seeds[n] = (Lookup(keys), np.append(start, len(order)), np.array(places, dtype=np.int64)[order])
    return Items(ids, lists, seeds)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int]:
    """The best local alignment by words: its share of the highest score, and where it begins and ends in the passage and how many words match."""
    n = len(passage)
    gaps = np.arange(n + 1)
    best, end = 0, 0
    score = np.zeros(n + 1, dtype=np.int64)
    origin, same = np.arange(n + 1), np.zeros(n + 1, dtype=np.int64)
    found = (0, 0, 0)
    for word in item:
        hit = passage == word
        cell, down = score[:-1] + np.where(hit, 2, -1), score[1:] - 1
        take = cell >= down
        value = np.append(0, np.maximum(np.where(take, cell, down), 0))
        start = np.append(0, np.where(take, origin[:-1], origin[1:]))
        match = np.append(0, np.where(take, same[:-1] + hit, same[1:]))
        fresh = value == 0
        start[fresh], match[fresh] = gaps[fresh], 0
        run = value + gaps  # gaps along the passage: the best value to the left less one for each word
        lead = np.maximum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == lead, gaps, 0))
        score = np.maximum(lead - gaps, 0)
        origin = np.where(score > 0, start[source], gaps)
        same = np.where(score > 0, match[source], 0)
        at = int(score.argmax())
        if score[at] > best:
            best, end = int(score[at]), at
            found = (int(origin[at]), end, int(same[at]))
    return best / (2 * len(item)), *found


def leaks(w: Words, items: Items, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, first word, end, matching words) of the best passage for each text and item that reaches the threshold."""
    h = w.hashes()
    pos, item, at = [], [], []
    for n, (lookup, start, places) in items.seeds.items():
        grams, where = ngrams(h, w.bounds, n)
        got = lookup.find(grams)
        where, got = where[got >= 0], got[got >= 0]
        many = start[got + 1] - start[got]
        spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[got], many)
        pos.append(np.repeat(where, many))
        item.append(places[spot, 0])
        at.append(places[spot, 1])
    if not pos or not sum(map(len, pos)):
        return []
    pos, item, at = np.concatenate(pos), np.concatenate(item), np.concatenate(at)
    text = np.searchsorted(w.bounds, pos, side="right") - 1
    order = np.lexsort((pos - at, item, text))
    text, item, begin = text[order], item[order], (pos - at)[order]
    length = np.array([len(x) for x in items.words])
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > PAD + length[item[1:]] // 4)
    first = np.flatnonzero(new)
    best: dict[tuple[int, int], tuple] = {}
    for lo, hi in zip(first, np.append(first[1:], len(text)), strict=True):
        t, i = int(text[lo]), int(item[lo])
        m = int(length[i])
        pad = PAD + m // 4
        a, b = max(int(w.bounds[t]), int(begin[lo]) - pad), min(int(w.bounds[t + 1]), int(begin[hi - 1]) + m + pad)
        score, start, end, same = align(items.words[i], h[a:b])
        if score >= threshold and score > best.get((t, i), (0,))[0]:
            base = a - int(w.bounds[t])
            best[t, i] = (score, base + start, base + end, same)
    return [(t, i, *x) for (t, i), x in sorted(best.items())]


def item_blocks(docs: DataFrame, items: DataFrame, block: int, chance: float) -> Iterator[Items]:
    """The items (id, text) in blocks of at most about `block` of them and about BYTES of text, ready to be met by all documents."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    blocks = max(1, -(-n // block), -(-size // BYTES))
    for k in range(blocks):
        yield prepared(docs, items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect(), chance)


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.5, chance: float = 0.01, block: int = 20_000) -> DataFrame:
    """docs and items: (id, text). One row for each document and item that it holds: doc_id, item_id, score, first_word, end_word, n_matches.
    Rows of one id are one document, with its best passage; rows without an id are a document each."""
    def matcher(own: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for lo, hi, w in chunks(batch.column(1)):
                    if got := leaks(w, own, threshold):
                        text, item, *rest = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([ids[lo:hi].take(pa.array(text)), pa.array([own.ids[i] for i in item], pa.int64()), *map(pa.array, rest)], names=["doc_id", "item_id", "score", "first_word", "end_word", "n_matches"])
        return lean(run)

    schema = "doc_id long, item_id long, score double, first_word long, end_word long, n_matches long"
    parts = [docs.select("id", "text").mapInArrow(matcher(x), schema) for x in item_blocks(docs, items, block, chance)]
    best = F.max(F.struct("score", (-F.col("first_word")).alias("early"), "end_word", "n_matches")).alias("best")
    found = kept(reduce(DataFrame.unionByName, parts), "leaks")
    out = found.where("doc_id is not null").groupBy("doc_id", "item_id").agg(best)
    out = out.select("doc_id", "item_id", "best.score", (-F.col("best.early")).alias("first_word"), "best.end_word", "best.n_matches")
    return out.unionByName(found.where("doc_id is null"))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.5, chance: float = 0.01, block: int = 20_000) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, and no row is moved."""
    at, plain = docs.columns.index(text), docs.select(F.col(text).alias("text"))

    def sieve(own: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for lo, _, w in chunks(batch.column(at)):
                    for t, *_ in leaks(w, own, threshold):
                        clean[lo + t] = False
                yield batch.filter(pa.array(clean))
        return lean(run)

    out = docs
    for own in item_blocks(plain, items, block, chance):
        out = out.mapInArrow(sieve(own), docs.schema)
    return out
