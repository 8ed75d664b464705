"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Features are words without punctuation at their ends. Examples are at most `per_class` rows of each label,
the lowest by a hash of their id. Cross-validation over the examples decides which features count: all of them, or those that stand in
toxic examples significantly more often (log-likelihood ratio, near copies counted once) at one of several levels. Near copies, which
share a minimum of hashed word 5-grams, are in one fold. Document frequencies are counted over all documents. Examples are cut in blocks;
the index keeps each feature's postings and its largest weight in every block, which bounds what any example of a block can score, so
whole blocks are passed over without losing one of the k nearest. The k nearest vote with weights that fall with the distance; a
logistic curve, fitted on the votes of examples in the folds that didn't know them and weighted to the labels' true shares, makes the
vote a probability. A text without any feature gets the share of toxic labels among such examples.

Null, empty and featureless texts get that share too; long texts are read whole. Rows are scored one by one, so repeated rows score
alike. Of an example's repeated ids the least text counts. A document with several labels counts as toxic if one says so; null labels
and ids are none. Without both labels the score is the share of toxic labels, or 0. Other columns are not read. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.kernel import U, Lookup, Words, binaries, chunks, mix, segment_sum, shingle_sets
from chatloom.llm.language_id import least

BLOCK, K = 64, 15
#: What cross-validation chooses from: the least log-likelihood ratio of a feature, 0 for all features; and into how many folds examples fall.
LEVELS, FOLDS = (0.0, 4.0, 8.0, 16.0, 32.0), 4
#: Bytes that are taken off the ends of words.
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare(w: Words) -> Words:
    """The words without punctuation at their ends, but for those that are nothing else."""
    solid = np.flatnonzero(~MARKS[w.buf])
    first, last = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end)
    some = last > first
    start, end = solid[first[some]], solid[last[some] - 1] + 1
    return Words(w.buf, start, end, np.append(0, np.cumsum(segment_sum(some.astype(np.int64), w.bounds))), w.sums)


def features_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of all words."""
    w = bare(w)
    return w.docs(), w.hashes()


def counted(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) with their counts, by text."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[at], feature[at], np.diff(np.append(at, len(doc)))


@dataclass
class Model:
    lookup: Lookup
    idf: np.ndarray
    labels: np.ndarray
    ids: list[int]
    nothing: float
    curve: tuple[float, float] = (0.0, 0.0)
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    peak_start: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    peak_block: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    peak: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def index(self, doc: np.ndarray, feature: np.ndarray, tf: np.ndarray) -> None:
        """Postings by feature and, for each, the largest weight in every block of examples that has it."""
        weight = self.weights(doc, feature, tf, len(self.labels))
        order = np.lexsort((doc, feature))
        feature, self.example, self.weight = feature[order], doc[order], weight[order]
        self.start = np.searchsorted(feature, np.arange(len(self.idf) + 1))
        block = self.example // BLOCK
        new = np.flatnonzero(np.append(True, (feature[1:] != feature[:-1]) | (block[1:] != block[:-1]))) if len(feature) else np.zeros(0, dtype=np.int64)
        self.peak_block = block[new]
        self.peak = np.maximum.reduceat(self.weight, new) if len(new) else self.weight
        self.peak_start = np.searchsorted(feature[new], np.arange(len(self.idf) + 1))

    def weights(self, doc: np.ndarray, feature: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        raw = (1 + np.log(tf)) * self.idf[feature]
        return raw / np.sqrt(np.bincount(doc, raw * raw, n))[doc]

    def nearest(self, feature: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties, to twelve places, to the lower number) and the cosines. Blocks are taken by falling bound until none left can hold a better one."""
        example, value = gathered(self.start, self.example, self.weight, feature, weight)
        block = example // BLOCK
        bound = np.bincount(*gathered(self.peak_start, self.peak_block, self.peak, feature, weight), -(-len(self.labels) // BLOCK))
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(len(order), dtype=np.int64)
        turn[order] = np.arange(len(order))
        order, turn = order[bound[order] > 0], turn[block]
        scores, done, floor, width = np.zeros(len(self.labels)), 0, 0.0, 8
        while done < len(order) and bound[order[done]] >= floor - 1e-9:
            to = done + int((bound[order[done : done + width]] >= floor - 1e-9).sum())
            live = (turn >= done) & (turn < to)
            scores += np.bincount(example[live], value[live], len(self.labels))
            if np.count_nonzero(scores) >= k:
                floor = np.partition(scores, -k)[-k]
            done, width = done + width, width * 2
        some = np.flatnonzero(scores > max(floor - 1e-9, 0)) if floor else np.flatnonzero(scores)
        best = some[np.lexsort((some, -np.round(scores[some], 12)))][:k]
        return best, scores[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        pull = cosine / (1.05 - np.minimum(cosine, 1))
        return float((pull * self.labels[best]).sum() / pull.sum())

    def score(self, w: Words) -> tuple[np.ndarray, list[str]]:
        """The probability of label 1 for each text, and as evidence the nearest examples' ids."""
        n = len(w.bounds) - 1
        out, evidence = np.full(n, self.nothing), [""] * n
        if not len(self.labels):
            return out, evidence
        doc, feature, tf = self.known(w)
        weight = self.weights(doc, feature, tf, n)
        bounds, seen = np.searchsorted(doc, np.arange(n + 1)), {}
        for i in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[i], bounds[i + 1])
            key = (feature[own].tobytes(), tf[own].tobytes())
            if key not in seen:
                best, cosine = self.nearest(feature[own], weight[own], K)
                seen[key] = (self.calibrated(self.vote(best, cosine)), " ".join(str(self.ids[b]) for b in best[:3])) if len(best) else (self.nothing, "")
            out[i], evidence[i] = seen[key]
        return out, evidence

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, feature = features_of(w)
        at = self.lookup.find(feature)
        return counted(doc[at >= 0], at[at >= 0])

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1]))))


def fitted(vote: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through weighted votes, by Newton's method with a small ridge."""
    x, beta = np.stack([vote, np.ones(len(vote))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-2, 1e-2])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
    return float(beta[0]), float(beta[1])


def ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a feature in a of na and b of nb examples."""
    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-9)), 0.0)

    t, n = a + b, na + nb
    return 2 * (part(a, t * na / n) + part(b, t * nb / n) + part(na - a, (n - t) * na / n) + part(nb - b, (n - t) * nb / n))


def packed(rows: DataFrame) -> DataFrame:
    """(id, toxic, feature hashes and counts) of labelled rows (id, toxic, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in chunks(batch.column(2)):
                doc, feature, tf = counted(*features_of(w))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], binaries(feature, bounds), binaries(tf.astype(np.int32), bounds), minima(w)], names=["id", "toxic", "feature", "tf", "minima"])

    return rows.mapInArrow(run, "id long, toxic int, feature binary, tf binary, minima binary")


def minima(w: Words, hashes: int = 4) -> pa.Array:
    """For each text the least of its 5-grams under each of several hashes, nothing for a text without words."""
    grams, bounds = shingle_sets(w, 5)
    some = np.flatnonzero(np.diff(bounds))
    least = np.stack([np.minimum.reduceat(mix(grams ^ U(k + 1)), bounds[some]) for k in range(hashes)], axis=1) if len(some) else np.zeros((0, hashes), dtype=U)
    ends = np.zeros(len(bounds), dtype=np.int64)
    ends[some + 1] = hashes
    return binaries(least.ravel(), np.cumsum(ends))


def gathered(start: np.ndarray, place: np.ndarray, value: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some features one after another, their values times the feature's weight."""
    many = start[feature + 1] - start[feature]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[feature], many)
    return place[at], value[at] * np.repeat(weight, many)


def near_copies(rows: list) -> np.ndarray:
    """For each row the first that it shares a minimum with, directly or over others."""
    root, seen = list(range(len(rows))), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, r in enumerate(rows):
        for key in enumerate(np.frombuffer(r.minima, dtype=U).tolist()):
            j, i_root = find(seen.setdefault(key, i)), find(i)
            root[max(j, i_root)] = min(j, i_root)
    return np.array([find(i) for i in range(len(rows))], dtype=np.int64)


@dataclass
class Examples:
    """Labelled texts: ids, labels y, near-copy groups, the hashes of all features and (doc, at, tf), how often feature `at` stands in a text."""

    ids: list[int]
    y: np.ndarray
    group: np.ndarray
    names: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    tf: np.ndarray

    @cached_property
    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """Each feature with each group of near copies and label that have it: the feature, and the group's number doubled plus the label."""
        span = 2 * len(self.y)
        key = np.unique(self.at * span + 2 * self.group[self.doc] + self.y[self.doc])
        return key // span, key % span

    def significant(self, level: float, use: np.ndarray) -> np.ndarray:
        """The features of the used texts (near copies are used together), all at level 0, else those that toxic ones have significantly and four times as often."""
        if not level:
            return np.unique(self.at[use[self.doc]])
        feature, of = self.units
        of = np.isin(of, 2 * self.group[use] + self.y[use])
        bad, good = (np.bincount(feature[of & (self.units[1] % 2 == v)], minlength=len(self.names)) for v in (1, 0))
        n1, n0 = (len(np.unique(self.group[use & (self.y == v)])) for v in (1, 0))
        if not n1 or not n0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero((ratio(bad.astype(float), good.astype(float), n1, n0) >= level) & (bad / n1 >= 4 * good / n0))

    def model(self, chosen: np.ndarray, idf: np.ndarray, use: np.ndarray) -> Model:
        """An index of the used texts that have a chosen feature; idf is by feature."""
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        part = (place[self.at] >= 0) & use[self.doc]
        some = np.unique(self.doc[part])
        out = Model(Lookup(self.names[chosen]), idf[chosen], self.y[some].astype(float), [self.ids[i] for i in some], 0.0)
        out.index(np.searchsorted(some, self.doc[part]), place[self.at[part]], self.tf[part])
        return out

    def votes(self, models: list[Model], fold: np.ndarray) -> np.ndarray:
        """Every text's vote by the model of its fold, which doesn't know it; nan without any neighbour."""
        out, bounds = np.full(len(self.y), np.nan), np.searchsorted(self.doc, np.arange(len(self.y) + 1))
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            m = models[fold[i]]
            found = m.lookup.find(self.names[self.at[lo:hi]])
            feature, tf = found[found >= 0], self.tf[lo:hi][found >= 0]
            if len(feature) and len(m.labels):
                best, cosine = m.nearest(feature, m.weights(np.zeros(len(feature), dtype=np.int64), feature, tf, 1), K)
                if len(best):
                    out[i] = m.vote(best, cosine)
        return out


def examples(docs: DataFrame, labels: DataFrame, per_class: int) -> Examples:
    """At most per_class texts of each label with all their features; they come to the driver."""
    some = least(labels.withColumn("_hash", F.xxhash64("id")), ["_hash", "id"], F.col("_hash"), per_class, "toxic").select("id", "toxic")
    rows = docs.join(F.broadcast(some), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))  # at most 2 * per_class ids
    got = packed(rows).orderBy("id").collect()
    doc = np.repeat(np.arange(len(got)), [len(r.feature) // 8 for r in got])
    names, at = np.unique(np.frombuffer(b"".join(r.feature for r in got), dtype=U), return_inverse=True)
    return Examples([r.id for r in got], np.array([r.toxic for r in got], dtype=np.int64), near_copies(got), names, doc, at, np.frombuffer(b"".join(r.tf for r in got), dtype=np.int32))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, levels: tuple[float, ...] = LEVELS) -> Model:
    """docs: (id, text); labels: (id, toxic), only those to learn from. What comes to the driver are 2 * per_class examples and their features' counts."""
    labels = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    e, total = examples(docs, labels, per_class), sum(shares.values())
    n = {k: int((e.y == k).sum()) for k in (1, 0)}
    if not n[1] or not n[0]:
        return Model(Lookup(np.zeros(0, dtype=U)), np.zeros(0), np.zeros(0), [], shares.get(1, 0) / total if total else 0.0)
    weight = np.where(e.y == 1, shares[1] / n[1], shares[0] / n[0])
    fold = (mix(e.group.astype(U)) % U(FOLDS)).astype(np.int64)
    every = np.ones(len(e.y), dtype=bool)

    def tried(level: float, idf: np.ndarray) -> tuple[np.ndarray, float, tuple[float, float]]:
        """Votes of all examples at this level, the log loss that they leave, and what makes them probabilities."""
        vote = e.votes([e.model(e.significant(level, fold != k), idf, fold != k) for k in range(FOLDS)], fold)
        none = np.isnan(vote)
        nothing = (0.5 + weight[none & (e.y == 1)].sum()) / (1 + weight[none].sum())
        curve = fitted(vote[~none], e.y[~none], weight[~none])
        p = np.full(len(vote), nothing)
        p[~none] = 1 / (1 + np.exp(-(curve[0] * vote[~none] + curve[1])))
        loss = -(weight * np.log(np.clip(np.where(e.y == 1, p, 1 - p), 1e-6, 1))).sum() / weight.sum()
        return nothing, loss, curve

    own = np.log((len(e.y) + 1) / (np.bincount(e.at, minlength=len(e.names)) + 1)) + 1e-6  # among the examples: enough to compare levels
    level = min(levels, key=lambda x: tried(x, own)[1])
    chosen = np.unique(np.concatenate([e.significant(level, every if k < 0 else fold != k) for k in range(-1, FOLDS)]))
    n_docs, df = frequencies(docs, Lookup(e.names[chosen]))
    idf = np.zeros(len(e.names))
    idf[chosen] = np.log((n_docs + 1) / (df + 1)) + 1e-6
    model = e.model(e.significant(level, every), idf, every)
    model.nothing, _, model.curve = tried(level, idf)
    return model


def frequencies(docs: DataFrame, lookup: Lookup) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each feature stands: counts over all of docs, one row a feature and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(lookup.keys), dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, _, w in chunks(batch.column(0)):
                doc, feature = features_of(w)
                at = lookup.find(feature)
                df += np.bincount(counted(doc[at >= 0], at[at >= 0])[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["feature", "n"])

    out = np.zeros(len(lookup.keys))
    got = {r.feature: r.n for r in docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(-1, 0)
    for k, n in got.items():
        out[k] = n
    return total, out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (id, text) as id, score, evidence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in chunks(batch.column(1)):
                score, evidence = model.score(w)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(score), pa.array(evidence, pa.string())], names=["id", "score", "evidence"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double, evidence string")
