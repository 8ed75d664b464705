"""Each operator against a plain version, on texts with nulls, blanks, very long ones, ties, repeats, and clashing extra columns."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, language_id, language_model, license_scan, line_dedup, mixing, nearest_vectors, token_counts, toxicity
from chatloom.llm.kernel import Lookup, chunks, shingle_sets
from chatloom.llm.queries import oracle_sql, queries
from tests.llm import plain

ROWS = plain.texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string").coalesce(2).cache()


def empty(spark, schema="id long, text string"):
    return spark.createDataFrame([], schema)


def test_words_and_shingles_equal_plain_ones():
    texts = [t for _, t in ROWS]
    column = pa.array(["x", *texts]).slice(1)
    seen, groups = [], {}
    for lo, hi, w in chunks(column, limit=200):
        assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in texts[lo:hi] for x in plain.words(t)]
        grams, bounds = shingle_sets(w, 5)
        seen += [frozenset(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for t, s in zip(texts, seen, strict=True):
        own = frozenset(plain.shingles(t))
        assert len(s) == len(own)
        assert groups.setdefault(own, s) == s
    assert len(set(groups.values())) == len(groups)


def test_lookup():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert (Lookup(keys).find(keys) == np.arange(5000)).all() and (Lookup(keys).find(keys + np.uint64(1)) < 0).all()
    assert (Lookup(keys[:0]).find(keys[:3]) < 0).all()


def plain_lines(rows):
    """(id, lines, dropped lines, text that stays)."""
    holders, out = {}, []
    keys = lambda t: [plain.low(x.strip(plain.SPACE)) for x in (t or "").split("\n")]
    for i, t in rows:
        for key in keys(t) if i is not None else []:
            if len(key) >= 40:
                holders.setdefault(key, set()).add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys(t), strict=True) if i is None or len(holders.get(k, ())) < 5 or i == max(holders[k])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_line_dedup(spark, docs):
    clash = ["line", "_tag", "_id", "_tag2", "_lost", "_lines", "h1", "c0", "top"]
    out = line_dedup.dedup_lines(docs.withColumns({c: F.lit(c) for c in clash}).withColumn("n_lines", F.lit(-1)), batches=5, fan_in=2)
    assert out.columns == ["id", "text", *clash, "n_lines", "n_dropped"] and all(r[c] == c for r in out.collect() for c in clash)
    got = sorted(((r.id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == plain_lines(ROWS) and any(x[2] for x in got)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_runs_hold_each_key_once(spark):
    batches = [[(k % m, 0, 1, 100 * b + k) for k in range(m)] for b, m in enumerate((5, 9, 3, 12, 9, 2))]
    runs = line_dedup.Runs(spark, fan_in=2)
    for rows in batches:
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, docs long, top long"))
        held = [r.h1 for run in runs.all() for r in run.collect()]
        assert len(held) == len(set(held))
    assert len(runs.all()) < len(batches) and len(runs.again) == len(batches) - 1
    plan = runs.again[-1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = {k: (sum(1 for rows in batches for r in rows if r[0] == k), max(r[3] for rows in batches for r in rows if r[0] == k)) for k in range(12)}
    for least in (1, 3):
        assert {r.h1: (r.docs, r.top) for r in runs.repeated(least).collect()} == {k: x for k, x in want.items() if x[0] >= least}


@pytest.mark.parametrize("hot", [1, 3])
def test_lines_of_hot_keys_meet_them_by_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    lines = ["a line that stands in all of the many documents " + "x" * k for k in range(4)]
    rows = [(i, "\n".join(lines[: 1 + i % 4])) for i in range(40)] + [(None, lines[0]), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted(((r.id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == plain_lines(rows)


def profile(texts, length):
    grams = Counter()
    for t in texts:
        word, rows = "", []
        for c in (t or "") + " ":
            if c.isalpha():
                word += c.lower() if len(c.lower()) == 1 else c
            elif word:
                rows.append(word)
                word = ""
        for x in rows:
            p = [1, *map(ord, x), 1]
            grams.update(k for k in p[1:-1])
            grams.update(a << 16 | b for a, b in zip(p, p[1:]))
            grams.update(a << 32 | b << 16 | c for a, b, c in zip(p, p[1:], p[2:]))
    return {g: k for k, (g, _) in enumerate(sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:length])}


def test_language_id(spark):
    rows = [(k, t, "aa" if k % 2 else "bb") for k, t in enumerate(["abba acca", "bob bib", "aba cca ab", "Bübi ob", None, "12 !", "", "abc" * 400, "B"])]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: (r.lang_pred, r.score) for r in language_id.identify(docs.where("lang is not null"), F.col("id") < 4, length=20).collect()}
    learned = {x: profile([t for k, t, lang in rows[:4] if lang == x], 20) for x in ("aa", "bb")}
    for k, t, _ in rows:
        own = profile([t], 20)
        if not own:
            assert got[k] == ("und", 0.0)
            continue
        away = {x: sum(abs(r - p[g]) if g in p else 20 for g, r in own.items()) for x, p in learned.items()}
        best = min(sorted(away), key=away.get)
        assert got[k][0] == best and got[k][1] == pytest.approx(max(0, 1 - away[best] / (20 * len(own))))
    assert [r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()] == ["und"] * len(rows)
    assert language_id.judged(docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)}), language_id.learn(docs.where("id < 0"))).columns == ["id", "text", "lang", "lang_pred", "score"]
    assert language_id.identify(empty(spark, "id long, text string, lang string"), F.lit(True)).count() == 0


def plain_licenses(text, coverage=0.6, slack=3):
    """All template pairs against all text pairs; diagonals within slack are merged around each one."""
    w = re.findall(license_scan.WORD, plain.low(text))
    base, labels, best = [], set(), 0.0
    for label, is_base, t in license_scan.templates(license_scan.BASE, license_scan.NOTICES):
        if is_base:
            base += [(p, label) for p in range(len(w)) if w[p : p + len(t)] == t]
            continue
        hit = {}
        for p in range(len(w) - 1):
            for k in range(len(t) - 1):
                if w[p : p + 2] == t[k : k + 2]:
                    hit.setdefault(p - k, set()).add(k)
        most = max((len(set().union(*(hit.get(d + j, set()) for j in range(-slack, slack + 1)))) / (len(t) - 1) for d in hit), default=0)
        if most >= coverage:
            labels.add(label)
            best = max(best, most)
    names = {x for _, x in base}
    at = [p for p, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), 1.0 if base else best


def test_license_scan(spark):
    rng = random.Random(8)
    notices = [text for _, text in license_scan.NOTICES]
    rows = [(1, None), (2, ""), (3, "MIT License, mit license"), (4, "The GNU  General-Public License; Apache license"), (5, "x " * 3000 + "CC-BY"), (5, "x " * 3000 + "CC-BY"), (None, "mit license"), (7, "gnu general license public"), (8, "..."), (9, " a "), (10, "wor\u212a under the mit license \u0130"), (11, "of the " * 200)]
    for k, text in enumerate(notices * 3):  # words lost, added and replaced; a notice next to itself; the end of a notice alone
        w = text.split()
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(0, 2)] = ["zz"] * rng.randrange(0, 2)
        rows.append((100 + k, " ".join(w if k % 3 else w[len(w) // 2 :] + w)))
    got = sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan.license_report(spark.createDataFrame(rows, "id long, text string").withColumn("tag", F.lit(1))).collect()), key=str)
    assert got == sorted(((i, *plain_licenses(t)) for i, t in rows), key=str)
    assert len({x[6] for x in got}) > 8
    assert license_scan.license_report(empty(spark)).count() == 0
    spans = license_scan.scan(spark.createDataFrame([(1, "a b " + notices[8] + " c"), (2, "la " * 9 + "mit license")], "id long, text string")).collect()
    assert sorted((r.id, r.label, r.base, r.start, r.stop) for r in spans) == [(1, "mit", False, 2, 22), (2, "mit", True, 9, 11)]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "sale_lines"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = duck.execute(oracle_sql()[name]).df()[list(got.columns)]
    show = lambda f: sorted(tuple("null" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in f.itertuples(index=False, name=None))
    assert show(got) == show(want)


def test_token_counts(spark, docs):
    pieces = [tuple(x.encode()) for x in ("a", "ab", "abc", "abcd", "w", "w1", "w12", "1", "2", "3", "é", "é1", "cd", "d")] + [(*x.encode(), token_counts.END) for x in ("", "1", "bc", "w1", "é")]
    pieces = [p for p in pieces if p]
    own, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        s, k, n = (*word.encode(), token_counts.END), 0, 0
        while k < len(s):
            size = next((m for m in range(longest, 0, -1) if s[k : k + m] in own and k + m <= len(s)), 0)
            if not size:
                return None
            k, n = k + size, n + 1
        return n

    extra = [(2000, "abcd abcde ab1 abc"), (2001, "abcabcabcd" * 500)]
    got = sorted(tuple(r) for r in token_counts.token_counts(docs.unionByName(spark.createDataFrame(extra, docs.schema)), pieces).collect())
    want = sorted((i, len(w), sum(greedy(x) or 1 for x in w), sum(greedy(x) is None for x in w)) for i, t in [*ROWS, *extra] for w in [plain.words(t)])
    assert got == want
    assert token_counts.token_counts(empty(spark), pieces).count() == 0 and token_counts.token_counts(docs.withColumn("n_words", F.lit("x")), pieces).count() == len(ROWS)


def plain_align(item, passage):
    best = 0
    score = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item):
        for j, y in enumerate(passage):
            score[i + 1][j + 1] = max(0, score[i][j] + (2 if x == y else -1), score[i][j + 1] - 1, score[i + 1][j] - 1)
            best = max(best, score[i + 1][j + 1])
    return best / (2 * len(item))


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        assert decontaminate.align(a, b)[0] == pytest.approx(plain_align(a.tolist(), b.tolist()))


def test_decontamination(spark):
    item = " ".join(f"q{k}" for k in range(20))
    edited = item.replace("q7 ", "").replace("q13", "zz")
    noise = " ".join(f"n{k % 50}" for k in range(400))
    rows = [(1, None), (2, ""), (3, f"{noise} {item.upper()} {noise}"), (4, f"{noise} {edited} more"), (5, noise), (6, "q1 q2 q3 q4"), (3, f"{noise} {item.upper()} {noise}")]
    docs, items = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(9, item), (10, None), (11, "")], "id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.score, 3), r.first_word, r.end_word, r.n_matches) for r in decontaminate.contamination(docs, items, chance=1.0, block=1).collect()}
    assert got == {(3, 9): (1.0, 400, 420, 20), (4, 9): (round((18 * 2 - 2) / 40, 3), 400, 419, 18)}
    assert sorted(r.id for r in decontaminate.without_leaks(docs, items, chance=1.0).collect()) == [1, 2, 5, 6]
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), items, chance=1.0).count() == 0


def true_neighbours(rows, q, k=5):
    """ids and cosines of the k nearest of the rows with other ids than q's, of each id its nearest."""
    vector = {i: np.array(v, dtype=float) for i, v in rows}[q]
    best = {}
    for i, v in rows:
        v = np.array(v, dtype=float)
        if i != q and len(v) == len(vector):
            best[i] = max(best.get(i, -2), float((v * vector).sum() / np.sqrt((v * v).sum()) / np.sqrt((vector * vector).sum())))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_vectors(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(16).astype(np.float32).tolist()) for k in range(700)] + [(k, [1.0] + [0.0] * 15) for k in range(700, 1000)] + [(3, rng.standard_normal(16).astype(np.float32).tolist())]
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [math.nan] * 16), (2150, [None] * 16), (2200, [1.0, 2.0]), (None, [1.0] * 16), (2250, [])]
    table = spark.createDataFrame(rows + odd, f"id long, vector array<{kind}>").withColumn("size", F.lit("clash"))
    got = {}
    for r in nearest_vectors.nearest(table, F.col("id") % 50 == 0, cell=100, shard=60, block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    hits = 0
    for q in range(0, 1000, 50):
        want = true_neighbours(rows, q)
        found = sorted(got[q])
        cosines = dict(true_neighbours(rows, q, 10**6))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(c == pytest.approx(cosines[i], abs=1e-12) for _, i, c in found)
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        if q >= 700:
            assert [i for _, i, _ in found] == [i for i, _ in want]
    assert hits >= 0.9 * 100 and set(got) == set(range(0, 1000, 50))
    assert nearest_vectors.nearest(table.limit(0), F.lit(True)).count() == 0
    assert {r.id for r in nearest_vectors.nearest(table.where("id in (1, 2, 2200)"), F.lit(True)).collect()} == {1, 2}


@pytest.mark.parametrize("chance", [1.0, 1e-9])
def test_decontamination_against_all_alignments(spark, chance):
    """Edited copies in long and short texts: what is found, and its score, is what aligning every text with every item gives."""
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 4000}"
    items = [(k, " ".join(f"{word()}" for _ in range(rng.randrange(12, 40)))) for k in range(12)]
    rows = []
    for k in range(90):
        w = [word() for _ in range(rng.randrange(0, 60))]
        copy = items[k % 12][1].split()
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(0, 2)] = ["zz"] * rng.randrange(0, 2)
        rows.append((k, " ".join(w + (copy if k % 4 else copy[: len(copy) // 3]) + [word() for _ in range(rng.randrange(0, 60))])))
    got = decontaminate.contamination(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(items, "id long, text string"), chance=chance, block=5).collect()
    want = {}
    for i, t in rows:
        for j, item in items:
            if (score := plain_align(plain.words(item), plain.words(t))) >= 0.5:
                want[i, j] = score
    assert {(r.doc_id, r.item_id): pytest.approx(r.score) for r in got} == want and len(want) > 60


def test_nearest_vectors_where_the_test_excludes_most_cells(spark):
    """Clustered vectors: recall stays, and queries meet few of the cells."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32)) * 3
    m = (centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 32)) * 0.3).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, vector array<float>")
    met, seen = nearest_vectors.met, []

    def counting(index, asked, *rest):
        seen.append(asked.count())
        return met(index, asked, *rest)

    nearest_vectors.met = counting
    try:
        found = nearest_vectors.nearest(table, F.col("id") % 50 == 0, cell=128).collect()
    finally:
        nearest_vectors.met = met
    unit = m.astype(float) / np.sqrt((m.astype(float) ** 2).sum(axis=1))[:, None]
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & {r.id for r in found if r.query_id == q})
    assert hits >= 0.9 * 600 and sum(seen) < 0.5 * 120 * 64


def test_language_model_against_plain_counts_and_steps(spark, docs):
    held = docs.withColumn("held", F.col("id") % 7 == 2)
    got = language_model.scored(held, ~F.col("held"), frequent=40, vocabulary=30, sample=20, width=6, epochs=1).collect()
    counts = Counter(x for i, t in ROWS if i % 7 != 2 for x in [*plain.words(t), None])
    n, v = sum(counts.values()), len(counts)
    base = {i: (len(plain.words(t)) + 1, sum(x in counts for x in [*plain.words(t), None]), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*plain.words(t), None])) for i, t in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*base[r.id][:2], n)
        assert r.base_score == pytest.approx(base[r.id][2], abs=1e-6) and r.score < 0
    network = language_model.Network(np.arange(12, 0, -1).astype(float), 5, 3)
    text = np.random.default_rng(1).integers(0, 12, 70)
    h, last, total = np.zeros((1, 5), np.float32), language_model.END, 0.0
    for word in text:
        h = network.cell((network.p["emb"][[last]] @ network.p["wx"] + network.p["b"]).T, h.T)[0].T
        total += float(network.log_likelihood(h, np.array([word]))[0])
        last = word
    assert network.score(np.concatenate([text, text[:3]]), np.array([0, 70, 73]))[0] == pytest.approx(total, rel=1e-4)
    every = network.log_likelihood(np.repeat(h, 12, axis=0), np.arange(12))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)


def test_language_model_learns_from_texts_beyond_the_sample(spark):
    held, pair = (10_000, "red blue " * 40), (["red blue " * 40], ["red " * 40 + "blue " * 40])
    got = []
    for text in pair:  # the same counts in another order
        docs = spark.createDataFrame([(k, text[0]) for k in range(200)] + [held], "id long, text string").withColumn("held", F.col("id") == 10_000)
        got.append(language_model.scored(docs, ~F.col("held"), sample=0, width=6, rate=0.05).where("held").head().score)
    assert got[0] > got[1] + 1
    rows = [(None, None), (1, ""), (1, "")]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("held", F.lit(False))
    assert len(language_model.scored(docs, F.lit(True)).collect()) == len(language_model.scored(docs, F.lit(False)).collect()) == 3


@pytest.mark.parametrize("n", [0, 1, 7, 40, 90, 200])
def test_most_frequent(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(-(2**63), 2**63), c) for c in [5000, 5001, 9000, 5000] + [rng.choice([1, 1, 1, 2, 2, 3, 50]) for _ in range(100)]]
    got = [tuple(r) for r in language_model.most_frequent(spark.createDataFrame(rows, "h long, c long"), n).collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], "id long, text string, held boolean")
    assert language_model.scored(docs, F.lit(True)).count() == 0


def test_log_sum_exp():
    x = np.array([[0.0, 1.0], [-500.0, -501.0], [300.0, 1.0]])
    assert language_model.log_sum_exp(x) == pytest.approx(np.logaddexp.reduce(x, axis=1))


def test_many_texts_are_scored_in_groups_of_a_length(monkeypatch):
    network = language_model.Network(np.arange(12, 0, -1).astype(float), 5, 3)
    bounds = np.append(0, np.cumsum(np.random.default_rng(2).integers(0, 60, 50)))
    ids = np.random.default_rng(3).integers(0, 12, bounds[-1])
    want = network.score(ids, bounds)
    monkeypatch.setattr(language_model, "TEXTS", 7)
    assert network.score(ids, bounds) == pytest.approx(want, rel=1e-5)


def test_gradients_where_exponentials_need_a_shift():
    network = language_model.Network(np.arange(2304, 0, -1).astype(float), 16, 3)
    rng = np.random.default_rng(5)
    inputs, target = rng.integers(0, 2304, (16, 256)), rng.integers(0, 2304, (16, 256))
    run = lambda: network.window(inputs, target, np.zeros((16, 256), bool), np.ones((16, 256), bool), np.zeros((256, 16), np.float32))
    usual = run()[0]
    network.p["bc"] += np.float32(300)
    for k, g in run()[0].items():
        assert g == pytest.approx(usual[k], abs=2e-4), k


def test_gradients():
    network = language_model.Network(np.arange(9, 0, -1).astype(float), 4, 5)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(0)
    inputs, target = rng.integers(0, 9, (5, 3)), rng.integers(0, 9, (5, 3))
    fresh, live = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    fresh[2, 1], live[4, 2] = True, False
    grads, _ = network.window(inputs, target, fresh, live, np.zeros((3, 4)))

    def loss():
        h, states = np.zeros((3, 4)), []
        for t in range(5):
            h = network.cell((network.p["emb"][inputs[t]] @ network.p["wx"] + network.p["b"]).T, (h * ~fresh[t][:, None]).T)[0].T
            states.append(h)
        return -(network.log_likelihood(np.concatenate(states), target.ravel()) * live.ravel()).sum() / live.sum()

    for k, p in network.p.items():
        at = np.unravel_index(int(np.abs(grads[k]).argmax()), p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3), k


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    doc, feature, tf = toxicity.counted(rng.integers(0, 300, 1500), rng.integers(0, 40, 1500))
    labels = np.zeros(300)
    model = toxicity.Model(Lookup(np.arange(40, dtype=np.uint64)), np.linspace(1, 3, 40), labels, list(range(300)), 0.1)
    model.index(doc, feature, tf)
    dense = np.zeros((300, 40))
    dense[doc, feature] = model.weights(doc, feature, tf, 300)
    for i in range(0, 300, 7):
        own = np.flatnonzero(dense[i])
        if len(own):
            best, cosine = model.nearest(own, dense[i, own], 9)
            assert cosine == pytest.approx(np.sort(dense @ dense[i])[::-1][: len(best)])


def test_toxicity(spark):
    rows = [(k, " ".join(f"r{(k * 31 + j * 7) % 991}" for j in range(9)) + (" awful" if k % 3 == 0 else " fine")) for k in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(100)] + [(5, None)], "id long, toxic int")
    got = {r.id: r.score for r in toxicity.scored(docs, toxicity.learn(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(150)) and got[900] == got[901] < 0.5
    assert {r.score for r in toxicity.scored(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0
    assert {r.score for r in toxicity.scored(docs, toxicity.learn(docs.limit(0), labels)).collect()} == {34 / 100}


@pytest.mark.parametrize("level", [0.0, 4.0])
def test_toxicity_against_all_examples(spark, level):
    """Every score from the cosines with all examples, by plain counts of words without marks at their ends."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    text = lambda bad: " ".join(rng.choice(words) + rng.choice(["", "", ",", "!!"]) for _ in range(rng.randrange(3, 30))) + (" (Awful) -vile-" if bad and rng.random() < 0.9 else "")
    rows = [(k, text(k % 3 == 0)) for k in range(120)] + [(500, None), (501, ""), (502, "... !!"), (503, "zz"), (3, "a second text of an id"), (None, "vile")]
    docs, labels = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (4, None)], "id long, toxic int")
    model = toxicity.learn(docs, labels, levels=(level,))
    split = lambda t: Counter(x for x in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in plain.words(t)) if x)
    df = Counter(x for _, t in rows for x in set(split(t)))
    texts = {i: min(t for j, t in rows if j == i) for i in range(90)}
    hashes = {x: toxicity.features_of(next(chunks(pa.array([x])))[2])[1][0] for x in df}
    known = {x for x, h in hashes.items() if model.lookup.find(np.array([h]))[0] >= 0}
    assert {"awful", "vile"} <= known and (level or known == {x for i in texts for x in split(texts[i])})

    def vector(t):
        v = {x: (1 + math.log(n)) * (math.log((len(rows) + 1) / (df[x] + 1)) + 1e-6) for x, n in split(t).items() if x in known}
        return {x: y / math.sqrt(sum(z * z for z in v.values())) for x, y in v.items()}

    index = {i: v for i in texts if (v := vector(texts[i]))}
    assert sorted(model.ids) == sorted(index)
    want = []
    for i, t in rows:
        v = vector(t)
        near = sorted(((round(sum(y * u.get(x, 0) for x, y in v.items()), 12), -j) for j, u in index.items()), reverse=True)[: toxicity.K]
        near = [(c, -j) for c, j in near if c > 0]
        pull = [(c / (1.05 - min(c, 1)), j) for c, j in near]
        score = model.calibrated(sum(p for p, j in pull if j % 3 == 0) / sum(p for p, _ in pull)) if near else model.nothing
        want.append((str(i), float(score)))
    got = [(str(r.id), r.score) for r in toxicity.scored(docs, model).collect()]
    close = sum(abs(a[1] - b[1]) < 1e-9 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert len(got) == len(rows) and close == len(rows)


def test_budgets_pour_over_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.budgets(leaves, 120, 1, lambda p: 1.0) == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 60}
    assert mixing.budgets(leaves, 400, 1, lambda p: 1.0) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.budgets(leaves, 170, 1, lambda p: 3.0 if p == ("a",) else 1.0) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 60}
    assert mixing.poured(Fraction(5), {"a": (Fraction(0), Fraction(9)), "b": (Fraction(1), Fraction(2))}) == {"a": 3, "b": 2}


def test_mixing_takes_the_longest_prefix(spark, docs):
    rows = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.concat(F.lit("s"), F.col("id") % 3)})
    mixing.ROWS, before = 7, mixing.ROWS
    try:
        out = mixing.mix(rows, ["lang", "source"], lambda p: 1.0, share=1.3, max_epochs=2).collect()
    finally:
        mixing.ROWS = before
    units = {}
    for i, t in ROWS:
        units[i, t] = units.get((i, t), 0) + len(plain.words(t))
    leaves = {}
    for (i, _), n in units.items():
        leaves[None, f"s{i % 3}"] = leaves.get((None, f"s{i % 3}"), 0) + n
    budget = mixing.budgets(leaves, int(sum(leaves.values()) * Fraction(13, 10)), 2, lambda p: 1.0)
    taken = {}
    for r in out:
        taken[r.id, r.text] = (r.copies, r.n_tokens)
    order = {}
    tagged = rows.select("id", "text", "source", F.xxhash64("text").alias("tag")).distinct()
    for epochs in {most // leaves[leaf] for leaf, most in budget.items()}:
        for r in tagged.withColumn("u", F.xxhash64(F.lit(17), F.lit(epochs).cast("long"), "id", "tag")).collect():
            order.setdefault((epochs, r.source), []).append((r.u, r.id, r.text))
    want = {}
    for leaf, most in budget.items():  # whole epochs, then the longest prefix of the next one
        epochs, rest = divmod(most, leaves[leaf])
        whole = True
        for _, i, t in sorted(order[epochs, leaf[1]], key=lambda x: x[0]):
            rest -= units[i, t]
            whole = whole and rest >= 0
            if epochs + whole:
                want[i, t] = (epochs + whole, units[i, t])
    assert taken == want
    for leaf, most in budget.items():
        used = sum(c * n for (i, _), (c, n) in taken.items() if f"s{i % 3}" == leaf[1])
        left = [n for (i, t), n in units.items() if f"s{i % 3}" == leaf[1] and taken.get((i, t), (0,))[0] < 1 + most // leaves[leaf]]
        assert used <= most and (not left or used + max(left) > most or min(left) <= most - used)
    assert mixing.mix(rows.limit(0), ["lang", "source"], lambda p: 1.0).count() == 0
    clash = ["n_tokens", "copies", "_id", "_t", "_l0", "_bucket", "c0"]
    out = mixing.mix(rows.withColumns({c: F.lit("mine") for c in clash}), ["lang", "source"], lambda p: 1.0)
    assert out.columns == ["id", "text", "lang", "source", *clash[2:], "n_tokens", "copies"] and all(r[c] == "mine" for r in out.collect() for c in clash[2:])


@pytest.mark.parametrize("name", ["op2_language_id", "op4_toxicity", "op8_token_counts"])
def test_queries_answer_for_every_document(spark, sf, name):
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_against_plain_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).withColumn("extra", F.lit(1))
    kept = P.keep_known_languages(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    cut = P.drop_repeated_lines(spark, kept, sf).collect()
    assert sorted(r.doc_id for r in cut) == sorted(r.doc_id for r in docs.collect())
    cut = spark.createDataFrame(cut, docs.schema)
    one = sorted(r.doc_id for r in P.keep_one_of_each_group(spark, cut, sf).collect())
    assert one == sorted({c for _, _, c in plain.jaccard([(r.doc_id, r.text) for r in cut.collect()])})
    items = [" ".join(plain.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in P.drop_benchmark_copies(spark, cut, sf).collect()}
    assert clean == {r.doc_id for r in cut.collect() if not any(x in " ".join(plain.words(r.text)) for x in items)}
    mixed = P.mix_to_weights(spark, cut, sf)
    assert mixed.columns == [*docs.columns, "n_tokens", "copies"] and mixed.where("copies < 1").count() == 0


def test_pipeline_stages_of_nothing(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_pipeline_cleans_up_behind_itself(spark, sf):
    import os

    import corpus_pipeline as P
    from chatloom.llm import store

    before = list(store.MADE)
    rows = P.run(spark, sf).count()
    made = [p for p in store.MADE if p not in before]
    assert rows and all(os.path.exists(p) for p in made) and sum("stage_" in p for p in made) == 1


def test_pipeline_drops_texts_unlike_every_learned_language(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    letters = np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), (40, 7))
    unlike = [finnish, "xkq zvv qqq wxz " * 20, " ".join("".join(w) for w in letters), "zxqkvj"]
    rows = [(-k - 1, t, None, "s", len(t)) for k, t in enumerate([*unlike, "Avec."])]
    out = P.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), "")
    ids = {r.doc_id for r in out.collect()}
    assert {i for i in ids if i < 0} == {-5}
    assert ids >= {r.doc_id for r in docs.collect()}


def test_pipeline_keeps_documents_without_an_id(spark):
    import corpus_pipeline as P

    same, own = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(7, same), (None, same), (None, own), (3, same), (None, None), (None, own)]
    out = P.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, same), (None, same), (None, own), (None, None), (None, own)], key=str)


CLASH = ["id", "domain", "n_tokens", "copies", "lang_pred", "score", "line", "h", "c0", "component_id", "_tag", "item_id", "rank"]


def test_pipeline_stages_with_clashing_columns(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0")
    more = docs.select([F.lit(f"own {c}").alias(c) for c in CLASH[:4]] + docs.columns + [F.lit(f"own {c}").alias(c) for c in CLASH[4:]])
    plain_, rows = docs, more
    for name, stage in P.STAGES:
        plain_, rows = stage(spark, plain_, sf), stage(spark, rows, sf)
        replaced = ["n_tokens", "copies"] if stage is P.mix_to_weights else []
        assert rows.columns == [*[c for c in more.columns if c not in replaced], *replaced], name
        assert all(r[c] == f"own {c}" for r in rows.collect() for c in CLASH if c not in replaced)
        assert sorted(map(tuple, rows.select(plain_.columns).collect()), key=repr) == sorted(map(tuple, plain_.collect()), key=repr)
        plain_, rows = (spark.createDataFrame(x.collect(), x.schema) for x in (plain_, rows))


def test_contamination_keeps_documents_without_an_id_apart(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "other words that stand nowhere else at all in here")], "id long, text string")
    rows = [(None, "before " + " ".join(words)), (None, " ".join(words)), (None, " ".join(words)), (5, " ".join(words[:30])), (5, " ".join(words)), (None, None), (6, "clean")]
    clash = {c: F.lit(c) for c in ("item_id", "score", "c0", "best")}
    docs = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.score, r.first_word) for r in decontaminate.contamination(docs.withColumns(clash), items.withColumns(clash)).collect())
    assert got == [(0, 1, 1.0, 0), (0, 1, 1.0, 0), (0, 1, 1.0, 1), (5, 1, 1.0, 0)]
    left = decontaminate.without_leaks(docs.withColumns(clash), items)
    assert left.columns == ["id", "text", *clash] and sorted((r.id or 0, r.text, r.score) for r in left.collect() if r.text) == [(6, "clean", "score")] and left.count() == 2
    long = spark.createDataFrame([(1, "pad " * 60_000 + " ".join(words) + " pad" * 60_000)], "id long, text string")
    assert [(r.doc_id, r.first_word) for r in decontaminate.contamination(long, items).collect()] == [(1, 60_000)]


TONGUES = ("red blue green grey", "rouge bleu vert gris")


def two_tongues(n: int) -> list[tuple[int | None, str]]:
    """Texts of one tongue each: four common words, and between them rare ones that tell the tongue by their company alone."""
    rng = random.Random(5)
    common = [x.split() for x in TONGUES]
    return [(k, " ".join(w for _ in range(40) for w in (rng.choice(common[k % 2]), f"{'xy'[k % 2]}{rng.randrange(60)}"))) for k in range(n)]


def test_word_groups_follow_company(spark):
    docs = spark.createDataFrame(two_tongues(120), "id long, text string")
    counts = language_model.count_words(docs).toPandas().sort_values(["c", "h"], ascending=[False, True])
    lookup = language_model.Lookup(counts.h.to_numpy().view(np.uint64))
    rows = language_model.numbers(docs, lookup)
    group = language_model.word_groups(rows, counts.c.to_numpy(), 8, 2)
    again = language_model.word_groups(rows.repartition(5), counts.c.to_numpy(), 8, 2)
    assert len(group) == 120 and (group == again).all()
    of = {}
    for _, w in two_tongues(120):
        for x in w.split():
            of[x] = x[0] == "x"
    hashes = {x: h for x, h in zip(of, plain_hashes(list(of)), strict=True)}
    place = {h: i for i, h in enumerate(counts.h)}
    side = {(of[x], int(group[place[h] - 8])) for x, h in hashes.items() if x[0] in "xy" and x[1:].isdigit()}
    assert len(side) == 2  # each tongue's words have a group of their own


def plain_hashes(words: list[str]) -> list[int]:
    return [int(next(language_model.chunks(pa.array([w])))[2].hashes().view(np.int64)[0]) for w in words]


def test_contexts_against_plain_pairs(spark):
    rng = random.Random(2)
    texts = [[rng.randrange(-1, 9) for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(40)]
    numbers = [(None if k % 3 else k, np.array([*t, -2], np.int32).tobytes()) for k, t in enumerate(texts)]
    ids = np.frombuffer(b"".join(x for _, x in numbers), np.int32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in numbers], pa.int64()), language_model.binaries(ids, bounds)], names=["id", "numbers"])
    for size in (1, 7, 1 << 17):  # pieces hold each place once and reach over their ends
        own = [p[s] for p, s in language_model.pieces(iter([batch]), size)]
        assert (np.concatenate(own) == ids).all()
    rows = spark.createDataFrame(numbers, "id long, numbers binary")
    k = 4
    table = np.zeros((k, k))
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + language_model.REACH]:
                if 0 <= a < k and 0 <= b < k:
                    table[a, b] += 1
                    table[b, a] += 1
    mass = table.sum(axis=1) + 1
    share = np.sqrt(mass / mass.sum())
    values, axes = np.linalg.eigh(table / mass.sum() / np.outer(share, share) - np.outer(share, share))
    want = np.sort(np.abs(np.rint(axes / share[:, None] * np.abs(values) * language_model.UNITS)), axis=1)
    got = language_model.coordinates(rows, k)
    assert (got[:, language_model.AXES] == 1).all()
    assert np.abs(np.sort(np.abs(got[:, :k]), axis=1) - want).max() <= 1


def test_scores_of_groups_are_probabilities(spark):
    rows = [*two_tongues(40), (None, "red x1"), (None, "red x1"), (77, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    model, counts = language_model.learn(docs, F.lit(True), vocabulary=6, groups=5, frequent=60, sample=5, width=4, part=1 << 9)
    c, n = np.array([r.c for r in counts.collect()]), model.counts
    h = np.zeros((1, 4), np.float32)
    symbol = np.exp(model.network.log_likelihood(np.repeat(h, len(model.network.of), axis=0), np.arange(len(model.network.of))))
    share = (n + 1.0) / 10 ** model.mass[model.symbol]
    words = (symbol[model.symbol] * share).sum()
    beyond = (c.sum() - n.sum() + len(c) - len(n) + 1) / 10 ** model.mass[language_model.OTHER]
    assert beyond == pytest.approx(1)  # words beyond the frequent ones, and one that was never seen
    assert words + symbol[[language_model.END, language_model.OTHER]].sum() == pytest.approx(1, abs=1e-4)
    assert len(model.symbol) == 60 and model.symbol[:4].tolist() == [2, 3, 4, 5] and set(model.symbol[4:].tolist()) == set(range(6, 11))


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_halved(groups):
    place = np.array([[0.0], [0.0], [1.0], [5.0], [5.0], [9.0]])
    got = language_model.halved(place, np.ones(6), groups)
    assert len(set(got.tolist())) <= groups and got.min() == 0
    assert len(set(language_model.halved(np.zeros((5, 2)), np.ones(5), 4).tolist())) == 1


def test_languages_are_learned_from_every_text(spark):
    """Profiles and bounds see each labelled text, however many a language has: 2,500 of one kind and 2,500 of another, told apart by ids."""
    from chatloom.llm import language_id

    rows = spark.range(5000).selectExpr("id", "if(id % 2 = 0, 'abc abd', 'xyz xyw') as text", "'one' as lang")
    got = language_id.learn(rows)
    grams = rows.selectExpr("id", "text", "lang").where("id < 2")
    assert set(got.grams.tolist()) == set(language_id.learn(grams).grams.tolist())
    rare = spark.createDataFrame([(9999, "qqq", "one")], "id long, text string, lang string")
    assert set(language_id.learn(rare).grams.tolist()) <= set(language_id.learn(rows.unionAll(rare)).grams.tolist())
    seen = []
    plain = language_id.judged

    def counted(docs, profiles, text="text"):
        seen.append(docs.count())
        return plain(docs, profiles, text)

    language_id.judged = counted
    try:
        bound = language_id.least_scores(rows, got)
    finally:
        language_id.judged = plain
    scores = sorted(r.score for r in plain(rows, got).collect())
    found = rows.select(bound(rows.text)).head()[0]
    assert seen == [5000] and 0.7 * (scores[49] - 1 / language_id.STEPS) <= found <= 0.7 * scores[50]
