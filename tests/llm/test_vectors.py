"""Top-k search, change points and vector codes against plain versions: nulls, ties, repeats, wide numbers, empty tables, clashing columns."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import change_points, queries, topk_search, vector_codes

LOW, TOP = -(1 << 63), (1 << 63) - 1
VECTORS = "id long, vector array<long>, label int"


def vectors(size, n=700, spread=40, seed=3):
    """(id, vector, label): many equal vectors, repeated rows, ids with two vectors, nulls, other sizes."""
    rng = random.Random(seed)
    hot = [rng.randrange(-spread, spread) for _ in range(size)]
    rows = [(k, list(hot) if k % 3 == 0 else [rng.randrange(-spread, spread) for _ in range(size)], k % 4 if k % 5 else None) for k in range(n)]
    rows += [rows[7 % n], rows[9 % n], (7, [spread] * size, 1), (10, [-spread] * size, 1), (None, [1] * size, 2), (n, None, 2), (n + 1, [None] * size, 2), (n + 2, [1, 2, 3], 2), (n + 3, [], 2), (50, [2, 3, 4], 2), (100, [], None)]
    return rows


def plain_top(rows, asks, k):
    """By query id: the k best (score, id) of all its vectors, one a candidate id."""
    own = [(i, v) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    out = {}
    for q, a in own:
        if asks(q):
            for i, b in own:
                if i != q and len(a) == len(b):
                    score = max(LOW, min(TOP, sum(x * y for x, y in zip(a, b, strict=True))))
                    found = out.setdefault(q, {})
                    found[i] = max(score, found.get(i, LOW))
    return sorted((q, rank, i, s) for q, found in out.items() for rank, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k], 1))


@pytest.mark.parametrize(("size", "spread"), [(4, 6), (16, 40), (6, 1 << 40)])
def test_top_k(spark, size, spread):
    rows = vectors(size, spread=spread)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{VECTORS}, score string, query_id int").repartition(3)
    got = topk_search.top_k(df, F.col("id") % 50 == 0, k=4, shard=64, sample=256, slice_rows=50, block=7)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 50 == 0, 4)


@pytest.mark.parametrize(("spread", "repeats"), [(3, 1), (40, 3), (1 << 35, 2)])
def test_searched_tree_equals_all_products(monkeypatch, spread, repeats):
    monkeypatch.setattr(topk_search, "LEAF", 8)
    rng = np.random.default_rng(spread)
    x, ids = rng.integers(-spread, spread, (500, 5)), np.arange(500) // repeats
    q, q_ids, floors = x[::25], ids[::25], np.where(np.arange(20) % 2, LOW, min(TOP, spread * spread))
    at, name, score = topk_search.searched(ids, x, q_ids, q, floors, 6)
    got = {}
    for a, i, s in zip(at.tolist(), name.tolist(), score.tolist(), strict=True):
        got.setdefault(a, []).append((-s, i))
    for k in range(20):
        best = {}
        for i, v in zip(ids.tolist(), x.tolist(), strict=True):
            s = max(LOW, min(TOP, sum(a * b for a, b in zip(q[k].tolist(), v, strict=True))))
            if i != q_ids[k] and s >= floors[k]:
                best[i] = max(s, best.get(i, LOW))
        assert sorted(got.get(k, [])) == sorted((-s, i) for i, s in best.items())[:6]


def test_top_k_skips_shards_that_cannot_reach_the_floor(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8))
    rows = [(k, (centres[k % 16] + rng.integers(-20, 20, 8)).tolist(), 0) for k in range(3200)]
    index = spark.createDataFrame(rows, VECTORS)
    made, real = [], topk_search.routed
    topk_search.routed = lambda *a: made.append(real(*a)) or made[-1]
    try:
        got = sorted(map(tuple, topk_search.top_k(index, F.col("id") % 50 == 0, k=3, shard=100).collect()))
    finally:
        topk_search.routed = real
    assert got == plain_top(rows, lambda i: i % 50 == 0, 3)
    assert sum(df.count() for df in made) < 64 * 8  # of 64 queries and 32 shards


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk_search.top_k(none, F.col("id") % 50 == 0).collect() == []
    assert topk_search.top_k(spark.createDataFrame([(50, [1, 2], 0)], VECTORS), F.col("id") % 50 == 0).collect() == []


def plain_cut(x, least, penalty):
    """All cuts, one by one: the best by cost, number of segments, and starts from the last segment backwards."""
    n = len(x)

    def cuts(end):
        yield [(0, end)]
        for start in range(least, end - least + 1):
            for before in cuts(start):
                yield [*before, (start, end)]

    def part(a, b):
        s, q = sum(x[a:b]), sum(y * y for y in x[a:b])
        v = 1 + ((b - a) * q - s * s) // ((b - a) ** 2)
        return b - a, s, v, (b - a) * math.floor(1000 * math.log(v))

    found = cuts(n) if n >= 2 * least else [[(0, n)]]
    key = lambda cut: (sum(part(*p)[3] for p in cut) + penalty * (len(cut) - 1), len(cut), [a for a, _ in reversed(cut)])
    best = min(found, key=key)
    return [(k, a, *part(a, b), len(best), key(best)[0]) for k, (a, b) in enumerate(best, 1)]


@pytest.mark.parametrize("scale", [1, 3, 1 << 30])
def test_change_points_against_all_cuts(spark, scale):
    rng, rows, want = random.Random(scale), [], []
    for key in [None, *range(40)]:
        days = rng.choice([1, 2, 3, 5, 9, 12, 14])
        level = [rng.choice([0, 0, 1, 9]) for _ in range(3)]
        x = [scale * max(0, level[d * 3 // days] + rng.choice([0, 0, 0, 1])) if key != 3 else 0 for d in range(days)]
        first, last = 19_000 + rng.randrange(99), days - 1
        for d, y in enumerate(x):
            if y or d in (0, last):
                half = y // 2
                rows += [(key, datetime(1970, 1, 1) + timedelta(days=first + d, hours=rng.randrange(24)), v, -1) for v in (half, y - half)]
        want += [(key, k, first + a, n, s, min(v, TOP), c, many, best) for k, a, n, s, v, c, many, best in plain_cut(x, 3, 2000)]
    rows += [(5, None, 7, -1), (5, datetime(2030, 1, 1), None, -1), (77, None, None, -1)]
    df = spark.createDataFrame(rows, "key long, at timestamp_ntz, value long, total int").repartition(3)
    got = [tuple(r) for r in change_points.segments(df, least=3, penalty=2000).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[7] > 1 for r in got)


def test_change_points_of_equal_cuts():
    """Equal costs: fewest segments first, then the earliest start of the last segment."""
    x = np.array([[0, 0, 0, 0, 0, 0, 5, 5, 5, 5, 5, 5, 0, 0, 0, 0, 0, 0]], float).T
    for penalty in (0, 1, 700):
        for kind in (float, object):
            got = change_points.cut(x.astype(int).astype(kind), np.array([len(x)]), 3, penalty)
            assert list(zip(*got[1:], strict=True)) == plain_cut([int(y) for y in x[:, 0]], 3, penalty)


def test_change_points_of_nothing(spark):
    assert change_points.segments(spark.createDataFrame([], "key long, at timestamp_ntz, value int")).collect() == []


def plain_codes(rows, parts, entries, rounds):
    own = [(i, v) for i, v, *_ in rows if v is not None and None not in v]
    sizes = {}
    for _, v in own:
        if v and len(v) % parts == 0:
            sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = min(sizes, key=lambda s: (-sizes[s], s))
    own, w = [(i, v) for i, v in own if len(v) == size], size // parts
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w : p * w + w] for _, v in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for _, v in own:
                held.setdefault(near(p, v)[1], []).append(v[p * w : p * w + w])
            new.append([[sum(c) // len(c) for c in zip(*held[e], strict=True)] if e in held else book for e, book in enumerate(books[p])])
        books = new
    coded = lambda v: [near(p, v) for p in range(parts)]
    fits = lambda v: v is not None and None not in v and len(v) == size
    return [(i, [e for _, e in coded(v)], min(TOP, sum(d for d, _ in coded(v)))) if fits(v) else (i, None, None) for i, v, *_ in rows], books


@pytest.mark.parametrize(("spread", "n"), [(3, 300), (40, 300), (1 << 33, 120), (40, 5)])
def test_vector_codes(spark, spread, n):
    rows = vectors(8, n=n, spread=spread)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{VECTORS}, code string, c0 string").repartition(3)
    books = vector_codes.learn(df, parts=4, entries=20, rounds=2)
    out = vector_codes.encoded(df, books)
    assert out.columns == ["id", "vector", "label", "c0", "code", "error"] and {r.c0 for r in out.collect()} == {"y"}
    want, plain = plain_codes(rows, 4, 20, 2)
    assert [b.tolist() for b in books.books] == plain
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in plain for c in b for x in c).encode()).hexdigest()
    assert sorted(((r.id, r.code, r.error) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_nearest_entries_keep_the_lowest_of_equals():
    rng = np.random.default_rng(5)
    for _ in range(50):
        entries, points = rng.integers(-3, 3, (64, 4)), rng.integers(-4, 4, (300, 4))
        for kind in (np.int64, object):
            index, far = vector_codes.Tree(entries.astype(kind)).nearest(points.astype(kind))
            all_ = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (index == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    books = vector_codes.learn(none)
    assert books.numbers() == [] and vector_codes.encoded(none, books).collect() == []
    odd = spark.createDataFrame([(1, [1, 2, 3], 0), (2, None, 0)], VECTORS)
    assert [(r.id, r.code, r.error) for r in vector_codes.encoded(odd, vector_codes.learn(odd)).collect()] == [(1, None, None), (2, None, None)]


@pytest.mark.parametrize("most", [1, 100])
def test_totals_by_label(spark, most):
    rows = [(k, k % 3 if k % 4 else None, k) for k in range(60)]
    want = {}
    for _, label, error in rows:
        want[label] = want.get(label, 0) + error
    got = queries.with_total(spark.createDataFrame(rows, "id long, label int, error long"), "label", "error", "all", most=most).collect()
    assert sorted(((r.id, r["all"]) for r in got)) == [(i, want[label]) for i, label, _ in rows]
