import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from chatloom.llm import jaccard_join as J
from chatloom.llm.components import components
from tests.llm import plain


def got(spark, rows, **options):
    out = J.jaccard_components(spark.createDataFrame(rows, "id long, text string"), **options)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in out.collect()), key=lambda x: (x[0] is None, x))


def test_against_all_pairs(spark):
    rows = plain.texts()
    assert got(spark, rows) == plain.jaccard(rows)


def test_groups_that_are_cut_in_blocks(spark):
    rows = plain.texts(seed=9, n=120)
    assert got(spark, rows, block_grams=500, block_entries=150) == plain.jaccard(rows)


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_links_across_blocks_by_rare_and_by_frequent_ngrams(spark, monkeypatch, rare):
    monkeypatch.setattr(J, "RARE", rare)
    rng = random.Random(rare)
    core = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(core[: rng.randrange(40, 60)] + [f"n{rng.random()}" for _ in range(rng.randrange(0, 25))])) for k in range(90)]
    assert len({c for _, _, c in plain.jaccard(rows)}) > 1
    assert got(spark, rows, block_entries=200) == plain.jaccard(rows)


def test_a_chain_whose_ends_are_not_linked(spark):
    rng = random.Random(3)
    base = [f"a{k}" for k in range(40)]
    rows = []
    for k in range(60):
        base = [*base[2:], f"n{rng.random()}", f"m{rng.random()}"]
        rows.append((1000 - k, " ".join(base)))
    assert got(spark, rows, block_entries=200) == plain.jaccard(rows)


@pytest.mark.parametrize("rounds_alone", [False, True])
def test_hot_ngrams_and_blocks_whose_rows_name_few_classes(spark, monkeypatch, rounds_alone):
    monkeypatch.setattr(J, "HOT_LEAST", 8)
    monkeypatch.setattr(J, "HOT", 1000)
    if rounds_alone:
        monkeypatch.setattr(J, "components", lambda edges: components(edges, 0))
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join(passage + [f"n{rng.randrange(40)}" for _ in range(rng.randrange(0, 25))])) for k in range(150)] + [(None, "a b c"), (None, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = J.sets(docs.coalesce(1), 5)
    assert len(J.hot_grams(found, 5000)) == 26
    named = rows[:-2]
    assert got(spark, named, block_grams=200, block_entries=300) == plain.jaccard(named)
    assert len(got(spark, rows[-2:])) == 2


def test_a_row_of_the_matrix_names_the_classes_of_its_entries_alone(spark):
    rows = [(f"w{k} x{k} y{k} z{k} v{k} u{k}",) for k in range(400)]
    for hot in (np.zeros(0, np.uint64), J.shingle_sets(next(J.chunks(pa.array([rows[7][0]])))[2], 5)[0]):
        parts = J.incidence(spark.createDataFrame(rows, "text string").coalesce(1), 5, 50, hot).collect()
        assert sum(r["n"] for r in parts) == 800 and all(len(J.unsqueezed(r["grams"], r["n"])) == r["n"] for r in parts)
        for r in parts:
            at = np.frombuffer(r["at"], np.uint16)
            assert set(at.tolist()) == set(range(len(r["classes"]) // 8))


@pytest.mark.parametrize("grams", [[5], [0, 2**64 - 1], [3, 3, 3], [1, 2**48, 2**49 - 1], [7, 2**48 + 7], list(range(0, 2**47, 2**37))])
def test_squeezed_ngrams(grams):
    grams = np.array(grams, dtype=np.uint64)
    assert J.unsqueezed(J.squeezed(grams), len(grams)).tolist() == grams.tolist()


def test_no_rows(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_product_roots(seed):
    rng = np.random.default_rng(seed)
    core = np.arange(30, dtype=np.uint64)
    grams = [np.unique(np.concatenate([rng.choice(core, 27, replace=False), rng.integers(100, 10**6, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(80)]
    size = np.array([len(g) for g in grams])
    roots = J.product_roots(size, grams, 75, 100)
    want = np.arange(80)
    for _ in range(80):
        for a in range(80):
            for b in range(80):
                if J.linked(np.array(len(np.intersect1d(grams[a], grams[b]))), size[a], size[b], 75, 100):
                    want[a] = want[b] = min(want[a], want[b])
    assert [roots.tolist().index(r) for r in roots] == [want.tolist().index(r) for r in want]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({out[k] for k in range(301)}) == 1 and len({out[1000 + k] for k in range(200)}) == 1 and len(set(out.values())) == 2


class Caught:
    """Stands for a table and keeps the function that would run over it."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_memory_of_a_task_by_its_entries(monkeypatch):
    """Bytes at most that tasks of the incidence matrix and of its blocks hold for an entry."""
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(map(str, rng.integers(0, 50_000, 1000))) for _ in range(500)])
    monkeypatch.setattr(J, "EMIT", 400_000)
    table = Caught()
    J.incidence(table, 5, 2, np.zeros(0, np.uint64))
    peaks = []
    tracemalloc.start()
    rows = pa.Table.from_batches(table.run(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    peaks.append(tracemalloc.get_traced_memory()[1] / sum(rows.column("n").to_pylist()))
    tracemalloc.reset_peak()
    own = rows.filter(pa.compute.equal(rows.column("block"), 0))
    before = tracemalloc.get_traced_memory()[0]
    J.shared(0, own, 2)
    peaks.append((tracemalloc.get_traced_memory()[1] - before) / sum(own.column("n").to_pylist()))
    tracemalloc.stop()
    assert peaks[0] < 110
    assert peaks[1] < 40


def test_what_a_task_freed_goes_back_and_functions_stay_as_they_are():
    from inspect import getfullargspec

    from chatloom.llm import kernel

    assert list(kernel.lean(lambda x: iter(x))([1, 2])) == [1, 2]
    assert [len(getfullargspec(kernel.lean(f)).args) for f in (lambda t: t, lambda key, t: t)] == [1, 2]

    def run(batches):
        yield from batches

    assert list(kernel.lean(run)(iter([3, 4]))) == [3, 4]


def test_texts_are_cut_in_the_same_pieces_whatever_their_width():
    from chatloom.llm import language_id

    texts = ["a" * 200_000, None, "", "\u00e9" * 62_144, "x", "b" * 300_000, "y", *["z"] * 20_000]
    got = list(language_id.pieces(pa.array(texts)))
    assert [t for _, _, part in got for t in part] == [x or "" for x in texts]
    assert [lo for lo, _, _ in got] == [0, 4, 5, 6, 6 + language_id.ROWS]


def test_parts_of_representatives_are_bounded(spark, monkeypatch):
    """Classes of one group that share n-grams but no links are all representatives; no product takes more of their entries than a block, but for chance."""
    half = lambda kind, k: " ".join(f"{kind}{k}x{n}" for n in range(12))
    texts = [f"{half('a', i)} {half('b', j)}" for i in range(24) for j in range(24)]
    seen, real = [], J.block_links

    def noted(rows, *args):
        if "mine" not in rows.columns:
            seen.append(rows.groupBy("grp", "part").agg(F.sum(F.octet_length("grams") / 8).alias("n")).agg(F.max("n")).head()[0])
        return real(rows, *args)

    monkeypatch.setattr(J, "block_links", noted)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    found = J.jaccard_components(docs, block_entries=300, num=60)
    assert found.where("id = component_id").count() == len(texts) and len(seen) == 2 and max(seen) <= 3 * 300


def test_buckets_take_a_part_of_a_block(spark):
    """A bucket of classes is several times smaller than a block, and pairs are compared few at a time, whatever the session says."""
    docs = spark.createDataFrame([(k, f"a{k // 2} b{k // 2} c d e f g h i j k l m n{k}") for k in range(200)], "id long, text string")
    before = spark.conf.get(J.AT_ONCE)
    assert J.BUCKETS > 1 and J.jaccard_components(docs, block_entries=50).count() == 200 and spark.conf.get(J.AT_ONCE) == before
    rows = pa.table({"n": [4], "classes": [np.arange(1, 13, dtype=np.int64).tobytes()], "at": [np.array([0, 1, 2, 3], dtype=np.uint16).tobytes()], "grams": [np.array([5, 5, 5, 5], dtype=np.uint64).tobytes()]})
    assert J.shared(0, rows, 1, 6).column("bucket").to_pylist() == [1, 2, 3, 4]


def test_products_take_bounded_memory():
    """Many rows with frequent n-grams: what is counted at once is bounded by entries, not by columns."""
    draw = np.random.default_rng(2)
    grams = [np.sort(draw.choice(3000, 300, replace=False)).astype(np.uint64) for _ in range(1000)]
    grams += [np.unique(np.append(g[:-1], np.uint64(3000 + k))) for k, g in enumerate(grams)]
    size = np.array([len(g) for g in grams])
    tracemalloc.start()
    root = J.product_roots(size, grams, 75, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert root.tolist() == [*range(1000), *range(1000)] and peak < 2.5e8
