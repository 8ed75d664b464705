"""Stores for several writers, sealed suites and their guard."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from chatloom import api
from chatloom.functions import bloom
from chatloom.sources import stores as W
from chatloom.sources.sealed import Sealed
from chatloom.sources.versions import Documents, Log


def test_an_entry_is_created_once(spark, tmp_path):
    log = Log(spark, str(tmp_path / "a log"))
    assert log.last() == 0 and log.entries() == []
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda k: Log(spark, str(tmp_path / "a log")).add(1, {"who": k}), range(6)))
    assert sum(done) == 1 and log.entries()[0]["who"] == done.index(True) and not log.add(1, {}) and log.add(2, {"x": 1})
    assert [e["number"] for e in log.entries()] == [1, 2] and [e["number"] for e in log.entries(2)] == [2]
    assert not [p for p in (tmp_path / "a log").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]


def documents(spark, path, every=50):
    return Documents(spark, str(path), "id", "id long, t string", every)


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "id long, t string")


def test_documents_are_replaced_and_deleted(spark, tmp_path):
    store = documents(spark, tmp_path / "d")
    read = lambda n=None: sorted(map(tuple, store.read(n).collect()))
    assert read() == [] and store.compact() == 0
    assert store.put(rows(spark, (1, "a"), (2, "b"))) == 1 and store.put(rows(spark, (2, "c"), (3, None))) == 2
    store.delete(rows(spark, (1, "x"), (9, "x")))
    assert read() == [(2, "c"), (3, None)] and read(1) == [(1, "a"), (2, "b")] and read(2) == [(1, "a"), (2, "c"), (3, None)]
    assert store.compact() == 4 and read() == [(2, "c"), (3, None)] and read(2) == [(1, "a"), (2, "c"), (3, None)]
    store.put(rows(spark, (1, "back")), new=True)
    assert read() == [(1, "back"), (2, "c"), (3, None)]
    for bad, new in (([(1, "again")], True), ([(5, "x"), (5, "y")], False), ([(None, "x")], False)):
        with pytest.raises(ValueError):
            store.put(rows(spark, *bad), new=new)
    assert len(read()) == 3


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    def work(who):
        store, log = documents(spark, tmp_path / "d", every=4), []
        for k in range(5):
            log.append(store.put(rows(spark, (10 * who + k, f"{who}"), (99, f"{who}-{k}"))))
        return log

    with ThreadPoolExecutor(3) as pool:
        numbers = [n for log in pool.map(work, range(3)) for n in log]
    got = {r.id: r.t for r in documents(spark, tmp_path / "d").read().collect()}
    assert len(set(numbers)) == 15 and got.pop(99) in {f"{w}-4" for w in range(3)} and got == {10 * w + k: str(w) for w in range(3) for k in range(5)}


def test_two_registries_at_once_give_each_key_an_id(spark, tmp_path):
    def work(who):
        store = W.Registry(spark, str(tmp_path / "r"), "name", "status string")
        for k in range(3):
            store.upsert(spark.createDataFrame([(f"{who}-{k}", "new"), ("both", f"{who}")], "name string, status string"))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(work, range(2)))
    got = {r.name: r.id for r in W.Registry(spark, str(tmp_path / "r"), "name", "status string").rows().collect()}
    assert sorted(got) == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2", "both"] and sorted(got.values()) == list(range(1, 8))


@pytest.mark.parametrize(("n", "most"), [(0, None), (1, None), (3000, None), (3000, 64)])
def test_bloom_filters_hold_all_that_they_were_built_of(spark, monkeypatch, n, most):
    if most:
        monkeypatch.setattr(bloom, "MOST", most)
    made = bloom.built(spark.range(n).select((F.col("id") * 7).cast("string").alias("v")), "v")
    rows = spark.range(n * 7 + 50).select(F.col("id"), F.col("id").cast("string").alias("v")).withColumn("may", bloom.may_hold(made, F.col("v")))
    got = {r.id for r in rows.where("may").collect()}
    own = {7 * k for k in range(n)}
    assert own <= got and (most or len(got - own) <= max(3, (n * 7 + 50) // 50))
    assert spark.range(1).select(bloom.may_hold(made, F.lit(None).cast("string"))).head()[0] is False


def source(path, pairs):
    path.write_text("\n".join(json.dumps({"instruction": a, "output": b}) for a, b in pairs))
    return str(path)


def test_sealed_suites_block_training(spark, tmp_path):
    call = "<|tool_call_start|>[bash(command='ls')]<|tool_call_end|>"
    suite = source(tmp_path / "suite.jsonl", [("q1", "a1"), ("q1", "a1"), ("q2 7", call), ("q2 8", call)])
    clean = source(tmp_path / "clean.jsonl", [(f"q{k}", f"a{k}") for k in range(20, 40)])
    leaky = source(tmp_path / "leaky.jsonl", [("q1", "a1"), *[(f"p{k}", "b") for k in range(20)]])
    store = Sealed(spark, str(tmp_path / "store"))
    store.refuse_sources([suite])
    assert store.hits(api.normalized(api.records(spark, leaky))).count() == 0
    ident = store.register(suite, " first ")
    with pytest.raises(ValueError, match="already"):
        Sealed(spark, str(tmp_path / "store")).register(suite)
    got = store.suites().collect()
    assert [(r.id, r.name, r.raw_rows, r.n, r.distinct_n, r.tools, r.tool_samples, r.skeletons) for r in got] == [(ident, "first", 4, 4, 3, {"bash": 2}, 2, 2)] and got[0].warnings == ["prompts are alike"]
    train, held = api.load_training_data(spark, [clean], sealed=store)
    assert train.count() + held.count() == 20
    for sources, validation, message in (([suite], None, "sealed test sources"), ([clean], [suite], "sealed test sources"), ([clean, leaky], None, "blocked: 1"), ([clean], [leaky], "blocked: 1")):
        with pytest.raises(ValueError, match=message):
            api.load_training_data(spark, sources, validation_sources=validation, sealed=store)
    assert store.hits(api.normalized(api.records(spark, leaky))).count() == 1
    other = store.register(source(tmp_path / "same.jsonl", [("q2 8", call), ("q1", "a1"), ("q2 7", call), ("q1", "a1")]))
    prints = {r.id: r.fingerprint for r in store.suites().collect()}
    assert prints[other] == prints[ident] and store.hashes().count() == 3


def test_files_are_written_where_rows_are(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 3}/f {k}.txt", f"{k}é" if k else None) for k in range(20)], "path string, content string").repartition(4)
    assert W.write_files(rows, str(tmp_path / "w")) == 20 and W.write_files(rows.limit(0), str(tmp_path / "w")) == 0
    assert {str(p.relative_to(tmp_path / "w")): p.read_text() for p in (tmp_path / "w").rglob("f *.txt")} == {f"d{k % 3}/f {k}.txt": f"{k}é" if k else "" for k in range(20)}
