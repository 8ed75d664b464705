"""What a task holds at once, and results that don't depend on how rows are dealt."""

import os

import numpy as np
import pyarrow as pa

from chatloom.functions import text as X
from chatloom.operators import batches, generators, subwords
from chatloom.operators.literals import literal_spans, literals, overlapping
from chatloom.sources import headers


def test_pieces_meet_spans_where_they_are(spark):
    rows = spark.createDataFrame([(1, "say `x = 1` and\n```py\nb = 2\n``` so", 0), (2, "é🙂`中`", 0), (3, None, 0), (4, "", 0), (5, "none", 0)], "id long, t string, z int")
    from chatloom.operators.literals import with_literals
    from pyspark.sql import functions as F

    spans = literal_spans(rows, "id", "t").withColumn("role", F.lit(3))
    tokens = subwords.tokens(rows, "id", "t")
    want = sorted(map(tuple, overlapping(tokens, spans, "id").collect()))
    own = with_literals(rows, "t", "s").withColumn("s", F.transform("s", lambda s: s.withField("role", F.lit(3))))
    assert sorted(map(tuple, subwords.tokens(own, "id", "t", spans="s").collect())) == want and any(r[-1] == 3 for r in want)


def test_largest_role_as_by_pairs():
    draw = np.random.default_rng(5)
    for _ in range(50):
        start = np.sort(draw.integers(0, 40, 30))
        stop = np.maximum.accumulate(start + draw.integers(0, 4, 30))
        spans = [{"start": int(a), "stop": int(a + n), "role": int(r)} for a, n, r in zip(draw.integers(0, 40, 9), draw.integers(0, 9, 9), draw.integers(1, 6, 9), strict=True)]
        want = [max([s["role"] for s in spans if s["start"] < b and s["stop"] > a and s["stop"] > s["start"] and b > a], default=0) for a, b in zip(start, stop, strict=True)]
        assert subwords.largest(start, stop, spans).tolist() == want


def test_runs_hold_bounded_texts():
    texts = ["a" * 1000, None, ""] * 2000 + ["b" * (batches.CHARS * 2)] + ["c"]
    found = list(batches.runs(pa.array(texts)))
    assert [t for _, _, some in found for t in some] == texts and [lo for lo, _, _ in found] == [0, *[hi for _, hi, _ in found[:-1]]]
    assert all(len(some) == 1 or sum(len(t or "") for t in some) <= batches.CHARS for _, _, some in found)


def test_tokens_come_in_small_batches(spark):
    """One Arrow batch of many texts gives its tokens in several: none has more than a run's."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(' a', 1000) as t")
    held = subwords.tokens(rows, "id", "t").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").agg({"n": "max"}).head()[0]
    assert held <= batches.CHARS


def test_json_is_the_whole_text(spark):
    good = ["1", "null", '"a"', "[]", "{}", '[1, {"a": [2]}]', '{"a": 1, "a": 2}', "```json\n[1]\n```", " 12 ", '"[1]"', "-1.5e3", '"\\u0041"']
    bad = ["12 left", "1, 2", '1, "b": 2', "1] [2", "1} x", "1]} x", '1], "a": [2', "[1] [2]", "{} {}", "", "  ", "{", "[1,]", "'a'", "nul", '1} {"a": 2', '"a" "b"', "01", "{'a': 1}", '1], "_bad": [2']
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    got = {r.t: r.ok for r in rows.select("t", X.is_json(rows.t).alias("ok")).collect()}
    assert [t for t in good if got[t] is not True] == [] and [t for t in bad if got[t] is not False] == [] and got[None] is None


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_shared_words_are_counted_where_rows_are(spark):
    rows = spark.createDataFrame([(1, "a b b é", "B b a c"), (2, None, "a"), (3, "x x x", "x x"), (3, "", "y")], "id long, v string, o string")
    found = X.shares_words(rows, "id", "v", "o", 2, 3)
    assert sorted(map(tuple, found.collect())) == [(1, True), (2, False), (3, False), (3, True)] and "Exchange" not in plan(found)


def test_words_of_a_text_are_made_once(spark, sf):
    from chatloom.plans.all import QUERIES

    assert plan(QUERIES["ifeval_capital_words"](spark, sf)).count("(gim|lem)") == 1


def test_texts_are_read_in_one_step(spark, sf):
    """Spans are found where tokens are; texts don't go to Python twice, nor their marks through Java's patterns."""
    from chatloom.plans.all import QUERIES

    for name in ("token_role_join", "literal_mask"):
        steps = plan(QUERIES[name](spark, sf))
        assert steps.count("MapInArrow") == 1 and "regexp_extract_all" not in steps


def test_literals_stand_where_they_match():
    t = "``x` é\n`x` ```py\n `a` ``` é `b\nc` ````z``` ``` open `y`"
    assert [t[s["start"] : s["stop"]] for s in literals(t)] == ["x", "`a` ", "`z", "y"] and literals(t)[0]["start"] == 8 and literals(None) == []


def test_tasks_list_documents(spark, tmp_path, monkeypatch):
    """No reader lists the files on the driver; what Spark's readers pass over is passed over."""
    from pyspark.sql.readwriter import DataFrameReader

    from chatloom.sources import stores

    names = ["a.json", "x y/ü%20.json", "x y/b/c.json", "x y/b/d/e.json", "a.jsonl", "_no/f.json", ".no/g.json", "b/_h.json", "b/.i.json", "_k=1/j.json", "x.json/k.json", "empty/none.txt", "b/bad.json", "b/late.json"]
    for k, name in enumerate(names):
        at = tmp_path / "root 1" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text('{"id": ' if name == "b/bad.json" else f'{{"id": {k}{", " + chr(34) + "at" + chr(34) + ": " + chr(34) + "2001" + chr(34) if name == "b/late.json" else ""}}}')
        os.utime(at, (1_000_000_000 - k, 1_000_000_000 - k))
    monkeypatch.setattr(DataFrameReader, "text", None)
    for root in (str(tmp_path / "root 1"), f"file://{tmp_path}/root 1"):
        rows = stores.listed(spark, root, "id long, at string", "at").collect()
        assert [r.id for r in rows] == [0, 1, 2, 3, 9, 10, 13]  # the last ones' times are of 2001, too
        assert rows[1].mtime.timestamp() == 999_999_999
    one = stores.listed(spark, str(tmp_path / "root 1" / "a.json"), "id long, at string", "at").collect()
    assert [r.id for r in one] == [0] and stores.listed(spark, str(tmp_path / "root 1" / "empty"), "id long, at string", "at").count() == 0
    monkeypatch.setattr(stores, "READ", 1)
    assert stores.listed(spark, str(tmp_path / "root 1"), "id long, at string", "at").count() == 7


def test_prompts_are_not_shuffled(spark):
    rows = generators.suite(spark.range(5))
    found = generators.audited(rows)
    assert "Expand" not in plan(found) and {r.status for r in found.collect()} == {"ready"}
    twice = generators.audited(rows.unionAll(rows.where("split = 'dev' and category = 'open'").limit(1)))
    assert {r.category: r.status for r in twice.collect()}["open"] == "blocked"


def test_tensor_files_share_partitions(spark, tmp_path):
    for k in range(300):
        head = f'{{"t{k}": {{"dtype": "F32", "shape": [{k}, 2]}}}}'.encode()
        (tmp_path / f"{k:03}.safetensors").write_bytes(len(head).to_bytes(8, "little") + head)
    headers.register(spark)
    found = spark.read.format("tensor_headers").load(str(tmp_path))
    assert found.rdd.getNumPartitions() <= headers.PARTS and sorted(r["shape"][0] for r in found.collect()) == list(range(300))
