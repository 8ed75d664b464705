"""Audits by expectations, the tensor source, the table function and composed streams."""

import json

import pytest
from pyspark.sql import functions as F

from chatloom import api
from chatloom.functions import table_functions
from chatloom.operators import audits as A
from chatloom.operators import sampling as S
from chatloom.sources import headers

E = A.Expectation


def found(rows, *expectations):
    return {r.name: (r.ok, r.rows, r["values"], r.least, r.most, r.wrong) for r in A.audited(rows, list(expectations)).collect()}


def test_expectations(spark):
    rows = spark.createDataFrame([(1, "a", "train", 5), (2, "a", "dev", 6), (3, "b", "train", None), (3, None, "dev", 7)], "id long, c string, split string, n int")
    got = found(
        rows, E("ids", "unique", ["id"]), E("both", "unique", ["id", "split"]), E("four", "rows", each=4), E("five", "rows", each=5), E("even", "balanced", ["split"]), E("two", "balanced", ["split"], each=2), E("one", "balanced", ["split"], each=1), E("cs", "balanced", ["c"]),
        E("right", "histogram", ["split"], counts={"train": 2, "dev": 2}), E("wrong", "histogram", ["split"], counts={"train": 1, "dev": 2, "test": 1}), E("nulls", "never", condition="n is null"), E("big", "never", condition="n > 100"), E("apart", "apart", ["id"], side="split"), E("c", "apart", ["c"], side="split"), E("nid", "apart", ["id"], side="id % 2"),
    )
    assert got == {
        "ids": (False, 4, 3, 1, 2, 1), "both": (True, 4, 4, 1, 1, 0), "four": (True, 4, 1, 4, 4, 0), "five": (False, 4, 1, 4, 4, 0), "even": (True, 4, 2, 2, 2, 0), "two": (True, 4, 2, 2, 2, 0), "one": (False, 4, 2, 2, 2, 0), "cs": (False, 4, 3, 1, 2, 0),
        "right": (True, 4, 2, 2, 2, 0), "wrong": (False, 4, 2, 2, 2, 2), "nulls": (False, 1, 1, 1, 1, 1), "big": (True, 0, 0, 0, 0, 0), "apart": (False, 4, 3, 1, 2, 1), "c": (False, 4, 3, 1, 2, 1), "nid": (True, 4, 3, 1, 2, 0),
    }
    assert A.verdict(A.audited(rows, [E("x", "rows", each=4), E("y", "rows", each=3), E("a", "unique", ["c"])])).head()[:] == ("blocked", ["a", "y"])
    assert A.verdict(A.audited(rows, [E("x", "rows", each=4)])).head()[:] == ("ready", [])
    empty = found(rows.limit(0), E("none", "rows", each=0), E("some", "rows", each=1), E("ids", "unique", ["id"]), E("n", "never", condition="true"), E("h", "histogram", ["c"], counts={"a": 1}))
    assert {k: v[0] for k, v in empty.items()} == {"none": True, "some": False, "ids": True, "n": True, "h": False}
    for bad in ([], [E("x", "rows"), E("x", "unique", ["id"])], [E("x", "what")]):
        with pytest.raises(ValueError):
            A.audited(rows, bad)


def test_tensor_source(spark, tmp_path):
    def write(name, head, raw=None):
        text = json.dumps(head).encode()
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / name).write_bytes(raw if raw is not None else len(text).to_bytes(8, "little") + text + b"\0" * 99)

    write("a.safetensors", {"__metadata__": {"x": 1}, "w": {"dtype": "F32", "shape": [2, 3]}, "s": {"dtype": "BF16", "shape": []}})
    write("b.safetensors", {"v": {"shape": [7]}})
    write("c.bin", {})
    headers.register(spark)
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t"):
        got = sorted((r.path.rpartition("/")[2], r.name, r.dtype, r["shape"]) for r in spark.read.format("tensor_headers").load(root).collect())
        assert got == [("a.safetensors", "s", "BF16", []), ("a.safetensors", "w", "F32", [2, 3]), ("b.safetensors", "v", "unknown", [7])]
    one = spark.read.format("tensor_headers").option("limit", 1).load(str(tmp_path / "t"))
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1 and spark.read.format("tensor_headers").load(str(tmp_path / "t" / "b.safetensors")).count() == 1
    write("d.safetensors", {}, raw=b"\x09\0\0\0\0\0\0\0{broken")
    with pytest.raises(Exception, match="d.safetensors has no header"):
        spark.read.format("tensor_headers").load(str(tmp_path / "t")).collect()


def test_table_function_gives_what_the_api_gives(spark, tmp_path):
    talk = [{"role": "system", "content": "é \"s\""}, {"role": "user", "content": None}, {"role": "assistant", "content": "a\n1"}, {"role": None, "content": "x"}, {"role": "assistant", "content": "b/2"}]
    lines = [{"messages": talk, "category": "m"}, {"messages": talk[2:3]}, {"instruction": "i", "output": "o"}, {"instruction": "", "question": "q", "output": "", "answer": "", "reference_answer": ""}, {"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}]
    layouts = {"talks": lines[:2], "pairs": lines[2:4], "sides": lines[4:], "texts": [{"prompt": "p", "completion": "c", "category": "t"}, {"prompt": "p"}], "mixed": lines[:4]}
    table_functions.register(spark)
    for name, rows in layouts.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n".join(map(json.dumps, rows)))
        spark.read.json(str(path)).createOrReplaceTempView("layout")
        shown = lambda r: (r.category, r.example_hash, [(m.content, m.role) for m in r.prompt], [(m.content, m.role) for m in r.completion])
        got = sorted(map(repr, map(shown, spark.sql("SELECT * FROM normalized_records(TABLE(layout))").collect())))
        want = sorted(map(repr, map(shown, api.normalized(api.records(spark, str(path))).collect())))
        assert got == want and got, name
    spark.range(3).createOrReplaceTempView("odd")
    with pytest.raises(Exception, match="a record has messages"):
        spark.sql("SELECT * FROM normalized_records(TABLE(odd))").collect()


def test_composed_streams(spark):
    rows = spark.createDataFrame([(k, "r" if k < 3 else None) for k in range(13)], "id long, c string")
    got = S.composed(rows, "id", F.col("c") == "r", 0.25, 40, "x").collect()
    assert sorted(r.position for r in got) == list(range(1, 41)) and len({(r.id, r.copy) for r in got}) == 40
    count = lambda pool: sorted(sum(r.id == i for r in got if r.pool == pool) for i in {r.id for r in got if r.pool == pool})
    assert count("replay") == [3, 3, 4] and count("canonical") == [3] * 10
    again = {r.position: (r.id, r.copy) for r in S.composed(rows.repartition(5), "id", F.col("c") == "r", 0.25, 40, "x").collect()}
    assert again == {r.position: (r.id, r.copy) for r in got} and [i for _, (i, _) in sorted(again.items())] != sorted(i for i, _ in again.values())
    assert {r.pool for r in S.composed(rows, "id", F.lit(False), 0.0, 5, "x").collect()} == {"canonical"}
    with pytest.raises(ValueError, match="nothing to draw"):
        S.composed(rows.where("id >= 3"), "id", F.col("c") == "r", 0.5, 4, "x")
