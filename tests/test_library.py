import json

import pytest
from pyspark.sql import functions as F

from chatloom import api
from chatloom.functions import text as X
from chatloom.operators import generators as G
from chatloom.operators import sampling as S
from chatloom.sources import readers as R
from chatloom.sources import stores as W
from chatloom.streaming import logs


def test_entry_and_guarded_import(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n[2]\nbroken\n{"id": \n{"id": "x"}\n{"id": 3}\n')
    assert sorted(r.id for r in R.json_lines(spark, str(tmp_path), "id long").collect()) == [1, 3]
    assert [r.id for r in R.json_lines(spark, str(tmp_path), "id long", limit=2).collect()] == [1]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "l.json").write_text('[{"id": 1}, {"id": 2}]')
    (docs / "d.json").write_text('{"data": [{"id": 3}]}')
    (docs / "o.json").write_text('{"id": 4}')
    assert sorted(r.id for r in R.json_documents(spark, str(docs), "id:bigint").collect()) == [1, 2, 3, 4]
    assert R.first_objects(spark, str(tmp_path), "id long", glob="*.jsonl").head().id == 1


def test_dataset_prefers_parquet_and_refuses_nothing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x" / "p"))
    (tmp_path / "x" / "y.json").write_text('{"id": 9}')
    assert R.dataset(spark, str(tmp_path / "x")).count() == 3
    mixed = tmp_path / "m"
    mixed.mkdir()
    (mixed / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (mixed / "b.json").write_text('[{"id": 3},\n {"id": 4}]')
    assert sorted(r.id for r in R.dataset(spark, str(mixed)).collect()) == [1, 2, 3, 4]
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError):
        R.dataset(spark, str(tmp_path / "e"))


def test_union_csv(spark, tmp_path):
    R.union_csv([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, c int")], str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["a", "b", "c"]
    R.union_csv([], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_streamed_log_and_states(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"event_id": k, "ts": f"2024-01-01T00:00:{k:02d}", "user_id": k % 2, "event_type": ["view", "error"][k > 3], "value": 1.0} for k in range(6)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    logs.append_log(logs.read_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    states = str(tmp_path / "states")
    logs.job_states(logs.read_log(spark, str(tmp_path / "in")), states, str(tmp_path / "c2")).awaitTermination(120)
    (tmp_path / "in" / "b.json").write_text(json.dumps(rows[0] | {"event_id": 9, "ts": "2024-01-01T00:01:00", "event_type": "purchase"}))
    logs.job_states(logs.read_log(spark, str(tmp_path / "in")), states, str(tmp_path / "c2")).awaitTermination(120)
    assert {(r.user_id, r.event_id, r.state) for r in logs.current_states(spark, states).collect()} == {(0, 9, "complete"), (1, 5, "failed")}


def test_quotas_sum_and_refuse(spark):
    rows = spark.createDataFrame([("a", 0, 0.6), ("b", 1, 0.4)], "category string, idx int, weight double")
    assert sum(r.quota for r in S.weighted_quotas(rows, 101).collect()) == 101


def test_ranks_without_a_window_over_all_rows(spark):
    rows = spark.createDataFrame([(k * 37 % 500 * 1000, "ab"[k % 2]) for k in range(500)], "id long, c string")
    got = S.ranked(rows, "rank", S.id_bucket(F.col("id")), [F.col("id")], ("c",)).collect()
    for c in "ab":
        assert [r["rank"] for r in sorted((r for r in got if r.c == c), key=lambda r: r.id)] == list(range(1, 251)) and {r.n for r in got} == {250}
    with pytest.raises(ValueError, match="nothing to draw"):
        S.drawn_with_replacement(rows.limit(0), "id", 5, "x")


def test_lines_are_written_once_and_frozen_ones_never_over(spark, tmp_path):
    path, rows = str(tmp_path / "l"), spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, t string")
    assert W.write_lines(rows, path) and not W.write_lines(rows, path) and W.write_lines(rows.limit(1), path)
    assert W.write_lines(W.read_lines(spark, path, rows.schema).unionByName(rows), path)
    with pytest.raises(ValueError, match="other rows"):
        W.write_lines(rows, path, frozen=True)
    with pytest.raises(Exception, match="a row without t"):
        W.read_lines(spark, path, rows.schema, "t").collect()


def test_registry(spark, tmp_path):
    store = W.Registry(spark, str(tmp_path / "r"), "name", "status string")
    put = lambda *rows: store.upsert(spark.createDataFrame(rows, "name string, status string"))
    assert store.newest().count() == 0
    put(("b", "new"), ("a", "new"))
    first = {r.name: (r.id, r.created_at) for r in store.rows().collect()}
    put(("b", "done"), ("c", "new"))
    got = {r.name: r for r in store.rows().collect()}
    assert {n: (r.id, r.status) for n, r in got.items()} == {"a": (1, "new"), "b": (2, "done"), "c": (3, "new")} and got["b"].created_at == first["b"][1]
    store.update([1], status="old")
    assert store.resolve("a").head().status == "old" and store.resolve("3").head().name == "c" and store.resolve("zz").count() == 0
    store.delete(spark.createDataFrame([("a",)], "name string"))
    assert [r.name for r in store.newest().collect()] == ["c", "b"]


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", 0.5, None)], "name string, accuracy double, note string")
    assert W.markdown(rows).splitlines()[2] == "| a\\|b | 50.00% | N/A |" == W.markdown_lines(rows).head().line
    with pytest.raises(ValueError):
        W.markdown(spark.range(30).toDF("n"), most=20)


def test_training_data_api(spark, tmp_path):
    rows = [{"messages": [{"role": "user", "content": f"q{k}"}, {"role": "assistant", "content": f"a{k}"}, {"role": "user", "content": "more"}, {"role": "assistant", "content": "yes"}], "category": ["main", "rehearsal"][k % 2]} for k in range(20)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"instruction": f"i{k}", "output": f"<|tool_call_start|>[bash(command='{k}')]<|tool_call_end|>"}) for k in range(6)))
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    train, held = api.load_training_data(spark, [a, b], eval_ratio=0.2)
    assert train.count() + held.count() == 46 and held.select("example_hash").intersect(train.select("example_hash")).count() == 0
    assert api.load_training_data(spark, [a], validation_sources=[b], max_validation_samples=3)[1].count() == 3
    for bad in (a,):
        with pytest.raises(ValueError, match="same records"):
            api.load_training_data(spark, [a], validation_sources=[bad])
    with pytest.raises(ValueError, match="allowed tools"):
        api.load_training_data(spark, [b], allowed_tools=["read"])
    mixed, _ = api.load_training_data(spark, [a], replay_ratio=0.25, max_training_samples=12)
    assert mixed.groupBy("category").count().where("category = 'rehearsal'").head()["count"] == 3 and mixed.count() == 12
    menu, _ = api.load_training_data(spark, [b], allowed_tools=["bash"], menu=True)
    assert all(r.prompt[0].role == "system" and r.prompt[0].content.startswith("List of tools: [{") for r in menu.collect())
    (tmp_path / "c.jsonl").write_text(json.dumps({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}) + "\n")
    assert api.normalized(api.records(spark, str(tmp_path / "c.jsonl"))).head().prompt[0].content == "p"
    assert api.validate_training_source(spark, b) | {"source": ""} == {"source": "", "raw_columns": ["instruction", "output"], "normalized_rows": 5, "sample_prompt_roles": ["user"], "sample_completion": api.validate_training_source(spark, b)["sample_completion"]}


def test_command_line(spark, sf, tmp_path, capsys):
    from chatloom.__main__ import main

    main(["list"])
    assert "corpus_audit" in capsys.readouterr().out
    main(["run", "tail_events", sf, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 20


def test_generated_rows_and_menus(spark):
    rows = G.suite(spark.range(3))
    assert rows.count() == 45 and {r.status for r in G.audited(rows).collect()} == {"ready"}
    bad = rows.withColumn("value", F.lit("not shown"))
    assert {r.category: r.status for r in G.audited(bad).collect()} == {c: "ready" if c == "rehearsal" else "blocked" for c in G.CATEGORIES}
    assert G.menu_schemas(["zz"])["zz"]["function"]["parameters"]["additionalProperties"] is True


def test_sentences_by_rules(spark):
    got = spark.range(1).select(X.sentences(F.lit('Mr. A. Smith paid 3.50 to x.com... He left. Ph.D. work? "Yes!" Done'))).head()[0]
    assert got == ["Mr. A. Smith paid 3.50 to x.com...", "He left.", "Ph.D. work?", '"Yes"!', "Done"]
    with pytest.raises(Exception, match="change me"):
        spark.range(1).select(X.rephrased(F.lit("plain"), F.lit("x"))).collect()


def test_recipes(tmp_path):
    from chatloom.recipe import Recipe, load_recipe, save_recipe

    path = str(tmp_path / "r.json")
    save_recipe(Recipe("one", ["a"], allowed_tools=["bash"]), path)
    assert load_recipe(path) == Recipe("one", ["a"], allowed_tools=["bash"])
    for bad in ({"name": " ", "datasets": ["a"]}, {"name": "x", "datasets": []}, {"name": "x", "datasets": ["a"], "eval_ratio": 0.9}, {"name": "x", "datasets": ["a"], "validation_datasets": ["a"]}, {"name": "x", "datasets": ["a"], "rows": 3}, [1]):
        (tmp_path / "r.json").write_text(json.dumps(bad))
        with pytest.raises((ValueError, TypeError)):
            load_recipe(path)


def test_category_scores_of_reports_without_predictions(spark):
    from chatloom.operators import metrics as M

    rows = M.legacy_scores(spark.createDataFrame([(5, 0.4, 0.8), (0, 0.0, 0.0)], "total long, routing_accuracy double, format_accuracy double")).collect()
    assert [(r.category, r.total, r.strict_success, r.routing_accuracy) for r in rows] == [("overall-only-legacy", 5, None, 0.4)]
