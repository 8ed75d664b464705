import pytest

from chatloom.operators import events as E
from chatloom.operators import tables as T


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_closure_of_long_chains_and_cycles(spark):
    entries = ids(spark, *range(70))
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "id long, need long")
    assert sorted(r.id for r in T.closure(entries, chain, ids(spark, 3)).collect()) == list(range(3, 21))
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1)], "id long, need long")
    assert sorted(r.id for r in T.closure(entries, ring, ids(spark, 2, 2)).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="missing ids: \\[99\\]"):
        T.closure(entries, spark.createDataFrame([(1, 99)], "id long, need long"), ids(spark, 1))
    assert T.closure(entries, ring, ids(spark)).count() == 0


def test_a_missing_answer_is_an_error(spark):
    assert T.aligned(ids(spark, 1, 2), ids(spark, 2, 1, 5), "id").count() == 2
    with pytest.raises(ValueError, match="\\[3, 4\\]"):
        T.aligned(ids(spark, 4, 3, 1), ids(spark, 1), "id")


def test_dual_seed_wants_two(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "gene string, s double")
    assert T.dual_seed(rows, "gene", "s").head().robust == pytest.approx(0.7 * 2 + 0.3 - 0.15)
    with pytest.raises(Exception, match="exactly 2 seed scores"):
        T.dual_seed(rows.limit(1), "gene", "s").collect()


def test_grid_is_whole_or_drawn(spark):
    domains = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert sorted((r.a, r.b) for r in T.grid(spark, domains, "s").collect()) == sorted((a, b) for a in domains["a"] for b in domains["b"])
    drawn = T.grid(spark, domains, "s", most=5, draws=40).collect()
    assert len(drawn) == 40 and {(r.a, r.b) for r in drawn} <= {(a, b) for a in domains["a"] for b in domains["b"]} and len({(r.a, r.b) for r in drawn}) > 3


def test_unmatched_runs_keep_a_row(spark):
    runs = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "run long, key long")
    sheets, evaluations = spark.createDataFrame([(5, "five")], "key long, sheet string"), spark.createDataFrame([(1, 10), (1, 11)], "run long, evaluation long")
    assert sorted(((r.run, r.sheet, r.evaluation) for r in E.compared(runs, sheets, evaluations).collect()), key=str) == [(1, "five", 10), (1, "five", 11), (2, "legacy / unsaved", None), (3, "legacy / unsaved", None)]


def test_corpus_audit(spark):
    rows = spark.createDataFrame([("a", "x", 1, True), ("b", "y", 1, True)], "h string, category string, menus int, parsed boolean")
    folds = spark.createDataFrame([("c", "x", 1, True, 0), ("d", "y", 1, True, 0), ("e", "x", 1, True, 1), ("f", "y", 1, True, 1)], "h string, category string, menus int, parsed boolean, fold int")
    assert T.corpus_audit(rows, folds, 1, 1).head().status == "ready"
    assert T.corpus_audit(rows, folds, 2, 1).head().problems == "unexpected category distribution"
    bad = T.corpus_audit(rows.unionAll(rows.limit(1)), folds.unionAll(folds.selectExpr("if(h = 'c', 'a', h)", "category", "2", "false", "fold + 1")), None, None).head()
    assert bad.status == "blocked" and bad.train_overlap == 1 and bad.fold_overlap == 3 and "readable" in bad.problems and "menu" in bad.problems and "unique" in bad.problems


def test_screening_takes_the_best_of_those_that_pass(spark):
    names = "label string, recall double, specificity double, balanced double, mcc double, named_accuracy double, exact_accuracy double"
    rows = spark.createDataFrame([("base", 0.9, 0.7, 0.8, 0.5, 0.8, 0.5), ("good", 0.95, 0.8, 0.9, 0.6, 0.79, 0.6), ("worse", 0.9, 0.7, 0.8, 0.5, 0.7, 0.9), ("chance", 0.9, 0.9, 0.9, 0.0, 0.9, 0.9)], names)
    got = {r.label: (r.passes, r.recommended) for r in T.screened(rows, "label", "base").collect()}
    assert got == {"base": (True, False), "good": (True, True), "worse": (False, False), "chance": (False, False)}
