"""Jobs followed, results appended and progress as streams: any batches, restarts and failures give what one batch gives."""

import random
from datetime import datetime, timedelta

import pytest

from chatloom.streaming import jobs, results

START = datetime(2024, 3, 1)


def lines(seed, n=60, hours=40):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        event = rng.choice(["beat", "beat", "beat", "start", "stop", "exit"])
        out.append((rng.randrange(12), k, START + timedelta(minutes=k * hours * 60 // n), event, rng.choice([0, 0, 1, -9]) if event == "exit" else None, rng.choice([None, 0.5, 7.0])))
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 60), (2, 20), (3, 7)])
def test_followed_jobs_are_what_one_batch_finds(spark, tmp_path, seed, size):
    rows = lines(seed)
    rows += [(None, 900, START, "beat", None, None), (3, None, START, "exit", 0, None), (3, 901, None, "exit", 0, None)]
    rng, order = random.Random(seed), list(range(len(rows)))
    for k in range(0, len(order), size):  # out of order within a batch
        part = order[k : k + size]
        rng.shuffle(part)
        order[k : k + size] = part
    splits = [order[k : k + size] + order[k : k + 2] for k in range(0, len(order), size)]
    for number, part in enumerate(splits):  # one file at a time, over several starts of the query
        spark.createDataFrame([rows[i] for i in part], jobs.LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if number % 2 or number == len(splits) - 1:
            jobs.follow(spark.readStream.schema(jobs.LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), silence=5 * 3600).awaitTermination(300)
    got = sorted(map(tuple, jobs.current(spark, str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, jobs.settled(spark.createDataFrame(rows, jobs.LINES), silence=5 * 3600).collect()))
    assert got == want and len({r[1] for r in got}) > 2


def test_a_late_line_brings_a_job_back(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    parts = [[(1, 1, at(0), "start", None, None), (2, 2, at(1), "beat", None, None)], [(2, 3, at(20), "beat", None, None)], [(1, 4, at(21), "beat", None, 1.0), (2, 5, at(21), "stop", None, None), (2, 5, at(21), "stop", None, None)], [(2, 6, at(22), "exit", 0, None), (2, 7, at(23), "exit", 1, None)]]
    seen = []
    for part in parts:
        spark.createDataFrame(part, jobs.LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.follow(spark.readStream.schema(jobs.LINES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), silence=7200).awaitTermination(300)
        seen.append({r.job: (r.status, r.code) for r in jobs.current(spark, str(tmp_path / "out")).collect()})
    assert seen == [{1: ("running", None), 2: ("running", None)}, {1: ("ended", None), 2: ("running", None)}, {1: ("running", None), 2: ("stopping", None)}, {1: ("running", None), 2: ("stopped", 0)}]


def test_state_grows_by_buckets_not_by_jobs(spark, tmp_path):
    rows = [(k % 5000, k, START + timedelta(seconds=k), ["start", "beat", "stop", "exit"][k // 5000 * (k % 3) % 4], 0, None) for k in range(10_000)]
    spark.createDataFrame(rows, jobs.LINES).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = jobs.follow(spark.readStream.schema(jobs.LINES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), silence=3600)
    query.awaitTermination(300)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 3 * jobs.BUCKETS  # values and both sides of timers
    got = sorted(map(tuple, jobs.current(spark, str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, jobs.settled(spark.createDataFrame(rows, jobs.LINES), silence=3600).collect()), key=str)


SCHEMA = "case string, n int, at timestamp_ntz"


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame([(c, n, START + timedelta(seconds=n)) for c, n in part], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cases_are_appended_once_over_restarts_and_failures(spark, tmp_path, monkeypatch):
    log, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    feed(spark, log, [[("a", 1), ("b", 5), ("b", 2), (None, 9)], [("b", 1), ("c", 3)], [("c", 3), ("d", 4), ("d", 4)]])
    real = results.append_batch

    def failing(rows, number, *rest):
        done = real(rows, number, *rest)
        if number == 1:
            raise RuntimeError("lost after the batch was written, before it was committed")
        return done

    monkeypatch.setattr(results, "append_batch", failing)
    with pytest.raises(Exception, match="lost after"):
        results.append_once(stream(spark, log), out, checkpoint, "case", ["n"]).awaitTermination(300)
    assert sorted(r.case for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    monkeypatch.setattr(results, "append_batch", real)
    results.append_once(stream(spark, log), out, checkpoint, "case", ["n"]).awaitTermination(300)
    feed(spark, log, [[("a", 1), ("e", 7)]])
    results.append_once(stream(spark, log), out, checkpoint, "case", ["n"]).awaitTermination(300)
    assert sorted((r.case, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 7)]
    assert results.append_batch(spark.read.schema(SCHEMA).parquet(log), 99, out, "case", ["n"]) and not results.append_batch(spark.read.schema(SCHEMA).parquet(log), 99, out, "case", ["n"])
    assert spark.read.parquet(out).count() == 5


def test_progress_follows_the_store(spark, tmp_path):
    log, out, seen = (str(tmp_path / x) for x in ("in", "out", "seen"))
    totals = spark.createDataFrame([("x", 4), ("y", 2)], "g string, total long")
    found = []
    for part in ([("x1", 0), ("x2", 10)], [("x2", 11), ("x3", 30), ("y1", 30)], [("z1", 31), ("x4", 40)]):
        feed(spark, log, [part])
        results.append_once(stream(spark, log), out, str(tmp_path / "c"), "case", ["n"]).awaitTermination(300)
        rows = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out).selectExpr("substring(case, 1, 1) as g", "at")
        results.progress(rows, totals, seen, str(tmp_path / "c3"), "g", "at").awaitTermination(300)
        found.append(sorted((r.g, r.done, r.total, r.share, r.elapsed, r.eta) for r in results.current(spark, seen, "g").collect()))
    assert found == [
        [("x", 2, 4, 0.5, 10.0, 10.0)], [("x", 3, 4, 0.75, 30.0, 10.0), ("y", 1, 2, 0.5, 0.0, 0.0)],
        [("x", 4, 4, 1.0, 40.0, 0.0), ("y", 1, 2, 0.5, 0.0, 0.0), ("z", 1, None, 0.0, 0.0, None)],
    ]
