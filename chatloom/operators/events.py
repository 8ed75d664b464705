"""Event logs: latest state, tails, phases and job states; the functions take batch rows, and those that only group take streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.sampling import id_bucket, ranked

#: The job states that an event leads to.
STATES = {"signup": "running", "view": "running", "click": "stopping", "purchase": "complete", "error": "failed"}


def latest(events: DataFrame, *by: str) -> DataFrame:
    """The newest event of each group, ties to the larger id. Partial maxima travel, not rows."""
    return events.groupBy(*by).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")).select(*by, "last.*")


def tail(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("event_id")).limit(n)


def states(events: DataFrame, by: str) -> DataFrame:
    return states_of(latest(events, by))


def states_of(newest: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return newest.withColumn("state", F.coalesce(F.element_at(table, F.col("event_type")), F.lit("ended")))


def strided(rows: DataFrame, by: str, order: str, points: int) -> DataFrame:
    """About `points` evenly spaced rows of a series, all of a shorter one. order is a whole number; no task takes a whole series."""
    rows = ranked(rows, "rn", id_bucket(F.col(order)), [F.col(order)], (by,)).withColumn("rn", F.col("rn") - 1)
    return rows.where((F.col("n") <= points) | (F.pmod("rn", F.greatest(F.lit(1), F.floor(F.col("n") / points))) == 0))


def best_per_run_suite(evaluations: DataFrame) -> DataFrame:
    """evaluations: run, suite, samples, has_base, evaluated_at, pos. The best by samples, base, time; the first on a tie."""
    by = Window.partitionBy("run", "suite").orderBy(F.desc("samples"), F.desc("has_base"), F.desc("evaluated_at"), "pos")
    return evaluations.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def compared(runs: DataFrame, sheets: DataFrame, evaluations: DataFrame, default: str = "legacy / unsaved") -> DataFrame:
    """runs (run, key) with the sheet of their key, or the default, and each of their evaluations; a run without any keeps one row."""
    return runs.join(sheets, "key", "left").withColumn("sheet", F.coalesce("sheet", F.lit(default))).join(evaluations, "run", "left")


def read_tail(lines: DataFrame, position: str, line: str, n: int, schema: str) -> DataFrame:
    """The last n lines by position, as objects; what is malformed is dropped afterwards."""
    last = lines.orderBy(F.desc(position)).limit(n)
    row = F.from_json(line, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return last.select(row.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def progress(steps: DataFrame, at: str, n: str) -> DataFrame:
    """steps (time, count; one row a time) with the running sum, its share of all, and the seconds that the rest takes at the pace so far."""
    every = Window.partitionBy(F.lit(0))
    rows = steps.withColumn("upto", F.sum(n).over(every.orderBy(at))).withColumn("fraction", F.col("upto") / F.sum(n).over(every))
    elapsed = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.min(at).over(every).cast("timestamp"))
    return rows.withColumn("eta", F.when(F.col("fraction") > 0, elapsed * (1 - F.col("fraction")) / F.col("fraction")))


def phases(events: DataFrame, names: dict[str, str], other: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return events.withColumn("phase", F.coalesce(F.element_at(table, F.col("event_type")), F.lit(other)))


def next_state() -> Column:
    """Of a job (ours, exit_code, stop_requested, status, alive). A job of ours without an exit code runs on; others count as ended when they aren't alive."""
    asked = F.coalesce("stop_requested", F.lit(False))
    done = F.when((F.col("exit_code") == 0) & asked, "stopped").when(F.col("exit_code") == 0, "complete").otherwise("failed")
    own = F.when(F.col("exit_code").isNull(), F.when(asked, "stopping").otherwise("running")).otherwise(done)
    active = F.col("status").isin("running", "stopping")
    return F.when(F.col("ours"), own).when(active, F.when(F.col("alive"), F.col("status")).otherwise("ended")).otherwise(F.coalesce("status", F.lit("unknown")))
