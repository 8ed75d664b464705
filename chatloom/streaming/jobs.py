"""Jobs followed as a stream: keyed state with exit codes and stop requests, and a timer for jobs that fall silent.

Log lines are job, event_id, at, event, code, value. `exit` ends a job with its code, `stop` asks it to stop; any other event is a sign of
life. What is kept a job are minima and maxima of its lines, so lines may come in any order and in any batches: the first exit, the first
request, the first and the last line. A job without an exit whose last line is `silence` behind the stream's clock has ended; a line that
comes later brings it back. The clock is the latest time seen less `delay`; lines that are older than the clock when they come are dropped.

Lines without a job, an id or a time are dropped; repeated lines count once, as far as what is kept can tell.

State is kept by BUCKETS hashes of jobs, as one Arrow table each, with one timer for the first job that is due: a batch reads and writes a
bucket once, not once a job, and folds all of its jobs' lines together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LINES = "job long, event_id long, at timestamp_ntz, event string, code int, value double"
#: Times are microseconds. exit_* and stop_* are null until there is one.
CHANGED = "job long, started long, last long, last_id long, last_event string, last_value double, stop_at long, exit_at long, exit_id long, code int, silent boolean, version long"
FIELDS = [c.split()[0] for c in CHANGED.split(", ")][1:]
#: Kept tables: what changes a job, and whether it has a timer. A log's number of buckets can't change after its first start.
TYPES = {"long": "Int64", "string": "object", "double": "Float64", "int": "Int32", "boolean": "boolean"}
KEPT = {name: TYPES[kind] for name, kind in (c.split() for c in CHANGED.split(", "))} | {"waits": "boolean"}
BUCKETS = 1024
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def typed(jobs: pd.DataFrame) -> pd.DataFrame:
    return jobs.reindex(columns=list(KEPT)).astype(KEPT)


def found_in(rows: pd.DataFrame) -> pd.DataFrame:
    """What lines (at in microseconds) say of their jobs, whatever the lines' order, by job."""
    rows = rows.sort_values(["job", "at", "event_id"], kind="stable")
    first, last = rows.drop_duplicates("job"), rows.drop_duplicates("job", keep="last").set_index("job")
    stops, exits = (rows[rows["event"] == e].drop_duplicates("job").set_index("job") for e in ("stop", "exit"))
    out = pd.DataFrame({"started": first.set_index("job")["at"], "last": last["at"], "last_id": last["event_id"], "last_event": last["event"], "last_value": last["value"], "stop_at": stops["at"].astype("Int64"), "exit_at": exits["at"].astype("Int64"), "exit_id": exits["event_id"].astype("Int64"), "code": exits["code"].astype("Int32")})
    return typed(out.rename_axis("job").reset_index()).set_index("job")


def folded(kept: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The jobs of rows, by job, as kept (by job) with more lines of theirs."""
    new = found_in(rows)
    old = kept.reindex(new.index).astype({k: v for k, v in KEPT.items() if k != "job"})

    def before(at: str, number: str) -> pd.Series:
        """Where the old one comes first; one that isn't there comes never."""
        there, other = old[at].notna(), new[at].isna()
        return there & (other | (old[at] < new[at]).fillna(False) | ((old[at] == new[at]) & (old[number] <= new[number])).fillna(False))

    newer = old["last"].isna() | (old["last"] < new["last"]).fillna(False) | ((old["last"] == new["last"]) & (old["last_id"] <= new["last_id"])).fillna(False)
    out = new.copy()
    for name in ("started", "stop_at"):
        out[name] = new[name].where(old[name].isna() | (new[name] < old[name]).fillna(False), old[name])
    for name in ("last", "last_id", "last_event", "last_value"):
        out[name] = new[name].where(newer, old[name])
    first = before("exit_at", "exit_id")
    for name in ("exit_at", "exit_id", "code"):
        out[name] = old[name].where(first, new[name])
    out["version"] = old["version"].fillna(0)
    return out


class Follower(StatefulProcessor):
    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("jobs", "jobs binary, timer long")

    def read(self) -> tuple[pd.DataFrame, int | None]:
        """The bucket's jobs and its timer."""
        if not self.kept.exists():
            return typed(pd.DataFrame({"job": []})).set_index("job"), None
        held, timer = self.kept.get()
        return typed(pa.ipc.open_stream(bytes(held)).read_pandas()).set_index("job"), timer

    def write(self, jobs: pd.DataFrame, timer: int | None) -> None:
        """Keeps the jobs, and one timer for the first that is due."""
        table = pa.Table.from_pandas(jobs.reset_index(), preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        waiting = jobs.loc[jobs["waits"], "last"]
        due = (int(waiting.min()) + self.silence) // 1000 if len(waiting) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.kept.update((out.getvalue().to_pybytes(), due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs, timer = self.read()
        touched = []
        for some in rows:
            changed = folded(jobs, some)
            touched.append(changed.index)
            jobs = pd.concat([jobs.drop(changed.index, errors="ignore"), changed])
        which = touched[0].append(touched[1:]).unique()
        changed = jobs.loc[which]
        due, open_ = (changed["last"] + self.silence) // 1000, changed["exit_at"].isna()
        on_time = due > timerValues.getCurrentWatermarkInMs()
        changed = changed.assign(silent=(open_ & ~on_time).astype("boolean"), waits=(open_ & on_time).astype("boolean"), version=changed["version"] + 1)
        self.write(pd.concat([jobs.drop(which), changed]), timer)
        yield shipped(changed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs, timer = self.read()
        over = jobs["waits"] & ((jobs["last"] + self.silence) // 1000 <= timerValues.getCurrentWatermarkInMs())
        changed = jobs[over].assign(silent=True, waits=False, version=jobs.loc[over, "version"] + 1)
        # The timer that has run out is deleted by Spark.
        self.write(typed(pd.concat([jobs[~over], changed]).reset_index()).set_index("job"), None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if len(changed):
            yield shipped(typed(changed.reset_index()).set_index("job"))

    def close(self) -> None:
        pass


def shipped(jobs: pd.DataFrame) -> pd.DataFrame:
    return jobs.reset_index()[["job", *FIELDS]]


def micros(at: str) -> Column:
    """Of a time without a zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {at})")


def follow(lines: DataFrame, path: str, checkpoint: str, silence: int = 3600, delay: str = "10 minutes") -> StreamingQuery:
    """Starts following a stream of log lines; every batch writes the jobs that it changed. silence is in seconds. Needs RocksDB state."""
    spark = lines.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    whole = lines.where("job is not null and event_id is not null and at is not null").select("job", "event_id", F.timestamp_micros(micros("at")).alias("seen"), micros("at").alias("at"), "event", "code", "value")
    changes = whole.withWatermark("seen", delay).withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(Follower(silence * 1_000_000), CHANGED, "Update", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.conf.set(*PROVIDER)
    try:
        return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def status(silent: Column) -> Column:
    """By exit code and requests: a request counts if it came before the exit."""
    asked = F.coalesce(F.col("stop_at") <= F.col("exit_at"), F.lit(False))
    done = F.when(F.col("code") == 0, F.when(asked, "stopped").otherwise("complete")).otherwise("failed")
    return F.when(F.col("exit_at").isNotNull(), done).when(silent, "ended").when(F.col("stop_at").isNotNull(), "stopping").otherwise("running")


def shown(jobs: DataFrame) -> DataFrame:
    signal = F.when(F.col("code") < 0, -F.col("code"))
    seconds = lambda a, b: (F.col(a) - F.col(b)) / 1_000_000
    return jobs.select("job", status(F.coalesce("silent", F.lit(False))).alias("status"), "code", signal.alias("signal"), F.col("last_event").alias("event"), F.col("last_value").alias("value"), seconds("last", "started").alias("seconds"), F.timestamp_micros("last").cast("timestamp").alias("last_seen"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The jobs as of their last change: a batch that was tried again has written the same changes to the same place."""
    rows = spark.read.schema(CHANGED).parquet(path)
    last = rows.groupBy("job").agg(F.max_by(F.struct(*FIELDS), "version").alias("s"))
    return shown(last.select("job", "s.*"))


def settled(lines: DataFrame, silence: int = 3600, delay: int = 600) -> DataFrame:
    """What following all lines comes to, in one batch. delay in seconds."""
    rows = lines.where("job is not null and event_id is not null and at is not null").withColumn("at", micros("at"))
    clock = rows.agg((F.max("at") - delay * 1_000_000).alias("clock"))
    at_exit, newest = F.when(F.col("event") == "exit", F.struct("at", "event_id", "code")), F.struct("at", "event_id", "event", "value")
    jobs = rows.groupBy("job").agg(F.min("at").alias("started"), F.max(newest).alias("n"), F.min(F.when(F.col("event") == "stop", F.col("at"))).alias("stop_at"), F.min(at_exit).alias("e"))
    jobs = jobs.select("job", "started", F.col("n.at").alias("last"), F.col("n.event").alias("last_event"), F.col("n.value").alias("last_value"), "stop_at", F.col("e.at").alias("exit_at"), F.col("e.code").alias("code"))
    silent = F.col("exit_at").isNull() & (F.floor((F.col("last") + silence * 1_000_000) / 1000) <= F.floor(F.col("clock") / 1000))
    return shown(jobs.join(F.broadcast(clock)).withColumn("silent", silent))  # one row
