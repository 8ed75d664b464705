"""Queries that write to and read from stores: what comes back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom import api
from chatloom.operators import events as E
from chatloom.plans.registry import query
from chatloom.sources import headers
from chatloom.sources import readers as R
from chatloom.sources import stores as W
from chatloom.sources.readers import table
from chatloom.sources.sealed import Sealed
from chatloom.sources.shared import shared_path
from chatloom.sources.versions import Documents


@query("SELECT s_suppkey, s_name, s_acctbal, 'written once' AS state FROM supplier")
def jsonl_roundtrip(spark, sf):
    """JSON lines that are written a second time only if they differ."""
    path, rows = shared_path(spark, "lines"), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    wrote = [W.write_lines(rows, path), W.write_lines(rows, path, frozen=True)]
    return W.read_lines(spark, path, rows.schema, "s_suppkey").withColumn("state", F.lit("written once" if wrote == [True, False] else "wrong"))


@query("SELECT n_nationkey::VARCHAR AS a, n_name AS b, NULL AS c FROM nation UNION ALL SELECT r_regionkey::VARCHAR, NULL, r_name FROM region")
def csv_union_roundtrip(spark, sf):
    path = shared_path(spark, "csv")
    R.union_csv([table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")), table(spark, sf, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("c"))], path)
    return spark.read.csv(path, header=True)


@query("SELECT p_brand AS split, p_partkey, p_name FROM part")
def split_files(spark, sf):
    path = shared_path(spark, "splits")
    W.write_splits(table(spark, sf, "part").select(F.col("p_brand").alias("split"), "p_partkey", "p_name"), "split", path)
    return spark.read.parquet(path).select(F.col("split").cast("string").alias("split"), "p_partkey", "p_name")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own/data' || page_id END AS dataset, CASE WHEN page_id % 2 = 0 THEN 'dir/' || page_id || '.parquet' END AS file FROM pages")
def hosted_sources(spark, sf):
    source = F.expr("if(page_id % 2 = 0, 'hf-file:own/data' || page_id || '::dir/' || page_id || '.parquet', url)")
    return table(spark, sf, "pages").select("page_id", W.hosted(source).alias("h")).select("page_id", "h.*")


def written_scores(spark, sf) -> str:
    """A file of scores for each source: its counts, then its cases."""
    root = shared_path(spark, "scores")
    rows = table(spark, sf, "documents").select(F.concat(F.when(F.col("source") == "src1", "memory_").otherwise("live_"), "source").alias("category"), (F.col("n_chars") % 2 == 0).alias("valid"))
    sums = rows.groupBy("category").agg(F.count("*").alias("total_count"), F.count_if("valid").alias("correct_count"))
    scores = sums.select(F.concat(F.lit("sub/BFCL_v4_"), "category", F.lit("_score.json")).alias("path"), F.concat(F.lit("\n"), F.to_json(F.struct("total_count", "correct_count")), F.lit('\n{"id": "x", "valid": true}\n')).alias("content"))
    others = [("BFCL_v4_broken_score.json", "oops\n"), ("data_overall.csv", "Rank,Model,Acc\n1,a,90\n"), ("other.csv", 'Model,Note\nb,"x, y"\n')]
    W.write_files(scores.unionByName(spark.createDataFrame(others, "path string, content string")), root)
    return root


@query("SELECT CASE WHEN source = 'src1' THEN 'memory_' ELSE 'live_' END || source AS category, CASE WHEN source = 'src1' THEN 'agentic' ELSE 'live' END AS family, count(*) AS total, count_if(n_chars % 2 = 0)::BIGINT AS correct, round(count_if(n_chars % 2 = 0) / count(*), 9) AS accuracy FROM documents GROUP BY ALL")
def category_score_files(spark, sf):
    return W.category_scores(spark, written_scores(spark, sf), "v4", needed=True).select("category", "family", "total", "correct", F.round("accuracy", 9).alias("accuracy"))


@query("SELECT * FROM (VALUES ('data_overall.csv', 'Acc', '90'), ('data_overall.csv', 'Model', 'a'), ('data_overall.csv', 'Rank', '1'), ('other.csv', 'Model', 'b'), ('other.csv', 'Note', 'x, y')) t(file, name, value)")
def score_summaries(spark, sf):
    return W.score_summary(spark, written_scores(spark, sf)).select("file", F.explode("row").alias("name", "value"))


@query("SELECT 1 + 2 * count(DISTINCT source) AS n FROM documents")
def generated_case_count(spark, sf):
    return W.case_count(spark, written_scores(spark, sf))


@query("SELECT count_if(n_chars % 4 < 2)::BIGINT AS retained, count_if(n_chars % 4 >= 2)::BIGINT AS retry FROM documents")
def seed_results(spark, sf):
    path = shared_path(spark, "results")
    line = "case n_chars % 4 when 0 then '{\"id\": \"' || doc_id || '\", \"result\": [\"ok\"]}' when 1 then '{\"id\": \"' || doc_id || '\", \"result\": \"fine\"}' when 2 then '{\"id\": \"' || doc_id || '\", \"result\": \"Error during inference: x\"}' else '{\"id\": ' end"
    table(spark, sf, "documents").selectExpr(f"{line} as value").write.text(path)
    target = shared_path(spark, "seeded")
    renamed(spark, path, target, "jsonl")
    good, report = W.seeded_results(spark, target)
    return report.agg(F.sum("retained").alias("retained"), F.sum("retry").alias("retry"))


@query("SELECT s_suppkey + 1 AS id, s_name AS name, s_suppkey % 2 = 0 AS changed FROM supplier WHERE s_suppkey % 7 <> 0")
def registry_store(spark, sf):
    """Rows put in, half of them changed, some deleted: ids stay with their keys."""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("new").alias("status"), (F.col("s_suppkey") % 2 == 0).alias("even"), F.col("s_suppkey").alias("k"))
    store = W.Registry(spark, shared_path(spark, "registry"), "name", "status string")
    store.upsert(rows.select("name", "status"))
    store.upsert(rows.where("even").select("name", F.lit("again").alias("status")))
    store.delete(rows.where("k % 7 = 0").select("name"))
    return store.newest().select("id", "name", (F.col("status") == "again").alias("changed"))


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 5")
def newest_documents(spark, sf):
    """Of JSON documents, a file each, the newest by the time that they name; one is broken."""
    target, rows = shared_path(spark, "documents"), table(spark, sf, "part")
    time = F.concat(F.lit("2024-01-"), F.lpad("p_size", 2, "0"), F.lit("T"), F.lpad("p_partkey", 12, "0"))
    one = rows.select(F.format_string("d%d/%d.json", F.col("p_partkey") % 8, F.col("p_partkey")).alias("path"), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), time.alias("updated_at"))).alias("content"))
    W.write_files(one.unionByName(spark.createDataFrame([("broken.json", '{"id": ')], "path string, content string")), target)
    return W.listed(spark, target, "id long, name string, updated_at string", "updated_at").select("id", "name").limit(5)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'again' ELSE 'new' END AS status, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size, (SELECT count(*) FROM part) AS at_first FROM part WHERE p_partkey % 5 <> 0""")
def document_store(spark, sf):
    """Rows put in a store of commits, some replaced by their ids, some deleted, all made one; and how many there were at the first commit."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("new").alias("status"), F.col("p_size").cast("long").alias("size"))
    store = Documents(spark, shared_path(spark, "documents"), "id", "id long, status string, size long")
    first = store.put(rows, new=True)
    store.put(rows.where("id % 3 = 0").select("id", F.lit("again").alias("status"), (F.col("size") + 1).alias("size")))
    store.delete(rows.where("id % 5 = 0"))
    store.compact()
    return store.read().join(F.broadcast(store.read(first).agg(F.count("*").alias("at_first"))))  # one row


@query("""WITH d AS (SELECT source, lang || chr(9) || text AS h FROM documents WHERE text <> ''), s AS (SELECT DISTINCT h FROM d WHERE source IN ('src3', 'src7'))
  SELECT source, count(*) AS examples, count_if(h IN (SELECT h FROM s))::BIGINT AS sealed, (SELECT count(*) FROM d WHERE source IN ('src3', 'src7')) AS suite_rows, (SELECT count(DISTINCT (source, h)) FROM d WHERE source IN ('src3', 'src7')) AS suite_hashes FROM d GROUP BY source""")
def sealed_store(spark, sf):
    """Two sources are registered as sealed suites; the guard tells of every source how many of its examples they hold."""
    root = shared_path(spark, "suites")
    docs, store = table(spark, sf, "documents").select("source", F.col("lang").alias("instruction"), F.col("text").alias("output")), Sealed(spark, f"{root}/store")
    for source in ("src3", "src7"):
        docs.where(F.col("source") == source).drop("source").write.parquet(f"{root}/{source}")
        store.register(f"{root}/{source}", source, max_rows=None)
    docs.write.parquet(f"{root}/all")
    rows = api.normalized(spark.read.parquet(f"{root}/all").select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in docs.columns else F.col(f.name) for f in spark.createDataFrame([], api.RECORD).schema], F.col("source").alias("group_id")))
    hits = store.hits(rows).groupBy("group_id").agg(F.count("*").alias("hits"))
    known = store.suites().agg(F.sum("n").alias("suite_rows"), F.sum("distinct_n").alias("suite_hashes"))
    out = rows.groupBy("group_id").agg(F.count("*").alias("examples")).join(hits, "group_id", "left").join(F.broadcast(known))  # one row
    return out.select(F.col("group_id").alias("source"), "examples", F.coalesce("hits", F.lit(0)).alias("sealed"), "suite_rows", "suite_hashes")


def written_tensors(spark, sf) -> str:
    """Tensor files of all parts, at most 1000 in one: a length, JSON and some bytes."""
    root = shared_path(spark, "tensors")
    one = F.struct(F.concat(F.lit("m."), F.col("p_partkey")).alias("k"), F.struct(F.lit("F32").alias("dtype"), F.array(F.col("p_size"), F.lit(4)).alias("shape"), F.array(F.lit(0), F.lit(0)).alias("data_offsets")).alias("v"))
    bare = F.expr("substring(to_json(named_struct('m', e)), 6)")  # of a map, without what stands around it
    heads = table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.map_from_entries(F.collect_list(one)).alias("e"))  # at most 1000 a file
    text = F.concat(F.lit('{"__metadata__": {"format": "pt"}, '), F.regexp_replace(bare, r"^\{|\}$", ""))
    size = F.octet_length(text)
    prefix = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)], F.lit("00000000")))
    made = heads.select(F.concat(F.lit("checkpoint-1/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("-"), F.col("part"), F.lit(".safetensors")).alias("path"), F.concat(prefix, text.cast("binary"), F.unhex(F.repeat(F.lit("00"), 64))).alias("content"))
    W.write_files(made, root)
    return root


TENSORS = "SELECT 'm.' || p_partkey AS name, 'F32' AS dtype, p_size::BIGINT AS x, 4::BIGINT AS y FROM part"


def shapes(headers: DataFrame) -> DataFrame:
    return headers.select("name", "dtype", F.get("shape", F.lit(0)).alias("x"), F.get("shape", F.lit(1)).alias("y"))


@query(TENSORS)
def tensor_headers(spark, sf):
    """The headers of files that a table names; what follows them isn't read."""
    root = written_tensors(spark, sf)
    paths = W.files(spark, root, "*.safetensors")
    whole = paths.agg(F.sum("length").alias("all")).join(W.checkpoint_bytes(spark, root)).where("all = bytes")  # one row each
    return shapes(W.tensor_headers(paths.join(F.broadcast(whole))))


@query(TENSORS)
def tensor_header_source(spark, sf):
    """The same as a data source, a partition a file."""
    headers.register(spark)
    return shapes(spark.read.format("tensor_headers").load(written_tensors(spark, sf)))


@query("SELECT count(*) AS row_count, 'doc_id,lang,source' AS columns, count_if(doc_id % 50 = 0)::BIGINT AS secret_hits FROM documents")
def inspect_dataset(spark, sf):
    path = shared_path(spark, "inspect")
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 50 == 0, "sk_" + "a1" * 12).otherwise(F.col("source")).alias("source"))
    rows.select(F.to_json(F.struct("doc_id", "lang", "source")).alias("value")).write.format("text").option("lineSep", "\n").save(path)
    target = shared_path(spark, "dataset")
    renamed(spark, path, target, "jsonl")
    return W.inspected(spark, target, limit=None).select("row_count", F.array_join("columns", ",").alias("columns"), "secret_hits")


def renamed(spark, source: str, target: str, suffix: str) -> None:
    """Moves a folder's part files to another one under names with this suffix."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target))
    for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(source)):
        if s.getPath().getName().startswith("part-"):
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(f"{target}/{s.getPath().getName().split('.')[0]}.{suffix}"))


@query("SELECT '| ' || source || ' | ' || count(*) || ' | ' || printf('%.2f%%', 100 * avg((n_chars % 2 = 0)::INT)) || ' | N/A |' AS line FROM documents GROUP BY source")
def report_table(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") % 2 == 0).cast("int")).alias("accuracy"), F.lit(None).cast("string").alias("note"))
    return W.markdown_lines(rows)


# Progress.


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE ts >= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) AND event_id % 7 <> 0 ORDER BY event_id DESC LIMIT 20")
def recent_events(spark, sf):
    """The last lines of a log, malformed ones dropped after that, and of those since a cutoff the newest twenty."""
    rows = table(spark, sf, "events")
    lines = rows.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct("event_id", "event_type", "ts"))).alias("line"))
    since = rows.agg((F.max("ts") - F.expr("interval 2 hours")).alias("since"))
    tail = E.read_tail(lines, "event_id", "line", 500, "event_id long, event_type string, ts timestamp_ntz")
    return tail.join(F.broadcast(since)).where("ts >= since").orderBy(F.desc("event_id")).limit(20).select("event_id", "event_type")  # one row


@query("SELECT minute, n, upto, round(upto / total, 9) AS fraction, round(CASE WHEN upto > 0 THEN elapsed * (1 - upto / total) / (upto / total) END, 6) AS eta FROM (SELECT minute, n, sum(n) OVER (ORDER BY minute)::BIGINT AS upto, sum(n) OVER () AS total, (epoch(minute) - epoch(min(minute) OVER ()))::DOUBLE AS elapsed FROM (SELECT date_trunc('hour', ts) AS minute, count(*) AS n FROM events GROUP BY 1))")
def running_progress(spark, sf):
    """How much is done hour by hour, and the time that the rest would take."""
    rows = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))
    return E.progress(rows, "minute", "n").select("minute", "n", "upto", F.round("fraction", 9).alias("fraction"), F.round("eta", 6).alias("eta"))


PHASES = {"signup": "Loading model", "view": "Preparing dataset", "click": "Training", "purchase": "Complete"}


@query("SELECT user_id, event_type AS event, CASE event_type WHEN 'signup' THEN 'Loading model' WHEN 'view' THEN 'Preparing dataset' WHEN 'click' THEN 'Training' WHEN 'purchase' THEN 'Complete' ELSE 'Working' END AS phase, round(100 * least(1.0, value / 100), 2) AS percent FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def event_phases(spark, sf):
    rows = E.phases(E.latest(table(spark, sf, "events"), "user_id"), PHASES, "Working")
    return rows.select("user_id", F.col("event_type").alias("event"), "phase", F.round(100 * F.least(F.lit(1.0), F.col("value") / 100), 2).alias("percent"))


@query("""SELECT s_suppkey AS pid, CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'stopping' ELSE 'running' END WHEN s_suppkey % 4 = 1 THEN CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'stopped' ELSE 'complete' END ELSE 'failed' END
  WHEN s_suppkey % 4 = 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'running' ELSE 'ended' END ELSE 'complete' END AS status FROM supplier""")
def job_transitions(spark, sf):
    """A job's next state by whether it is ours, whether it ended and how, whether it was asked to stop, and whether it is still alive."""
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey as pid", "s_suppkey % 4 in (0, 1) as ours", "if(s_suppkey % 4 = 1, if(s_nationkey % 3 = 0, 0, -9), null) as exit_code", "s_nationkey % 2 = 0 as stop_requested", "if(s_suppkey % 4 = 3, 'complete', 'running') as status", "s_suppkey % 3 = 0 as alive")
    return rows.select("pid", E.next_state().alias("status"))


@query("SELECT state, count(*) AS jobs FROM (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'click' THEN 'stopping' ELSE 'running' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def streamed_job_states(spark, sf):
    """The event table as a stream: the newest state of each job in update mode, put together batch by batch."""
    from chatloom.streaming import logs

    path = shared_path(spark, "log")
    table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(3, "event_id").write.json(path)
    states = shared_path(spark, "states")
    logs.job_states(logs.read_log(spark, path, 1), states, shared_path(spark, "stream")).awaitTermination(600)
    return logs.current_states(spark, states).groupBy("state").agg(F.count("*").alias("jobs"))


LINE = ["user_id as job", "event_id", "ts as at", "case event_type when 'signup' then 'start' when 'click' then 'stop' when 'view' then 'beat' else 'exit' end as event", "case event_type when 'purchase' then 0 when 'error' then -9 end as code", "value"]


def slices(rows: DataFrame, at: str, many: int) -> list[DataFrame]:
    """rows parted by a time in as many equal spans; those without one come last."""
    ends = rows.agg(F.min(at).cast("timestamp").cast("double").alias("a"), F.max(at).cast("timestamp").cast("double").alias("b")).head()
    span = F.least(F.lit(many - 1), F.floor((F.col(at).cast("timestamp").cast("double") - F.lit(ends.a)) / F.lit((ends.b - ends.a) / many + 1e-6)))
    return [rows.where(F.coalesce(span, F.lit(many - 1)) == k) for k in range(many)]


@query("""SELECT job, CASE WHEN exit_at IS NOT NULL THEN CASE WHEN code <> 0 THEN 'failed' WHEN stop_at <= exit_at THEN 'stopped' ELSE 'complete' END WHEN last <= clock - INTERVAL 5 DAY THEN 'ended' WHEN stop_at IS NOT NULL THEN 'stopping' ELSE 'running' END AS status, code, CASE WHEN code < 0 THEN -code END AS signal, event, value,
  (epoch_us(last) - epoch_us(started)) / 1000000 AS seconds FROM (SELECT user_id AS job, min(ts) AS started, max(ts) AS last, arg_max(CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'stop' WHEN 'view' THEN 'beat' ELSE 'exit' END, (ts, event_id)) AS event, arg_max(value, (ts, event_id)) AS value,
    min(ts) FILTER (event_type = 'click') AS stop_at, min(ts) FILTER (event_type IN ('purchase', 'error')) AS exit_at, arg_min(CASE event_type WHEN 'purchase' THEN 0 ELSE -9 END, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS code FROM events GROUP BY user_id), (SELECT max(ts) - INTERVAL 10 MINUTE AS clock FROM events)""")
def streamed_job_transitions(spark, sf):
    """The event table as job logs, followed as a stream in four batches over two starts; a job that is silent for five days has ended."""
    from chatloom.streaming import jobs

    log, out, checkpoint = (shared_path(spark, name) for name in ("joblog", "jobs", "jobstream"))
    rows = table(spark, sf, "events").selectExpr(*LINE)
    for number, part in enumerate(slices(rows, "at", 4)):
        part.repartition(2, "event_id").write.mode("append").parquet(log)
        if number % 2:
            jobs.follow(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(log), out, checkpoint, silence=5 * 86400).awaitTermination()
    return jobs.current(spark, out).drop("last_seen")


def appended_clicks(spark, sf) -> str:
    """Clicks as results of cases, by arrival: a stream takes two of four parts, is started again for the others and gets the first part once more."""
    from chatloom.streaming import results

    log, out, checkpoint = (shared_path(spark, name) for name in ("clicklog", "clicks", "clickstream"))
    rows = table(spark, sf, "clicks").select("click_id", "arrived_at", "kind", "value")
    parts = slices(rows, "arrived_at", 4)
    for number, part in enumerate([*parts, parts[0]]):
        part.repartition(2, "click_id").write.mode("append").parquet(log)
        if number in (1, 4):
            results.append_once(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(log), out, checkpoint, "click_id", ["arrived_at", "kind", "value"]).awaitTermination()
    return out


ONCE = "SELECT click_id, arrived_at, kind, value FROM clicks WHERE click_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS LAST, kind NULLS LAST, value NULLS LAST) = 1"


@query(ONCE)
def streamed_results(spark, sf):
    """Each case once, however often the stream is started again or brings it."""
    return spark.read.parquet(appended_clicks(spark, sf)).select("click_id", "arrived_at", "kind", "value")


@query(f"""SELECT kind, done, total, share, round(elapsed, 6) AS elapsed, round(elapsed * (1 - share) / share, 6) AS eta FROM (SELECT kind, done, total, least(1.0, done / total)::DOUBLE AS share, (epoch_us(b) - epoch_us(a)) / 1000000 AS elapsed
  FROM (SELECT kind, count(*) AS done, min(arrived_at) AS a, max(arrived_at) AS b FROM ({ONCE}) GROUP BY kind) JOIN (SELECT kind, count(*) AS total FROM clicks GROUP BY kind) USING (kind))""")
def streamed_progress(spark, sf):
    """Of the cases appended, followed as a stream: how many of those planned by kind, and how long the rest will take."""
    from chatloom.streaming import results

    store, out = appended_clicks(spark, sf), shared_path(spark, "progress")
    rows = table(spark, sf, "clicks").where("kind is not null")
    stream = spark.readStream.schema(spark.read.parquet(store).schema).parquet(store).where("kind is not null")
    results.progress(stream, rows.groupBy("kind").agg(F.count("*").alias("total")), out, shared_path(spark, "progressstream"), "kind", "arrived_at").awaitTermination()
    return results.current(spark, out, "kind").withColumns({c: F.round(c, 6) for c in ("elapsed", "eta")})
