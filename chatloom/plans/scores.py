"""Queries over predictions, evaluations, events and small configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators import events as E
from chatloom.operators import metrics as M
from chatloom.plans.registry import add, query
from chatloom.sources.readers import table

PRED = """(SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.lang END AS expected_tool, d.n_chars % 3 <> 0 AS attempted_tool, CASE WHEN d.n_chars % 3 <> 0 THEN CASE WHEN l.toxic = 1 THEN 'en' ELSE d.lang END END AS predicted_tool,
  d.source AS "condition", d.lang AS stratum, d.n_chars % 2 = 0 AS exact, d.n_chars % 5 <> 0 AS elastic, d.n_chars % 7 AS fields FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
COUNTS = """count(*) AS samples, count(*) FILTER (expected_tool IS NOT NULL) AS tool_rows, count(*) FILTER (expected_tool IS NULL) AS plain_rows, count(*) FILTER (expected_tool IS NOT NULL AND attempted_tool) AS tp,
  count(*) FILTER (expected_tool IS NULL AND NOT attempted_tool) AS tn, count(*) FILTER (predicted_tool = expected_tool) AS named, count(*) FILTER (expected_tool IS NOT NULL AND predicted_tool IS NOT NULL) AS parsed,
  count(*) FILTER (expected_tool IS NOT NULL AND exact) AS exact_rows, count(*) FILTER (expected_tool IS NOT NULL AND elastic) AS elastic_rows"""
RATES = """*, tool_rows - tp AS fn, plain_rows - tn AS fp, tp / greatest(1, tool_rows)::DOUBLE AS recall, tn / greatest(1, plain_rows)::DOUBLE AS specificity, (tp + tn) / greatest(1, samples)::DOUBLE AS accuracy,
  0.5 * (tp / greatest(1, tool_rows)::DOUBLE + tn / greatest(1, plain_rows)::DOUBLE) AS balanced, named / greatest(1, tool_rows)::DOUBLE AS named_accuracy, exact_rows / greatest(1, tool_rows)::DOUBLE AS exact_accuracy,
  elastic_rows / greatest(1, tool_rows)::DOUBLE AS elastic_accuracy, parsed / greatest(1, tool_rows)::DOUBLE AS parse_rate,
  CASE WHEN (tp + plain_rows - tn)::DOUBLE * tool_rows * plain_rows * (tn + tool_rows - tp) = 0 THEN 0.0 ELSE (tp::DOUBLE * tn - (plain_rows - tn)::DOUBLE * (tool_rows - tp)) / sqrt((tp + plain_rows - tn)::DOUBLE * tool_rows * plain_rows * (tn + tool_rows - tp)) END AS mcc"""
SHOWN = ["recall", "specificity", "accuracy", "balanced", "mcc"]


def pred(spark, sf) -> DataFrame:
    """A table of predictions made from labels and documents."""
    d, hit = table(spark, sf, "documents").drop("text"), F.col("n_chars") % 3 != 0
    rows = table(spark, sf, "labels").join(d, "doc_id")
    return rows.select(
        "doc_id", F.when(F.col("quality") == 1, F.col("lang")).alias("expected_tool"), hit.alias("attempted_tool"), F.when(hit, F.when(F.col("toxic") == 1, "en").otherwise(F.col("lang"))).alias("predicted_tool"),
        F.col("source").alias("condition"), F.col("lang").alias("stratum"), (F.col("n_chars") % 2 == 0).alias("exact"), (F.col("n_chars") % 5 != 0).alias("elastic"), (F.col("n_chars") % 7).alias("fields"),
    )


def rounded(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.round(n, 9).alias(n) for n in names])


def shown(names: list[str]) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def base(by: str) -> str:
    return f"(SELECT {RATES} FROM (SELECT {by + ', ' if by else ''}{COUNTS} FROM {PRED} p {'GROUP BY ' + by if by else ''}))"


@query(f"SELECT samples, tool_rows, plain_rows, tp, tn, {shown(SHOWN)} FROM {base('')}")
def routing_metrics(spark, sf):
    return rounded(M.scored(pred(spark, sf)), ["samples", "tool_rows", "plain_rows", "tp", "tn"], SHOWN)


SLICE = [*SHOWN, "named_accuracy", "exact_accuracy", "elastic_accuracy", "parse_rate"]


@query(f"""SELECT dimension, value, samples, {shown(SLICE)} FROM (SELECT 'condition' AS dimension, "condition" AS value, * FROM {base('"condition"')} UNION ALL BY NAME SELECT 'stratum' AS dimension, stratum AS value, * FROM {base('stratum')})""")
def routing_slices(spark, sf):
    return rounded(M.slices(pred(spark, sf), ["condition", "stratum"]), ["dimension", "value", "samples"], SLICE)


@query(f"SELECT expected_tool, count(*) AS expected, count(*) FILTER (predicted_tool = expected_tool) AS correct, count(*) FILTER (exact) AS whole, count(*) FILTER (elastic) AS tolerant FROM {PRED} WHERE expected_tool IS NOT NULL GROUP BY 1")
def per_tool_metrics(spark, sf):
    return pred(spark, sf).where("expected_tool is not null").groupBy("expected_tool").agg(F.count("*").alias("expected"), F.count_if(F.col("predicted_tool") == F.col("expected_tool")).alias("correct"), F.count_if("exact").alias("whole"), F.count_if("elastic").alias("tolerant"))


@query(f"SELECT coalesce(stratum, 'overall') AS category, count(*) AS total, round(avg(exact::INT), 4) AS strict, round(avg(elastic::INT), 4) AS tolerant FROM {PRED} GROUP BY ROLLUP (stratum)")
def category_rollup(spark, sf):
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias("strict" if c == "exact" else "tolerant")
    return pred(spark, sf).rollup("stratum").agg(F.count("*").alias("total"), rate("exact"), rate("elastic")).withColumn("category", F.coalesce("stratum", F.lit("overall"))).drop("stratum")


@query(f"""SELECT "condition" AS winner FROM {base('"condition"')} ORDER BY round(balanced, 9) DESC, round(exact_accuracy, 9) DESC, round(named_accuracy, 9) DESC, "condition" DESC LIMIT 1""")
def lexi_winner(spark, sf):
    key = F.struct(F.round("balanced", 9), F.round("exact_accuracy", 9), F.round("named_accuracy", 9), F.col("condition"))
    return M.scored(pred(spark, sf), "condition").agg(F.max_by("condition", key).alias("winner"))


@query(f"SELECT coalesce(a.stratum, b.stratum) AS category, a.n AS base_total, b.n AS new_total, coalesce(b.ok >= a.ok, false) AS passes, b.ok - a.ok AS delta FROM (SELECT stratum, count(*) AS n, count(*) FILTER (exact) AS ok FROM {PRED} WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT stratum, count(*) AS n, count(*) FILTER (exact) AS ok FROM {PRED} WHERE doc_id % 2 = 1 GROUP BY 1) b ON a.stratum = b.stratum")
def non_regression_gate(spark, sf):
    part = lambda k, name: pred(spark, sf).where(F.col("doc_id") % 2 == k).groupBy("stratum").agg(F.count("*").alias(f"{name}_total"), F.count_if("exact").alias(f"{name}_ok"))
    rows = part(0, "base").join(part(1, "new"), "stratum", "full")
    return rows.select(F.col("stratum").alias("category"), "base_total", "new_total", F.coalesce(F.expr("new_ok >= base_ok"), F.lit(False)).alias("passes"), F.expr("new_ok - base_ok").alias("delta"))


# Event logs and evaluations.


@query("SELECT run, suite, samples, event_id FROM (SELECT user_id AS run, event_type AS suite, floor(value)::BIGINT AS samples, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value)::BIGINT DESC, event_id % 2 DESC, ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_eval_per_run_suite(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("suite"), F.floor("value").alias("samples"), (F.col("event_id") % 2).alias("has_base"), F.col("ts").alias("evaluated_at"), F.col("event_id").alias("pos"))
    return E.best_per_run_suite(rows).select("run", "suite", "samples", F.col("pos").alias("event_id"))


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_event(spark, sf):
    return E.latest(table(spark, sf, "events").select("ts", "event_id", "event_type", "value", F.col("event_type").alias("kind")), "kind").select("event_type", "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def tail_events(spark, sf):
    return E.tail(table(spark, sf, "events"), 20).select("event_id", "event_type")


STATE_CASE = "CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'running' WHEN 'click' THEN 'stopping' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'ended' END"


@query(f"SELECT user_id, event_id, {STATE_CASE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def job_state(spark, sf):
    return E.states(table(spark, sf, "events"), "user_id").select("user_id", "event_id", "state")


@query(f"SELECT state, count(*) AS jobs, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT {STATE_CASE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) GROUP BY 1")
def event_phase(spark, sf):
    rows = E.states(table(spark, sf, "events"), "user_id").groupBy("state").agg(F.count("*").alias("jobs"))
    return rows.withColumn("percent", F.round(100.0 * F.col("jobs") / F.sum("jobs").over(Window.partitionBy(F.lit(0))), 6))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE n <= 300 OR rn % greatest(1, n // 300) = 0")
def stride_events(spark, sf):
    return E.strided(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 300).select("event_type", "event_id")


@query("SELECT s.event_type, CASE WHEN u.n IS NULL THEN 'UNOPENED' ELSE 'USED x' || u.n END AS badge FROM (SELECT DISTINCT event_type FROM events) s LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) u USING (event_type)")
def suite_usage(spark, sf):
    events = table(spark, sf, "events")
    used = events.where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))
    return events.select("event_type").distinct().join(used, "event_type", "left").select("event_type", F.when(F.col("n").isNull(), "UNOPENED").otherwise(F.concat(F.lit("USED x"), F.col("n").cast("string"))).alias("badge"))


@query(f"SELECT count(DISTINCT samples) AS sizes, count(DISTINCT (tool_rows, plain_rows)) AS pairs, count(DISTINCT (tool_rows, plain_rows)) = 1 AS uniform FROM {base('stratum')}")
def size_badges(spark, sf):
    pair = F.countDistinct(F.struct("tool_rows", "plain_rows"))
    return M.scored(pred(spark, sf), "stratum").agg(F.countDistinct("samples").alias("sizes"), pair.alias("pairs"), (pair == 1).alias("uniform"))


@query(f"WITH s AS (SELECT stratum, recall, specificity, balanced FROM {base('stratum')}) SELECT a.stratum, round((a.recall - b.recall + a.specificity - b.specificity + a.balanced - b.balanced) / 3, 9) AS average FROM s a, s b WHERE b.stratum = 'en'")
def avg_common_metric(spark, sf):
    rows = M.scored(pred(spark, sf), "stratum").selectExpr("stratum", "stack(3, 'recall', recall, 'specificity', specificity, 'balanced', balanced) as (metric, x)")
    first = rows.where("stratum = 'en'").select("metric", F.col("x").alias("b"))
    return rows.join(first, "metric").where("x is not null and b is not null").groupBy("stratum").agg(F.round(F.avg(F.col("x") - F.col("b")), 9).alias("average"))


@query("SELECT c_custkey AS run, coalesce(n_name, 'legacy / unsaved') AS sheet, o_orderkey AS evaluation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey")
def run_comparison(spark, sf):
    """Every run once for each of its evaluations, or once without; a run without a known sheet gets the default label."""
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("key"))
    sheets = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("sheet"))
    return E.compared(runs, sheets, table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("evaluation"))).select("run", "sheet", "evaluation")


@query("SELECT s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS updated FROM supplier")
def registry_upsert(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    old, new = rows.where("id % 3 <> 0").select("id", F.col("name").alias("was")), rows.where("id % 2 = 0 or id % 3 = 0")
    return old.join(new, "id", "full").select("id", F.coalesce("name", "was").alias("name"), F.col("name").isNotNull().alias("updated"))


@query(f"SELECT stratum, rank, fitness FROM (SELECT stratum, row_number() OVER (ORDER BY round(balanced, 9) DESC, stratum) AS rank, round(balanced, 9) AS fitness, count(*) OVER () AS n FROM {base('stratum')}) WHERE rank <= greatest(2, ceil(n / 2.0))")
def survivors(spark, sf):
    rows = M.scored(pred(spark, sf), "stratum").select("stratum", F.round("balanced", 9).alias("fitness"))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fitness"), "stratum")).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return rows.where("rank <= greatest(2, ceil(n / 2))").select("stratum", "rank", "fitness")


# Dependencies, grids and small rules.

@query("SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 16 / sqrt(p_size) ELSE 16.0 / p_size END, 9) AS scale FROM part")
def lora_scale(spark, sf):
    """An adapter's scale by its rank, or by the rank's square root."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("r"), (F.col("p_partkey") % 2 == 0).alias("s"))
    return rows.select("p_partkey", F.round(F.when(F.col("s"), 16 / F.sqrt("r")).otherwise(16 / F.col("r")), 9).alias("scale"))


# Tokens, turns and dialogues.

@query("SELECT min(turn) AS first_turn, max(turn) AS last_turn, conv_id, role FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, role, island")
def role_runs(spark, sf):
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumn("change", F.coalesce((F.col("role") != F.lag("role").over(by)).cast("int"), F.lit(0))).withColumn("run", F.sum("change").over(by))
    return rows.groupBy("conv_id", "role", "run").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")).drop("run")
