"""Queries that compare, gate and audit evaluations. Predictions are made from all labels and their documents."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.operators import metrics as M
from chatloom.operators import tables as T
from chatloom.plans.registry import add, query
from chatloom.plans.scores import base, pred, shown
from chatloom.sources.readers import table

#: One row a prediction; the same text in both dialects.
FULL = """SELECT d.doc_id, d.doc_id % 3 AS run, d.lang AS category, d.source AS slot, CASE WHEN l.quality = 1 THEN d.lang END AS expected_tool, d.n_chars % 3 <> 0 AS attempted, CASE WHEN d.n_chars % 3 <> 0 THEN CASE WHEN l.toxic = 1 THEN 'en' ELSE d.lang END END AS predicted_tool,
  d.n_chars % 2 = 0 AS exact, d.n_chars % 2 = 0 OR d.n_chars % 9 = 0 AS required_exact, d.n_chars % 2 = 0 OR d.n_chars % 7 = 0 AS required_normalized, d.n_chars % 5 <> 0 AS elastic, d.n_chars % 4 <> 0 AS keys_right, d.n_chars % 13 <> 0 AS valid, d.n_chars % 11 <> 0 AS format_right, d.n_chars % 4 AS n_calls, 1 + d.doc_id % 2 AS n_expected,
  length(trim(d.text)) > 40 AS answered, d.n_chars % 17 = 0 AS answer_exact, d.doc_id % 2 = 0 AS has_terms, d.n_chars % 6 <> 0 AS terms_right FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
TOOL, PLAIN = "expected_tool IS NOT NULL", "expected_tool IS NULL"
RIGHT = "coalesce(predicted_tool = expected_tool, false)"
#: name: (what counts, of what).
RATES = {
    "format_valid": ("valid", "true"), "decision_accuracy": (f"({TOOL}) = attempted", "true"), "tool_recall": (f"{TOOL} AND attempted", TOOL), "specificity": (f"{PLAIN} AND NOT attempted", PLAIN), "tool_name_accuracy": (f"{TOOL} AND {RIGHT}", TOOL),
    "parse_rate": (f"{TOOL} AND predicted_tool IS NOT NULL", TOOL), "keys_accuracy": (f"{TOOL} AND {RIGHT} AND keys_right", TOOL), "whole_exact": (f"{TOOL} AND {RIGHT} AND exact", TOOL), "required_exact_rate": (f"{TOOL} AND {RIGHT} AND required_exact", TOOL),
    "required_normalized_rate": (f"{TOOL} AND {RIGHT} AND required_normalized", TOOL), "required_elastic_rate": (f"{TOOL} AND {RIGHT} AND elastic", TOOL), "call_count_exact": (f"{TOOL} AND n_calls = n_expected", TOOL), "multi_call_rate": (f"{TOOL} AND n_calls > 1", TOOL),
    "no_call_rate": (f"{TOOL} AND n_calls = 0", TOOL), "expected_format": ("format_right", "true"), "expected_format_tool": (f"{TOOL} AND format_right", TOOL), "expected_format_plain": (f"{PLAIN} AND format_right", PLAIN), "false_call_rate": (f"{PLAIN} AND attempted", PLAIN),
    "nonempty_answers": (f"{PLAIN} AND answered", PLAIN), "answer_exact_rate": (f"{PLAIN} AND answer_exact", PLAIN), "direct_criteria": (f"{PLAIN} AND has_terms AND NOT attempted AND terms_right", f"{PLAIN} AND has_terms"), "given_a_tool": (TOOL, "true"),
    "task_success": (f"CASE WHEN {TOOL} THEN {RIGHT} AND required_exact ELSE NOT attempted AND (CASE WHEN has_terms THEN terms_right ELSE answered END) END", "true"),
    "task_success_strict": (f"CASE WHEN {TOOL} THEN {RIGHT} AND exact ELSE NOT attempted AND (CASE WHEN has_terms THEN terms_right ELSE answered END) END", "true"),
    "task_success_elastic": (f"CASE WHEN {TOOL} THEN {RIGHT} AND elastic ELSE NOT attempted AND (CASE WHEN has_terms THEN terms_right ELSE answered END) END", "true"),
}
DUCK_RATES = ", ".join(f"count_if({a}) / greatest(1, count_if({b})) AS {n}" for n, (a, b) in RATES.items())


def full(spark, sf) -> DataFrame:
    return spark.sql(FULL.replace("labels l", "{l} l").replace("documents d", "{d} d"), l=table(spark, sf, "labels"), d=table(spark, sf, "documents"))


def rounded(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.round(n, 9).alias(n) for n in names])


@query(f"SELECT samples, {shown(list(RATES))} FROM (SELECT count(*) AS samples, {DUCK_RATES} FROM ({FULL}))")
def global_rates(spark, sf):
    return rounded(T.rates(full(spark, sf), RATES), ["samples"], list(RATES))


@query(f"WITH m AS (SELECT run, {DUCK_RATES} FROM ({FULL}) GROUP BY run), u AS (UNPIVOT m ON {', '.join(RATES)} INTO NAME metric VALUE x) SELECT a.run, a.metric, round(coalesce(a.x, 0) - coalesce(b.x, 0), 9) AS delta FROM u a LEFT JOIN u b ON b.run = 0 AND b.metric = a.metric")
def base_adapter_delta(spark, sf):
    """All rates of every run less those of run 0."""
    return T.deltas(T.rates(full(spark, sf), RATES, "run"), "run", 0, list(RATES)).select("run", "metric", F.round("delta", 9).alias("delta"))


GROUPS = {"multi": ["fr", "de"], "rehearsal": ["es"], "polyglot": ["de"]}
V13 = {"strict": 0.35, "balanced": 0.15, "mcc_scaled": 0.10, "multi": 0.20, "expected_format": 0.10, "rehearsal": 0.10, "guard": 0.05, "gap": -0.10}
V14 = {"strict": 0.30, "polyglot": 0.20, "multi": 0.15, "balanced": 0.15, "mcc_scaled": 0.10, "expected_format": 0.10, "guard": 0.05, "gap": -0.10}


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


FITNESS_TERMS = {
    "strict": (f"{TOOL} AND exact", TOOL), "elastic_rate": (f"{TOOL} AND elastic", TOOL), "expected_format": ("format_right", "true"), "recall": (f"{TOOL} AND attempted", TOOL), "plain_right": (f"{PLAIN} AND NOT attempted", PLAIN),
    **{name: (f"category IN ({listed(v)}) AND {RATES['task_success_strict'][0]}", f"category IN ({listed(v)})") for name, v in GROUPS.items()},
}
COUNTED = f"count_if({TOOL} AND attempted)::DOUBLE AS tp, count_if({PLAIN} AND NOT attempted)::DOUBLE AS tn, count_if({PLAIN} AND attempted)::DOUBLE AS fp, count_if({TOOL} AND NOT attempted)::DOUBLE AS fn"
MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END"


def fitness_terms(rows: DataFrame, by: str) -> DataFrame:
    """What the fitness functions weigh, for each run."""
    counted = [F.expr(f"cast(count_if({c}) as double)").alias(n) for n, c in (("tp", f"{TOOL} AND attempted"), ("tn", f"{PLAIN} AND NOT attempted"), ("fp", f"{PLAIN} AND attempted"), ("fn", f"{TOOL} AND NOT attempted"))]
    out = rows.groupBy(by).agg(*[T.share(a, b).alias(n) for n, (a, b) in FITNESS_TERMS.items()], *counted)
    out = out.withColumn("balanced", 0.5 * (F.col("recall") + F.col("plain_right"))).withColumn("mcc_scaled", (F.expr(MCC) + 1.0) / 2.0)
    return out.withColumn("gap", F.greatest(F.lit(0.0), F.col("elastic_rate") - F.col("strict"))).withColumn("guard", F.least("balanced", "expected_format", "rehearsal"))


def fitness_sql(weights: dict[str, float]) -> str:
    terms = ", ".join(f"count_if({a}) / greatest(1, count_if({b})) AS {n}" for n, (a, b) in FITNESS_TERMS.items())
    total = " + ".join(f"{w}::DOUBLE * {n}" for n, w in weights.items())
    return f"""SELECT run, round({total}, 9) AS fitness, round(gap, 9) AS gap, round(guard, 9) AS guard FROM (SELECT *, greatest(0.0, elastic_rate - strict) AS gap, least(balanced, expected_format, rehearsal) AS guard FROM (SELECT *, 0.5::DOUBLE * (recall + plain_right) AS balanced, ({MCC} + 1) / 2 AS mcc_scaled FROM (SELECT run, {terms}, {COUNTED} FROM ({FULL}) GROUP BY run)))"""


def fitness(weights):
    def run(spark, sf):
        rows = fitness_terms(full(spark, sf), "run").withColumn("fitness", T.weighted(weights))
        return rounded(rows, ["run"], ["fitness", "gap", "guard"])
    return run


add("fitness_v13", fitness(V13), fitness_sql(V13))
add("fitness_v14", fitness(V14), fitness_sql(V14))


def objective(score, trials: DataFrame) -> DataFrame:
    """Trials with what a scoring callback makes of them, best first: score takes and gives DataFrames, so any plan can be one."""
    return score(trials).orderBy(F.desc("fitness"))


@query(f"SELECT run AS champion FROM ({fitness_sql(V14)}) ORDER BY fitness DESC, run DESC LIMIT 1")
def champion_run(spark, sf):
    best = objective(lambda rows: fitness_terms(rows, "run").withColumn("fitness", F.round(T.weighted(V14), 9)), full(spark, sf))
    return T.best_by(best, "run", "fitness", "run").select(F.col("winner").alias("champion"))


@query("SELECT o_orderpriority AS gene, round(0.7 * avg(s) + 0.3 * min(s) - 0.15 * stddev_pop(s), 6) AS robust, round(avg(s), 6) AS mean, min(s) AS worst, round(stddev_pop(s), 6) AS std FROM (SELECT o_orderpriority, o_custkey % 2 AS seed, round(avg(o_totalprice::DOUBLE), 6) AS s FROM orders GROUP BY ALL) GROUP BY 1")
def dual_seed(spark, sf):
    scores = table(spark, sf, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 2).alias("seed")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 6).alias("s"))
    return T.dual_seed(scores, "o_orderpriority", "s").select(F.col("o_orderpriority").alias("gene"), *[F.round(c, 6).alias(c) for c in ("robust", "mean")], "worst", F.round("std", 6).alias("std"))


SCORE = "0.30::DOUBLE * balanced + 0.15::DOUBLE * specificity + 0.15::DOUBLE * recall + 0.20::DOUBLE * named_accuracy + 0.20::DOUBLE * exact_accuracy"


@query(f"""WITH c AS (SELECT *, {SCORE} AS score FROM {base('"condition"')}), p AS (SELECT *, specificity >= 0.60 AND recall >= 0.85 AND balanced >= 0.70 AND mcc > 0 AND named_accuracy >= (SELECT named_accuracy FROM c WHERE "condition" = 'src0') - 0.02::DOUBLE AND exact_accuracy >= (SELECT exact_accuracy FROM c WHERE "condition" = 'src0') AS passes FROM c)
  SELECT "condition", passes, round(score, 9) AS score, coalesce("condition" = (SELECT "condition" FROM p WHERE passes ORDER BY score DESC, "condition" DESC LIMIT 1), false) AS recommended FROM p""")
def screening_gates(spark, sf):
    return T.screened(M.scored(pred(spark, sf), "condition"), "condition", "src0").select("condition", "passes", F.round("score", 9).alias("score"), "recommended")


LEXI = {"literal": ("exact_accuracy", "named_accuracy", "balanced"), "human": ("elastic_accuracy", "exact_accuracy", "specificity", "recall"), "focused": ("balanced", "exact_accuracy", "named_accuracy", "parse_rate"), "decimal": ("exact_accuracy", "elastic_accuracy", "mcc", "accuracy")}


@query(" UNION ALL ".join(f"""(SELECT '{name}' AS summary, c."condition" AS winner, round(c.exact_accuracy - coalesce(b.exact_accuracy, 0), 9) AS delta FROM {base('"condition"')} c LEFT JOIN {base('"condition"')} b ON b."condition" = 'src0' ORDER BY {', '.join(f'round(c.{k}, 9) DESC' for k in keys)}, c."condition" DESC LIMIT 1)""" for name, keys in LEXI.items()))
def lexi_summaries(spark, sf):
    """The winner of each summary by its keys in order, and what it gains over the base."""
    rows = M.scored(pred(spark, sf), "condition")
    base_exact = F.coalesce(F.max(F.when(F.col("condition") == "src0", F.col("exact_accuracy"))), F.lit(0.0))
    top = rows.agg(base_exact.alias("b"), *[F.max_by(F.struct("condition", "exact_accuracy"), F.struct(*[F.round(k, 9) for k in keys], "condition")).alias(name) for name, keys in LEXI.items()])
    out = top.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("summary"), F.col(n).alias("w")) for n in LEXI])).alias("s"))
    return out.select("s.summary", F.col("s.w.condition").alias("winner"), F.round(F.col("s.w.exact_accuracy") - F.col("b"), 9).alias("delta"))


@query(f"SELECT expected_tool, sum((source_right)::INT + (lang_right)::INT + (n_right)::INT)::BIGINT AS fields_exact, count(*) * 3 AS fields_expected, sum(source_right::INT + lang_right::INT)::BIGINT AS required_exact, count(*) * 2 AS required_expected, round(sum(source_right::INT + lang_right::INT + n_right::INT) / greatest(1, count(*) * 3), 9) AS micro FROM (SELECT expected_tool, {RIGHT} AND slot <> 'src1' AS source_right, {RIGHT} AND predicted_tool = category AS lang_right, {RIGHT} AND n_calls <> 0 AND exact AS n_right FROM ({FULL}) WHERE {TOOL}) GROUP BY 1")
def field_micro(spark, sf):
    """Arguments of the expected call that the predicted one has with the same value, by tool: all of them, and the required ones."""
    rows = full(spark, sf).where(TOOL)
    want = F.create_map(F.lit("source"), F.col("slot"), F.lit("lang"), F.col("category"), F.lit("n"), F.lit("1"))
    got = F.map_filter(F.create_map(F.lit("source"), F.when(F.col("slot") == "src1", "other").otherwise(F.col("slot")), F.lit("lang"), F.col("predicted_tool"), F.lit("n"), F.when(F.col("exact"), "1").otherwise("2")), lambda k, v: (k != "n") | (F.col("n_calls") != 0))
    hits = lambda names: F.when(F.expr(RIGHT), F.size(F.map_filter(want, lambda k, v: F.map_contains_key(got, k) & (F.element_at(got, k) == v) & (k.isin(*names) if names else F.lit(True))))).otherwise(0)
    rows = rows.withColumn("w", hits(())).withColumn("r", hits(("source", "lang")))
    out = rows.groupBy("expected_tool").agg(F.sum("w").alias("fields_exact"), (F.count("*") * 3).alias("fields_expected"), F.sum("r").alias("required_exact"), (F.count("*") * 2).alias("required_expected"))
    return out.withColumn("micro", F.round(M.per(F.col("fields_exact"), F.col("fields_expected")), 9))


@query("WITH RECURSIVE n(id, need) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey >= 2 UNION SELECT c_custkey, c_custkey - 7 FROM customer WHERE c_custkey > 7 AND c_custkey % 5 = 0), r(id) AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT n.need FROM r JOIN n USING (id)) SELECT DISTINCT id FROM r")
def dependency_closure(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    needs = c.where("id >= 2").select("id", F.floor(F.col("id") / 2).alias("need")).unionAll(c.where("id > 7 and id % 5 = 0").select("id", (F.col("id") - 7).alias("need")))
    return T.closure(c.select("id"), needs, c.where("c_mktsegment = 'BUILDING'").select("id"))


DOMAINS = {"r": [4, 8, 16, 32], "alpha": [1, 2, 3], "rate": [0.1, 0.01], "mode": ["single", "pair", "diff"]}
WIDE = {**DOMAINS, **{f"x{k}": [*range(10)] for k in range(5)}}


def grid_sql(domains: dict, cells: str) -> str:
    below, out = 1, []
    for name, values in domains.items():
        out.append(f"{list(values)!r}[1 + (cell // {below}) % {len(values)}] AS {name}")
        below *= len(values)
    return f"SELECT cell, p_partkey, {', '.join(out)} FROM ({cells})"


def drawn_cells(spark, sf, domains: dict) -> DataFrame:
    """A trial for every part: its cell of the grid, drawn by its key."""
    total = reduce(mul, map(len, domains.values()))
    digits = F.conv(F.substring(X.sha(F.concat(F.lit("s:"), F.col("p_partkey").cast("string"))), 1, 13), 16, 10).cast("long")
    return T.unranked(table(spark, sf, "part").select("p_partkey", (digits % total).alias("cell")), domains)


DRAWN = "SELECT p_partkey, ('0x' || substr(sha256('s:' || p_partkey), 1, 13))::BIGINT % {total} AS cell FROM part"


@query(grid_sql(DOMAINS, "SELECT (p_partkey + p_size) % 72 AS cell, p_partkey FROM part"))
def config_grid(spark, sf):
    """The cell of a grid that each part's number stands for."""
    return T.unranked(table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") + F.col("p_size")) % 72).alias("cell")), DOMAINS)


@query(grid_sql(WIDE, DRAWN.format(total=7200000)))
def config_draws(spark, sf):
    """Cells of a grid that is too large to list, drawn."""
    return drawn_cells(spark, sf, WIDE)


@query(f"""SELECT p_partkey, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell % 12 ORDER BY sha256('s:' || p_partkey)) AS rn FROM ({DRAWN.format(total=72)})) WHERE rn = 1""")
def unique_trials(spark, sf):
    """Of the parts' trials in drawn order the first of each signature; r and alpha alone make one."""
    rows = drawn_cells(spark, sf, DOMAINS).withColumn("signature", X.canonical("alpha", "r")).withColumn("key", X.sha(F.concat(F.lit("s:"), F.col("p_partkey").cast("string"))))
    return T.first_of_each(rows, "signature", "key", 1000).select("p_partkey", "cell")


TOOLS = ["apply_patch", "bash", "edit", "glob", "grep", "lsp", "read", "todowrite"]
PAIR_TOOL = "CASE lang WHEN 'en' THEN 'bash' WHEN 'fr' THEN 'todowrite' WHEN 'de' THEN 'custom' END"
V = "regexp_replace(text, '[^A-Za-z0-9 ]', '_', 'g')"
NEAR = {
    "bash": ("timeout=' || n_chars || ', command=''' || v || '''", "command=''' || v || '''", "timeout=' || (n_chars + 1) || ', command=''' || v || '''", "timeout={''wrong'': ' || n_chars || '}, command=''' || v || '''"),
    "todowrite": ("todos=[''' || v || ''', ''b''], all=True", "all=True", "todos=[''' || v || '''], all=True", "todos={''wrong'': [''' || v || ''', ''b'']}, all=True"),
    "custom": ("flag=True, name=''' || v || '''", "name=''' || v || '''", "flag=False, name=''' || v || '''", "flag={''wrong'': True}, name=''' || v || '''"),
}


def near_sql() -> str:
    tool = lambda t, body, pre="": f"'{pre}<|tool_call_start|>[{t}({body})]<|tool_call_end|>'"
    other = {"bash": "edit", "todowrite": "apply_patch", "custom": "read"}
    cases = []
    for t, (right, missing, wrong, kind) in NEAR.items():
        extra = "unrequested=''extra-' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END || '''"
        bodies = [tool(t, missing), tool(t, wrong), tool(t, f"{right}, {extra}"), tool(t, kind), tool(other[t], right), "'Certainly.' || chr(10) || " + tool(t, right)]
        cases += [f"WHEN tool = '{t}' AND doc_id % 6 = {k} THEN {b}" for k, b in enumerate(bodies)]
    needless = "'<|tool_call_start|>[websearch(query=''' || substr(v, 1, 96) || ''')]<|tool_call_end|>'"
    names = "['missing-key', 'wrong-value', 'extra-key', 'wrong-type', 'wrong-tool', 'extra-prose'][1 + doc_id % 6]"
    chosen = " ".join(f"WHEN tool = '{t}' THEN {tool(t, r[0])}" for t, r in NEAR.items())
    return f"SELECT doc_id, CASE WHEN tool IS NULL THEN 'overtrigger' ELSE {names} END AS mutation, CASE {chosen} ELSE '' END AS chosen, CASE {' '.join(cases)} ELSE {needless} END AS rejected FROM (SELECT doc_id, n_chars, {V} AS v, {PAIR_TOOL} AS tool FROM documents)"


def pairs(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("v", F.regexp_replace("text", "[^A-Za-z0-9 ]", "_"))
    arg = lambda key, kind, value=None, items=None: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value"), (F.lit(None) if items is None else items).cast("array<string>").alias("items"))
    by_tool = F.when(F.col("lang") == "en", F.array(arg("timeout", "whole", F.col("n_chars")), arg("command", "text", F.col("v")))).when(F.col("lang") == "fr", F.array(arg("todos", "list", None, F.array(F.col("v"), F.lit("b"))), arg("all", "flag", F.lit("True"))))
    by_tool = by_tool.otherwise(F.array(arg("flag", "flag", F.lit("True")), arg("name", "text", F.col("v"))))
    return T.near_misses(rows.select("doc_id", F.col("doc_id").alias("idx"), F.col("v").alias("prompt"), F.expr(PAIR_TOOL).alias("tool"), by_tool.alias("arguments")), TOOLS)


@query(near_sql())
def near_miss_pairs(spark, sf):
    return pairs(spark, sf).select("doc_id", "mutation", "chosen", "rejected")


@query(f"SELECT doc_id, copy, mutation FROM ({near_sql()}) p JOIN (SELECT doc_id, unnest(range(1 + doc_id % 3)) AS copy FROM documents WHERE source <> 'src0') m USING (doc_id)")
def preference_alignment(spark, sf):
    """Every row of a mix, repeats included, with its pair."""
    mix = table(spark, sf, "documents").where("source <> 'src0'").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3)).alias("copy"))
    return mix.join(pairs(spark, sf).select("doc_id", "mutation"), "doc_id")


@query(r"""SELECT doc_id, contains(said, replace(source, '_', ' ')) AND contains(said, 'camel case') AS grounded FROM (SELECT doc_id, source, trim(regexp_replace(lower(regexp_replace(prompt, '([a-z])([A-Z])', '\1 \2', 'g')), '[_\s]+', ' ', 'g')) AS said
  FROM (SELECT doc_id, source, text || ' camelCase of ' || CASE WHEN n_chars % 3 = 0 THEN lang ELSE source END AS prompt FROM documents))""")
def grounded_arguments(spark, sf):
    prompt = F.concat("text", F.lit(" camelCase of "), F.when(F.col("n_chars") % 3 == 0, F.col("lang")).otherwise(F.col("source")))
    arg = lambda kind, value, items=None: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(None) if items is None else items).cast("array<string>").alias("items"))
    required = F.array(arg("text", F.col("source")), arg("flag", F.lit("True")), arg("list", F.lit(None), F.array(F.lit("camel_case"), F.lit("Camel  Case"))))
    return table(spark, sf, "documents").select("doc_id", T.grounded(prompt, required).alias("grounded"))


@query("SELECT doc_id, n_chars % 2 = 0 AS grounded FROM documents")
def literal_grounding(spark, sf):
    """Whether the arguments stand in the prompt as they are shown, indented by two."""
    from chatloom.operators import call_udfs as U

    args = "'{\"path\": \"' || source || '\", \"n\": [1, ' || n_chars || ']}'"
    block = "'{' || char(10) || '  \"path\": \"' || source || '\",' || char(10) || '  \"n\": [' || char(10) || '    1,' || char(10) || '    ' || n_chars || char(10) || '  ]' || char(10) || '}'"
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{args} as a", f"text || CASE WHEN n_chars % 2 = 0 THEN {block} ELSE {args} END as prompt")
    return rows.select("doc_id", F.contains("prompt", U.indented_udf("a")).alias("grounded"))


AUDIT = """SELECT sha256(text) AS h, lang AS category, CASE WHEN n_chars % 101 = 0 THEN 2 ELSE 1 END AS menus, n_chars % 103 <> 0 AS parsed, source, doc_id % 3 AS fold, doc_id % 4 = 0 AS held FROM documents"""


@query(f"""WITH a AS ({AUDIT}), t AS (SELECT * FROM a WHERE NOT held), f AS (SELECT * FROM a WHERE held), n AS (SELECT (SELECT count(*) FROM t) AS "rows", (SELECT count(DISTINCT h) FROM t) AS distinct_rows, (SELECT count(*) FROM f) AS fold_rows, (SELECT count(DISTINCT (fold, h)) FROM f) AS distinct_fold_rows,
  (SELECT count(*) FROM (SELECT DISTINCT h, fold FROM f) WHERE h IN (SELECT h FROM t)) AS train_overlap, (SELECT count(*) FROM (SELECT h FROM f GROUP BY h HAVING count(DISTINCT fold) > 1)) AS fold_overlap, (SELECT min(n) = max(n) FROM (SELECT count(*) AS n FROM t GROUP BY category)) AS even,
  (SELECT min(n) = max(n) FROM (SELECT count(*) AS n FROM f GROUP BY fold, category)) AS even_folds, (SELECT count_if(menus <> 1) FROM a) AS odd, (SELECT count_if(NOT parsed) FROM a) AS unreadable)
  SELECT "rows", distinct_rows, fold_rows, distinct_fold_rows, train_overlap, fold_overlap, concat_ws('; ', CASE WHEN NOT even THEN 'unexpected category distribution' END, CASE WHEN distinct_rows < "rows" THEN 'rows are not unique' END, CASE WHEN NOT even_folds THEN 'unexpected fold distribution' END,
    CASE WHEN distinct_fold_rows < fold_rows THEN 'fold rows are not unique' END, CASE WHEN train_overlap > 0 THEN 'training overlaps folds' END, CASE WHEN fold_overlap > 0 THEN 'folds overlap' END, CASE WHEN odd > 0 THEN 'every prompt must have one menu' END, CASE WHEN unreadable > 0 THEN 'calls are not readable' END) AS problems,
  CASE WHEN NOT even OR distinct_rows < "rows" OR NOT even_folds OR distinct_fold_rows < fold_rows OR train_overlap + fold_overlap + odd + unreadable > 0 THEN 'blocked' ELSE 'ready' END AS status FROM n""")
def corpus_audit(spark, sf):
    rows = table(spark, sf, "documents").select(X.sha(F.col("text")).alias("h"), F.col("lang").alias("category"), F.when(F.col("n_chars") % 101 == 0, 2).otherwise(1).alias("menus"), (F.col("n_chars") % 103 != 0).alias("parsed"), (F.col("doc_id") % 3).alias("fold"), (F.col("doc_id") % 4 == 0).alias("held"))
    out = T.corpus_audit(rows.where("not held"), rows.where("held"), None, None)
    return out.select("rows", "distinct_rows", "fold_rows", "distinct_fold_rows", "train_overlap", "fold_overlap", "problems", "status")


GENE = "p_partkey AS gene, p_size * 32 AS sequence_length, p_size % 24 AS lora_rank, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'attention' ELSE 'all' END AS target_profile, CASE WHEN p_partkey % 7 = 0 THEN 0.5::DOUBLE END AS value_weight, CASE WHEN p_partkey % 11 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS intent_weight"


@query(f"SELECT gene, concat_ws('; ', CASE WHEN sequence_length > 1408 THEN 'sequence length exceeds 1408' END, CASE WHEN lora_rank > 16 THEN 'rank exceeds 16' END, CASE WHEN coalesce(target_profile, '') <> 'attention' THEN 'only the attention profile is allowed' END, CASE WHEN coalesce(value_weight, 0) > 0 OR intent_weight > 0 THEN 'consistency adds a second forward pass' END) AS problems, CASE WHEN sequence_length <= 1408 AND lora_rank <= 16 AND target_profile = 'attention' AND coalesce(value_weight, 0) <= 0 AND intent_weight <= 0 THEN 'safe' ELSE 'blocked' END AS status FROM (SELECT {GENE} FROM part)")
def gene_safety(spark, sf):
    genes = table(spark, sf, "part").selectExpr(*[x.replace("::DOUBLE", "D") for x in GENE.split(", ")])
    found = T.gene_problems()
    return genes.select("gene", F.array_join(found, "; ").alias("problems"), T.status(found, fine="safe").alias("status"))


@query("SELECT DISTINCT ON (s.s_suppkey) s.s_suppkey AS run, e.o_orderkey AS evaluation FROM supplier s JOIN orders e ON e.o_custkey = s.s_suppkey AND e.o_totalprice >= 100000 AND e.o_orderkey % 8 >= 4 ORDER BY s.s_suppkey, e.o_orderdate DESC, e.o_orderkey DESC")
def cached_evaluation(spark, sf):
    """The newest evaluation of a run that has enough samples and a new enough schema."""
    fits = table(spark, sf, "orders").where("o_totalprice >= 100000 and o_orderkey % 8 >= 4").groupBy(F.col("o_custkey").alias("run")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("evaluation"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run")).join(fits, "run")


@query("SELECT a.p_partkey AS module, a.p_partkey * 2 AS a_rank, b.p_partkey * 2 + 1 AS b_rank, false AS missing FROM part a JOIN part b USING (p_partkey) WHERE a.p_partkey % 10 <> 3 UNION ALL SELECT p_partkey, p_partkey * 2, NULL, true FROM part WHERE p_partkey % 10 = 3")
def module_pairs(spark, sf):
    """Tensors by module: every A needs its B."""
    parts = table(spark, sf, "part")
    tensors = parts.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".lora_A.weight")).alias("key"), (F.col("p_partkey") * 2).alias("rank")).unionAll(parts.where("p_partkey % 10 <> 3").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".lora_B.weight")), F.col("p_partkey") * 2 + 1))
    parsed = tensors.select(F.regexp_extract("key", r"^(.*)\.lora_([AB])\.", 1).cast("long").alias("module"), F.regexp_extract("key", r"^(.*)\.lora_([AB])\.", 2).alias("side"), "rank")
    out = parsed.groupBy("module").agg(F.max(F.when(F.col("side") == "A", F.col("rank"))).alias("a_rank"), F.max(F.when(F.col("side") == "B", F.col("rank"))).alias("b_rank"))
    return out.withColumn("missing", F.col("b_rank").isNull())


@query("SELECT (SELECT count(*) FROM (SELECT p_brand, p_size FROM part WHERE p_size % 2 = 0 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_size % 3 = 0)) AS only_left, (SELECT count(*) FROM (SELECT p_brand, p_size FROM part WHERE p_size % 3 = 0 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_size % 2 = 0)) AS only_right, false AS same")
def module_set_difference(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_size")
    a, b = rows.where("p_size % 2 = 0"), rows.where("p_size % 3 = 0")
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).join(b.exceptAll(a).agg(F.count("*").alias("only_right"))).withColumn("same", F.col("only_left") + F.col("only_right") == 0)


@query("SELECT source, bool_and(NOT list_contains(['src1', 'src2'], source)) AND bool_or(list_contains(['src3', 'src4', 'src1'], source)) AS allowed FROM documents GROUP BY source")
def source_membership(spark, sf):
    """A source to develop on is declared for validation and not for training."""
    training, validation = F.array(F.lit("src1"), F.lit("src2")), F.array(F.lit("src3"), F.lit("src4"), F.lit("src1"))
    return table(spark, sf, "documents").select("source").distinct().withColumn("allowed", F.array_contains(validation, F.col("source")) & ~F.array_contains(training, F.col("source")))


@query("SELECT o_orderkey AS run, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_orderkey) AS position FROM orders QUALIFY position <= 100")
def comparison_sort(spark, sf):
    """The first hundred of the comparison: by tool score, unknown last, then by loss, unknown last."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.expr("if(o_orderkey % 5 = 0, null, o_totalprice)").alias("score"), F.expr("if(o_orderkey % 7 = 0, null, o_custkey)").alias("loss"))
    top = rows.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("loss"), "run").limit(100)
    order = Window.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("loss"), "run")  # over a hundred rows
    return top.select("run", F.row_number().over(order).cast("long").alias("position"))


@query("SELECT p_brand AS suite, p_partkey AS run, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END, p_size % 4, p_partkey) AS position, max(p_retailprice) OVER (PARTITION BY p_brand) AS updated FROM part")
def suite_order(spark, sf):
    """Variants in their fixed order within a suite; suites come by their newest evaluation."""
    by = Window.partitionBy("suite")
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in range(3) for x in (k, k)]), (F.col("v")).cast("int")), F.lit(9))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("suite"), F.col("p_partkey").alias("run"), (F.col("p_size") % 4).alias("v"), "p_retailprice")
    return rows.select("suite", "run", F.row_number().over(by.orderBy(rank, "v", "run")).cast("long").alias("position"), F.max("p_retailprice").over(by).alias("updated"))


@query("SELECT max_by(event_id, (coalesce(CASE WHEN user_id % 3 <> 0 THEN ts END, ts - INTERVAL 1 DAY), event_id)) AS event_id FROM events WHERE event_type = 'purchase'")
def latest_ready(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.expr("if(user_id % 3 <> 0, ts, null)").alias("updated_at"), F.expr("ts - interval 1 day").alias("created_at"))
    return T.latest_of(rows, "event_id", "updated_at", "created_at")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def last_records(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("event_id")).limit(100).select("event_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('micro:' || doc_id) LIMIT 450")
def micro_sample(spark, sf):
    from chatloom.operators import sampling as S

    return S.shuffled_limit(table(spark, sf, "documents").select("doc_id"), "doc_id", 450, "micro").select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def first_per_category(spark, sf):
    by = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(by).alias("rn")).where("rn <= 3").drop("rn")


@query("""SELECT p_partkey AS run, CASE WHEN i THEN 'human-intent' WHEN l THEN 'literal-lock' WHEN n AND g AND r THEN 'route-resolve' WHEN n AND g THEN 'noise+geometry' WHEN n AND r THEN 'noise+role-loss' WHEN n THEN 'noise-only' WHEN g AND r THEN 'geometry+role-loss' WHEN g THEN 'geometry-only' WHEN r THEN 'role-loss' ELSE 'baseline' END AS variant
  FROM (SELECT p_partkey, p_size % 2 = 0 AS n, p_size % 3 = 0 AS g, p_size % 5 = 0 AS r, p_size % 7 = 0 AS l, p_size % 11 = 0 AS i FROM part)""")
def run_variants(spark, sf):
    recipe = F.concat(F.lit('{"noise": {"enabled": '), (F.col("p_size") % 2 == 0).cast("string"), F.lit(', "protect_prompt_literals": '), (F.col("p_size") % 7 == 0).cast("string"), F.lit(', "value_consistency_weight": 0.5, "intent_consistency_weight": '),
                      F.when(F.col("p_size") % 11 == 0, "0.1").otherwise("0"), F.lit('}, "geometry": {"enabled": '), (F.col("p_size") % 3 == 0).cast("string"), F.lit('}, "role_loss": {"enabled": '), (F.col("p_size") % 5 == 0).cast("string"), F.lit("}}"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("run"), F.from_json(recipe, "noise struct<enabled:boolean,protect_prompt_literals:boolean,value_consistency_weight:double,intent_consistency_weight:double>, geometry struct<enabled:boolean>, role_loss struct<enabled:boolean>").alias("r"))
    return rows.select("run", variant(F.col("r")).alias("variant"))


def variant(r):
    """What a recipe varies, by its strongest feature."""
    on = lambda c: F.coalesce(c, F.lit(False))
    noise, geometry, role = on(r["noise"]["enabled"]), on(r["geometry"]["enabled"]), on(r["role_loss"]["enabled"])
    literal = on(r["noise"]["protect_prompt_literals"]) & on(r["noise"]["value_consistency_weight"] > 0)
    names = F.array_compact(F.array(F.when(noise, "noise"), F.when(geometry, "geometry"), F.when(role, "role-loss")))
    plain = F.when(F.size(names) == 3, "route-resolve").when(F.size(names) == 0, "baseline").when((F.size(names) == 1) & ~role, F.concat(names[0], F.lit("-only"))).otherwise(F.array_join(names, "+"))
    return F.when(on(r["noise"]["intent_consistency_weight"] > 0), "human-intent").when(literal, "literal-lock").otherwise(plain)


#: The parts of a recipe that tell one protocol from another.
PROTOCOL = [
    "model", "datasets", "validation_mode", "validation_datasets", "eval_ratio", "max_validation_samples", "seed", "sequence_length", "max_source_rows", "max_training_samples", "time_limit_minutes", "reserve_minutes", "budget_mode", "max_steps", "use_rslora", "lora_rank", "lora_alpha",
    "target_profile", "learning_rate", "allowed_tools",
]
GIVEN = {"lora_rank": "p_size", "model": "p_brand", "target_profile": "p_type", "seed": "p_partkey % 4", "sequence_length": "p_size * 64", "use_rslora": "p_size % 2 = 0"}
LISTS = {"datasets": ("p_brand", "p_type"), "allowed_tools": ("p_type",)}


def recipe_sql() -> str:
    quoted = lambda e: f"'\"' || {e} || '\"'"
    value = lambda k: "'[' || " + " || ', ' || ".join(map(quoted, LISTS[k])) + " || ']'" if k in LISTS else "'null'" if k not in GIVEN else quoted(GIVEN[k]) if GIVEN[k] in ("p_brand", "p_type") else f"({GIVEN[k]})::VARCHAR"
    return "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || {value(k)}" for k in sorted(PROTOCOL)) + " || '}'"


@query(f"SELECT p_partkey AS run, substr(sha256({recipe_sql()}), 1, 10) AS signature FROM part")
def protocol_signature(spark, sf):
    """Runs by the twenty parts of their recipes that make a protocol; what a recipe doesn't have is null."""
    given = {k: F.expr(v) for k, v in GIVEN.items()} | {k: F.array(*v) for k, v in LISTS.items()}
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("run"), *[given.get(k, F.lit(None).cast("string")).alias(k) for k in PROTOCOL])
    return rows.select("run", F.substring(X.sha(dumped(rows, PROTOCOL)), 1, 10).alias("signature"))


def dumped(rows: DataFrame, names: list[str]) -> Column:
    """Columns as the JSON that is signed: by name, nulls shown, a blank after each comma and colon; lists are of texts."""
    bare = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")
    kinds = dict(rows.dtypes)
    shown = lambda k: F.concat(F.lit("["), F.array_join(F.transform(k, bare), ", "), F.lit("]")) if kinds[k].startswith("array") else bare(F.col(k))
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.when(F.col(k).isNull(), "null").otherwise(shown(k))) for k in sorted(names)]), F.lit("}"))


@query("SELECT event_type, round(exp(least(20, coalesce(loss, 3.0))), 6) AS perplexity FROM (SELECT event_type, max_by(value / 100, (ts, event_id)) FILTER (event_id % 3 = 0) AS loss FROM events GROUP BY 1)")
def perplexity(spark, sf):
    loss = F.max_by(F.when(F.col("event_id") % 3 == 0, F.col("value") / 100), F.when(F.col("event_id") % 3 == 0, F.struct("ts", "event_id")))
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.exp(F.least(F.lit(20.0), F.coalesce(loss, F.lit(3.0)))), 6).alias("perplexity"))


@query(r"""SELECT p_partkey, coalesce(nullif(rtrim(substr(regexp_replace(regexp_replace(lower(p_name || '  ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 36), '-'), ''), 'sheet') AS slug, CASE WHEN p_size % 9 = 0 THEN 'N/A' ELSE printf('%.1f%%', p_size * 1.5) END AS shown FROM part""")
def labels_shown(spark, sf):
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.concat("p_name", F.lit("  "), "p_type")), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 36)
    percent = F.when(F.col("p_size") % 9 != 0, F.format_string("%.1f%%", (F.col("p_size") * 1.5).cast("double")))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.nullif(F.rtrim(slug, F.lit("-")), F.lit("")), F.lit("sheet")).alias("slug"), F.coalesce(percent, F.lit("N/A")).alias("shown"))


@query("SELECT doc_id, coalesce(CASE WHEN n_chars % 3 = 0 THEN 'case-' || doc_id END, CASE WHEN n_chars % 3 = 1 THEN 'eval-' || doc_id END, '') AS case_id, CASE WHEN n_chars % 3 = 0 THEN lang WHEN n_chars % 3 = 1 AND lang <> 'en' THEN source ELSE 'rehearsal' END AS category FROM documents")
def case_categories(spark, sf):
    meta = F.coalesce(F.expr("if(n_chars % 3 = 0, named_struct('case_id', 'case-' || doc_id, 'category', lang, 'stratum', cast(null as string)), null)"), F.expr("if(n_chars % 3 = 1, named_struct('case_id', 'eval-' || doc_id, 'category', '', 'stratum', if(lang = 'en', null, source)), null)"))
    rows = table(spark, sf, "documents").withColumn("m", meta)
    return rows.select("doc_id", F.coalesce("m.case_id", F.lit("")).alias("case_id"), F.coalesce(F.nullif("m.category", F.lit("")), F.nullif("m.stratum", F.lit("")), F.lit("rehearsal")).alias("category"))


@query("SELECT p_partkey, round(exp(ln(0.00001) + u * (ln(0.01) - ln(0.00001))), 12) AS rate FROM (SELECT p_partkey, ('0x' || substr(sha256('lr:' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM part)")
def log_uniform(spark, sf):
    import math

    u = F.conv(F.substring(X.sha(F.concat(F.lit("lr:"), F.col("p_partkey").cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    return table(spark, sf, "part").select("p_partkey", F.round(F.exp(math.log(1e-5) + u * (math.log(1e-2) - math.log(1e-5))), 12).alias("rate"))


NAMES = "CASE p_partkey % 6 WHEN 0 THEN 'm.layers.' || p_size || '.self_attn.q_proj' WHEN 1 THEN 'm.layers.' || p_size || '.self_attn.out_proj' WHEN 2 THEN 'm.layers.' || p_size || '.feed_forward.w1' WHEN 3 THEN 'lm_head.proj' WHEN 4 THEN 'm.conv.' || p_size || '.in_proj' ELSE 'm.norm' END"


@query(f"""WITH t AS (SELECT {NAMES} AS module, p_size * 4096::BIGINT AS n, CASE WHEN p_partkey % 3 = 0 THEN 'BF16' ELSE 'F32' END AS dtype FROM part), s AS (SELECT sum(n)::BIGINT AS n FROM t)
  SELECT 'count' AS kind, (SELECT n FROM s)::VARCHAR AS value UNION ALL SELECT 'dtype', (SELECT lower(dtype) FROM t GROUP BY dtype ORDER BY sum(n) DESC, dtype DESC LIMIT 1) UNION ALL SELECT DISTINCT 'target', module FROM t WHERE module LIKE '%.self_attn.%' OR ((SELECT n FROM s) < 3000000000 AND module LIKE '%.feed_forward.%')""")
def model_probe(spark, sf):
    """Of tensors: parameters, the type of most of them, and the modules to adapt: attention, and for small models the feed-forward too."""
    rows = table(spark, sf, "part").select(F.expr(NAMES).alias("module"), F.array(F.col("p_size").cast("long"), F.lit(4096).cast("long")).alias("shape"), F.expr("if(p_partkey % 3 = 0, 'BF16', 'F32')").alias("dtype"))
    return probe(rows)


def probe(tensors: DataFrame, small: int = 3_000_000_000) -> DataFrame:
    rows = tensors.withColumn("n", F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b))
    by_type = rows.groupBy("dtype").agg(F.sum("n").alias("n"))
    total = by_type.agg(F.sum("n").alias("total"), F.lower(F.max_by("dtype", F.struct("n", "dtype"))).alias("main"))
    last = F.regexp_extract("module", r"([^.]*)$", 1)
    attention = F.col("module").contains(".self_attn.") & last.isin("q_proj", "k_proj", "v_proj", "out_proj")
    forward = F.col("module").contains(".feed_forward.") & last.isin("w1", "w2", "w3")
    targets = rows.select("module", attention.alias("a"), forward.alias("f")).distinct().join(F.broadcast(total)).where(F.col("a") | (F.col("f") & (F.col("total") < small)))  # one row
    head = total.select(F.explode(F.array(F.struct(F.lit("count").alias("kind"), F.col("total").cast("string").alias("value")), F.struct(F.lit("dtype").alias("kind"), F.col("main").alias("value")))).alias("x")).select("x.*")
    return head.unionByName(targets.select(F.lit("target").alias("kind"), F.col("module").alias("value")))


DIGITS = "31415926535897932384626433832795028841971"


@query(f"""WITH d AS (SELECT '{DIGITS}' AS d), m AS (SELECT event_id AS i, unnest(['single_digit', 'triplets', 'diff', 'digit_pairs']) AS mode, (SELECT count(*) FROM events) AS n FROM events),
  v AS (SELECT i, mode, n, CASE mode WHEN 'single_digit' THEN substr(d, 1 + (i % 41)::INT, 1)::INT WHEN 'triplets' THEN substr(d, 1 + 3 * (i % 13)::INT, 3)::INT WHEN 'diff' THEN abs(substr(d, 2 + (i % 40)::INT, 1)::INT - substr(d, 1 + (i % 40)::INT, 1)::INT) ELSE substr(d, 1 + 2 * (i % 21)::INT, 2)::INT END AS v FROM m, d)
  SELECT i, mode, round(greatest(0.0, 0.1 * (1 + 0.5 * CASE mode WHEN 'triplets' THEN (v - 499.5) / 499.5 WHEN 'digit_pairs' THEN (v - 49.5) / 49.5 ELSE (v - 4.5) / 4.5 END)) * CASE WHEN i / n::DOUBLE >= 0.9 THEN 0 ELSE 0.5 * (1 + cos(pi() * least(1.0, i / n::DOUBLE / 0.9))) END, 6) AS alpha FROM v""")
def digit_schedule(spark, sf):
    """For every event as a step of a run: amplitudes by the digits of a number, read in four ways, under a falling envelope with a clean tail."""
    steps = table(spark, sf, "events").select(F.col("event_id").alias("i"))
    return schedule(steps, DIGITS, 0.1, 0.5, steps.count(), 0.1).select("i", "mode", F.round("alpha", 6).alias("alpha"))


def schedule(steps: DataFrame, digits: str, alpha: float, modulation: float, total: int, tail: float) -> DataFrame:
    read = {
        "single_digit": [int(c) for c in digits], "triplets": [int(digits[k : k + 3]) for k in range(0, len(digits) - 2, 3)],
        "diff": [abs(int(a) - int(b)) for a, b in zip(digits[1:], digits, strict=False)], "digit_pairs": [int(digits[k : k + 2]) for k in range(0, len(digits), 2)],
    }
    middle = {"triplets": 499.5, "digit_pairs": 49.5}
    centred = lambda mode: F.array(*[F.lit((v - middle.get(mode, 4.5)) / middle.get(mode, 4.5)) for v in read[mode]])
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.get(centred(m), (F.col("i") % len(read[m])).cast("int")).alias("c")) for m in read]))
    rows = steps.select("i", modes.alias("m")).select("i", "m.*")
    at = F.col("i") / float(total)
    envelope = F.when(at >= 1 - tail, 0.0).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), at / (1 - tail)))))
    return rows.withColumn("alpha", F.greatest(F.lit(0.0), alpha * (1 + modulation * F.col("c"))) * envelope)
