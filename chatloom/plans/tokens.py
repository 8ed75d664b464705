"""Queries over tokens, targets, suites and instruction checks, all over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.operators import conversations as C
from chatloom.operators import metrics as M
from chatloom.operators import sampling as S
from chatloom.operators import subwords as B
from chatloom.operators import tables as T
from chatloom.operators.calls import spans
from chatloom.plans.calls import texts
from chatloom.plans.pieces import DUCK_SAFE, ROLE_FORMS, SAFE, known_sql, known_text
from chatloom.plans.corpora import DUCK_EXAMPLE, examples
from chatloom.plans.evaluation import FULL, full
from chatloom.plans.registry import query
from chatloom.sources import stores as W
from chatloom.sources.readers import table
from chatloom.sources.shared import kept

ROLES = "doc_id % 7 AS role, n_chars % 3 <> 0 AS is_tool, lang IN ('en', 'fr') AS several, n_chars % 2 = 0 AS typed"


@query(f"""SELECT doc_id, CASE WHEN NOT is_tool THEN 0.0 WHEN role = 0 THEN CASE WHEN several THEN 0.05 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS x, CASE WHEN NOT is_tool THEN 0.0 WHEN role = 0 THEN CASE WHEN several THEN 0.85 ELSE 0.0 END ELSE several::INT END::DOUBLE AS y,
  CASE WHEN NOT is_tool THEN 0.0 WHEN role = 0 THEN CASE WHEN several THEN 0.10 ELSE 0.0 END WHEN role = 2 THEN 1.0 WHEN role IN (3, 4) THEN CASE WHEN typed THEN 1.0 ELSE 0.88 END WHEN role IN (1, 5) THEN 0.92 ELSE typed::INT END::DOUBLE AS z FROM (SELECT doc_id, {ROLES} FROM documents)""")
def target_coordinate(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", *ROLES.replace("IN ('en', 'fr')", "in ('en'; 'fr')").replace(", ", "|").replace(";", ",").split("|"))
    spot = T.coordinate(F.col("role"), F.col("is_tool"), F.col("several"), F.col("typed"))
    return rows.select("doc_id", *[F.get(spot, F.lit(k)).alias(c) for k, c in enumerate("xyz")])


KIND = "CASE doc_id % 6 WHEN 0 THEN 'memory' WHEN 1 THEN 'web_search' WHEN 2 THEN 'multi_turn_base' WHEN 3 THEN 'simple' WHEN 4 THEN 'format_sensitivity' ELSE 'live_memory' END"
SCOPES = ["all", "agentic", "multi-turn", "single"]


@query(f"""WITH d AS (SELECT {KIND} AS kind, {KIND} || '_' || doc_id AS id FROM documents), s AS (SELECT unnest({SCOPES!r}) AS scope), k AS (SELECT * FROM d, s WHERE kind <> 'format_sensitivity' AND CASE WHEN kind LIKE 'multi_turn%' THEN scope IN ('multi-turn', 'all') WHEN kind IN ('memory', 'web_search') THEN scope IN ('agentic', 'all') ELSE scope NOT IN ('multi-turn', 'agentic') END)
  SELECT scope, coalesce(kind || '_' || v, kind) AS category, CASE WHEN v IS NULL THEN id ELSE replace(id, kind, kind || '_' || v) END AS id FROM k LEFT JOIN (VALUES ('memory', 'kv'), ('memory', 'vector'), ('memory', 'rec_sum'), ('web_search', 'base'), ('web_search', 'no_snippet')) t(kind, v) USING (kind)""")
def variant_expansion(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(f"{KIND} as kind", f"{KIND} || '_' || doc_id as id")
    parts = [T.expanded(rows, scope).withColumn("scope", F.lit(scope)) for scope in SCOPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("scope", "category", "id")


@query(known_sql(ROLE_FORMS))
def token_role_join(spark, sf, tokenizer: str = B.TOKENIZER):
    """Every piece of a vocabulary in texts of calls and code, with the largest role of the spans that it touches."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{known_text(ROLE_FORMS)} as t")
    return B.tokens(rows, "doc_id", "t", tokenizer, spans).select("doc_id", "n", F.col("start").cast("long").alias("start"), "role")


@query("""WITH d AS (SELECT doc_id, lang AS n1, 'v' || doc_id % 7 AS n2, length(lang) AS a, length('v' || doc_id % 7) AS b FROM documents), p AS (SELECT *, a + 7 AS p2, 2 * a + b + 14 AS p3, 3 * a + 2 * b + 21 AS p4 FROM d)
  SELECT doc_id, unnest([{'name': n1, 'consumer': p2 + b + 5, 'producer': 0}, {'name': n2, 'consumer': p3 + a + 5, 'producer': p2}, {'name': n1, 'consumer': p4 + 4, 'producer': p3}, {'name': 'nobody', 'consumer': p4 + a + 10, 'producer': NULL}], recursive := true) FROM p""")
def state_binding(spark, sf):
    """As-of: every use of a name is bound to the latest statement before it that gave it a value; a name that none gave has no producer."""
    from chatloom.operators import call_udfs as U

    code = "lang || ' = f()' || char(10) || 'v' || doc_id % 7 || ' = g(' || lang || ')' || char(10) || lang || ' = h(v' || doc_id % 7 || ')' || char(10) || 'use(' || lang || ')' || char(10) || 'use(nobody)'"
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{code} as t")
    spans = U.with_spans(rows, "t", "s").select("doc_id", "t", F.explode("s").alias("s")).where("s.role = 4")
    names = spans.select("doc_id", F.col("s.start").cast("long").alias("start"), F.substring("t", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("name"), F.substring("t", F.col("s.stop") + 1, 8).rlike(r"^\s*=").alias("gives")).where(r"name rlike '^[A-Za-z_][A-Za-z0-9_]*$'")
    return T.bound(names, "doc_id").select("doc_id", "name", F.col("start").alias("consumer"), "producer")


@query(f"""SELECT category, count(*) AS total, count_if(strict)::BIGINT AS strict_success, count_if(elastic_ok)::BIGINT AS elastic_success, count_if(routed)::BIGINT AS routing_success, count_if(format_right)::BIGINT AS format_success, round(count_if(strict) / count(*), 9) AS strict_accuracy, round(count_if(elastic_ok) / count(*), 9) AS elastic_accuracy,
  round(count_if(routed) / count(*), 9) AS routing_accuracy, round(count_if(format_right) / count(*), 9) AS format_accuracy FROM (SELECT coalesce(nullif(CASE WHEN n_calls = 3 THEN '' ELSE category END, ''), CASE WHEN run > 0 THEN slot END, 'unclassified') AS category, exact AS strict, elastic AS elastic_ok, (expected_tool IS NOT NULL) = attempted AS routed, format_right FROM ({FULL})) GROUP BY 1""")
def category_scores(spark, sf):
    rows = full(spark, sf).select(F.expr("if(n_calls = 3, '', category)").alias("stratum"), F.expr("if(run > 0, slot, null)").alias("category"), F.col("exact").alias("strict"), "elastic", (F.col("expected_tool").isNotNull() == F.col("attempted")).alias("routing"), F.col("format_right").alias("format"))
    out = M.category_scores(rows)
    return out.select("category", "total", *[f"{k}_success" for k in M.OUTCOMES], *[F.round(f"{k}_accuracy", 9).alias(f"{k}_accuracy") for k in M.OUTCOMES])


@query(f"""SELECT n, tool_samples, skeletons, concat_ws('; ', CASE WHEN least(tool_samples, n - tool_samples) < 0.5 * greatest(1, tool_samples, n - tool_samples) THEN 'tool and other answers are imbalanced' END, CASE WHEN skeletons < greatest(10, n // 5) THEN 'prompts are alike' END) AS warnings
  FROM (SELECT count(*) AS n, count_if(len(completion_tools) > 0)::BIGINT AS tool_samples, count(DISTINCT group_id % 30) AS skeletons FROM ({DUCK_EXAMPLE}))""")
def suite_profile(spark, sf):
    rows = examples(spark, sf).withColumn("skeleton", (F.col("group_id") % 30).cast("string"))
    return T.suite_profile(rows, F.size("completion_tools") > 0, "skeleton").select("n", "tool_samples", "skeletons", F.array_join("warnings", "; ").alias("warnings"))


ANSWER = """CASE doc_id % 9 WHEN 0 THEN {safe} || ' *** ' || source WHEN 1 THEN '*** ' || {safe} || ' *** ' || source || ' ***' WHEN 2 THEN {safe} || ' ***  *** ' || source WHEN 3 THEN {safe} || ' ****** ' || source WHEN 4 THEN source || ' ****** ' || source
  WHEN 5 THEN lang || chr(10) || chr(10) || 'Second, ' || {safe} WHEN 6 THEN {safe} || chr(10) || 'P.S. more' WHEN 7 THEN {safe} || chr(10) || 'p. p. s more' ELSE lang || ' of ' || source || '. Then ' || {safe} END"""
TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
PARTS = r"list_transform(string_split_regex(c, '\s?\*\*\*\s?'), lambda x: " + TRIM.format("x") + ")"
SIXES = "list_transform(string_split(c, '******'), lambda x: " + TRIM.format("x") + ")"


@query(rf"""SELECT doc_id, NOT list_contains(p[2:-2], '') AND len(p) - (p[1] = '')::INT - (len(p) > 1 AND p[-1] = '')::INT = 2 AS two_paragraphs, NOT list_contains(s[2:-2], '') AND len(list_filter(s, lambda x: x <> '')) = 2 AND list_filter(s, lambda x: x <> '')[1] <> list_filter(s, lambda x: x <> '')[2] AS two_responses,
  k = 5 AS second_paragraph, regexp_matches(lower(c), '(?m)\s*p\.\s?s\..*$') AS ps, regexp_matches(lower(c), '(?m)\s*p\.\s?p\.\s?s.*$') AS pps, starts_with(lower({TRIM.format('c')}), lang || ' of ' || source || '.') AS repeats
  FROM (SELECT *, {PARTS} AS p, {SIXES} AS s FROM (SELECT doc_id, doc_id % 9 AS k, lang, source, {ANSWER.replace('{safe}', DUCK_SAFE)} AS c FROM documents))""")
def ifeval_paragraphs(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "lang", "source", ANSWER.replace("{safe}", SAFE).replace("chr(10)", "char(10)") + " as c")
    c, prompt = F.col("c"), F.concat(F.lit("  "), F.upper("lang"), F.lit(" of "), F.col("source"), F.lit(". "))
    return rows.select("doc_id", X.paragraphs(c, 2).alias("two_paragraphs"), X.two_responses(c).alias("two_responses"), X.nth_paragraph_first_word(c, 2, 2, "second").alias("second_paragraph"), X.postscript(c, "P.S.").alias("ps"), X.postscript(c, "P.P.S").alias("pps"), X.repeats_prompt(c, prompt).alias("repeats"))


FIELDS = {"instruction": "CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '' END", "question": "CASE WHEN n_chars % 3 = 0 THEN lang WHEN n_chars % 3 = 1 THEN '' END", "output": "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '' END", "answer": "CASE WHEN n_chars % 2 = 0 THEN lang END",
          "reference_answer": "CASE WHEN doc_id % 7 > 2 THEN '' WHEN doc_id % 7 > 0 THEN source END", "prompt": "CASE WHEN doc_id % 11 > 3 THEN 'p' || doc_id END", "completion": "CASE WHEN doc_id % 13 > 4 THEN 'c' || n_chars END"}


@query(f"""SELECT doc_id, ask, sha256(reply) AS reply_hash FROM (SELECT doc_id, CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN i ELSE prompt END AS ask, CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN o ELSE completion END AS reply
  FROM (SELECT doc_id, coalesce(nullif(instruction, ''), question) AS i, coalesce(nullif(output, ''), nullif(answer, ''), reference_answer) AS o, prompt, completion FROM (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in FIELDS.items())} FROM documents))) WHERE ask IS NOT NULL AND reply IS NOT NULL""")
def instruction_pairs(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", *[f"{e} as {n}" for n, e in FIELDS.items()])
    return C.instruction_pairs(rows).select("doc_id", "ask", X.sha(F.col("reply")).alias("reply_hash"))


NAMED = "['web_search_base', 'multi_turn_base', 'live_simple', 'non_live_x', 'exec_simple', 'format_sensitivity', 'simple', 'memory_kv', 'Rest_Java'][1 + doc_id % 9]"


@query(f"""SELECT version, family, sum(n_chars % 5)::BIGINT AS correct, count(*) * 5 AS total, round(sum(n_chars % 5) / (count(*) * 5), 9) AS accuracy FROM (SELECT *, CASE WHEN c LIKE '%memory%' OR c LIKE '%web_search%' THEN 'agentic' WHEN c LIKE '%multi_turn%' THEN 'multi_turn' WHEN c LIKE '%live%' THEN 'live' WHEN version = 'v3' AND c LIKE '%exec%' THEN 'executable' WHEN c LIKE '%format_sensitivity%' THEN 'format_sensitivity' ELSE 'non_live' END AS family
  FROM (SELECT n_chars, {NAMED} AS c, CASE WHEN n_chars % 2 = 0 THEN 'v3' ELSE 'v4' END AS version FROM documents)) GROUP BY ALL""")
def bfcl_family_scores(spark, sf):
    rows = table(spark, sf, "documents").select("n_chars", F.expr(f"element_at(array{NAMED.split(']')[0].replace('[', '(')}), cast(1 + doc_id % 9 as int))").alias("c"), F.expr("if(n_chars % 2 = 0, 'v3', 'v4')").alias("version"))
    rows = rows.withColumn("family", F.when(F.col("version") == "v3", W.family(F.col("c"), "v3")).otherwise(W.family(F.col("c"), "v4")))
    out = rows.groupBy("version", "family").agg(F.sum(F.col("n_chars") % 5).alias("correct"), (F.count("*") * 5).alias("total"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 9))


@query("""WITH p AS (SELECT 'replay' AS pool, 120 AS draws, doc_id, row_number() OVER (ORDER BY sha256('1:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents WHERE lang = 'es' UNION ALL SELECT 'canonical', 280, doc_id, row_number() OVER (ORDER BY sha256('2:' || doc_id), doc_id) - 1, count(*) OVER () FROM documents WHERE lang = 'en')
  SELECT pool, max(n) AS pool_size, count(*) AS distinct_rows, sum(draws // n + (r < draws % n)::INT)::BIGINT AS draws, max(draws) > max(n) AS replacement, round(max(draws) / 400, 9) AS ratio FROM p WHERE n < draws OR r < draws GROUP BY pool""")
def replay_mix(spark, sf):
    """A mix of fixed length from two pools, with what its manifest says of each."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")

    def part(name: str, rows: DataFrame, draws: int, seed: str) -> DataFrame:
        size = rows.agg(F.count("*").alias("pool_size"))
        drawn = S.drawn_with_replacement(rows, "doc_id", draws, seed).agg(F.count("*").alias("distinct_rows"), F.sum("copies").alias("draws")).join(size)  # one row each
        return drawn.withColumn("pool", F.lit(name)).withColumn("replacement", F.col("draws") > F.col("pool_size"))

    both = part("replay", docs.where("lang = 'es'"), 120, "1").unionByName(part("canonical", docs.where("lang = 'en'"), 280, "2"))
    return both.withColumn("ratio", F.round(F.col("draws") / F.sum("draws").over(Window.partitionBy(F.lit(0))), 9))


STREAM = """SELECT pool, doc_id, h, pool_size, draws, row_number() OVER (ORDER BY sha256('m:' || doc_id || ':' || copy), doc_id, copy) AS position FROM (SELECT pool, doc_id, h, n AS pool_size, draws, unnest(range(1, draws // n + (r < draws % n)::INT + 1)) AS copy FROM (
  SELECT pool, doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY pool ORDER BY sha256('m:' || pool || ':' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY pool) AS n, CASE pool WHEN 'replay' THEN again ELSE total - again END AS draws
  FROM (SELECT *, CASE WHEN lang = 'es' THEN 'replay' ELSE 'canonical' END AS pool, (SELECT count(*) FROM documents) AS total, round_even((SELECT count(*) FROM documents) * 0.3, 0)::BIGINT AS again FROM documents)))"""


def replayed(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", X.sha(F.col("text")).alias("h"))
    return S.composed(docs, "doc_id", F.col("lang") == "es", 0.3, docs.count(), "m")


@query(f"SELECT position, doc_id, pool FROM ({STREAM})")
def replay_stream(spark, sf):
    """As many rows as there are documents, three tenths of them replayed Spanish ones, in a drawn order."""
    return replayed(spark, sf).select("position", "doc_id", "pool")


@query(f"""WITH s AS ({STREAM}) SELECT pool, max(pool_size) AS pool_size, count(*) AS draws, count(DISTINCT doc_id) AS distinct_rows, count(*) > max(pool_size) AS replacement, round(count(*) / sum(count(*)) OVER (), 9) AS ratio,
  (SELECT sha256(string_agg(h, chr(10) ORDER BY b)) FROM (SELECT b // 1024 AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM (SELECT position // 1024 AS b, sha256(string_agg(h, chr(10) ORDER BY position)) AS h FROM s GROUP BY 1) GROUP BY 1)) AS fingerprint FROM s GROUP BY pool""")
def replay_manifest(spark, sf):
    """Of the composed stream: its pools, what was drawn of each and whether repeatedly, and a fingerprint of the whole in its order."""
    stream = kept(replayed(spark, sf), "stream")
    sizes = table(spark, sf, "documents").groupBy(F.when(F.col("lang") == "es", "replay").otherwise("canonical").alias("pool")).agg(F.count("*").alias("pool_size"))
    parts = stream.groupBy("pool").agg(F.count("*").alias("draws"), F.countDistinct("doc_id").alias("distinct_rows")).join(sizes, "pool")
    parts = parts.withColumn("replacement", F.col("draws") > F.col("pool_size")).withColumn("ratio", F.round(F.col("draws") / F.sum("draws").over(Window.partitionBy(F.lit(0))), 9))  # two rows
    return parts.join(T.fingerprint(stream, "position", ["position"], "h"))  # one row
