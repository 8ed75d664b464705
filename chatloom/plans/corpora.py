"""Queries about corpora: preflight, capabilities, dialogues, tool menus, classifiers, literals, manifests and generated rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.functions import words as treebank
from chatloom.operators import calls as K
from chatloom.operators import generators as G
from chatloom.operators import languages as D
from chatloom.operators import literals as L
from chatloom.operators import metrics as M
from chatloom.operators import preflight as P
from chatloom.operators import sampling as S
from chatloom.operators import sentences as N
from chatloom.operators import subwords as B
from chatloom.plans.pieces import DUCK_SAFE, LITERAL_FORMS, SAFE, known_sql, known_text
from chatloom.plans.calls import texts
from chatloom.plans.registry import SQL, query
from chatloom.sources.readers import table
from chatloom.sources.shared import kept

# Preflight. Examples are made from all documents.

ALLOWED, LIMIT = ["bash", "edit", "read"], 1500
EXAMPLE = """doc_id, source, doc_id % 50 AS group_id, CASE n_chars % 4 WHEN 0 THEN {a}'bash'{z} WHEN 1 THEN {a}'read', 'bash'{z} WHEN 2 THEN {a}'rm'{z} ELSE {none} END AS tools, CASE WHEN source IN ('src1', 'src2') THEN {a}'bash'{z} WHEN n_chars % 4 = 0 THEN {a}'bash'{z} WHEN n_chars % 4 = 1 THEN {a}'read'{z} ELSE {none} END AS completion_tools,
  CASE WHEN doc_id % 3 = 0 THEN {a}'user'{z} WHEN doc_id % 3 = 1 AND source <> 'src2' THEN {a}'system', 'user'{z} ELSE {a}'user', 'assistant', 'tool'{z} END AS roles, {words} AS prompt_tokens, n_chars % 200 AS completion_tokens"""
SPARK_EXAMPLE = EXAMPLE.format(a="array(", z=")", none="cast(array() as array<string>)", words="n_chars")
DUCK_EXAMPLE = f"SELECT {EXAMPLE.format(a='[', z=']', none='[]::VARCHAR[]', words='n_chars')}, sha256(text) AS h FROM documents"
INITIAL = "NOT list_has_any(roles, ['assistant', 'tool'])"


def nearest_sql(column: str, f: float) -> str:
    return f"list_sort(list({column}))[1 + least(count(*) - 1, round_even((count(*) - 1) * {f}, 0))::INT]"


PROFILE_SQL = f"""SELECT source, count(*) AS normalized, count(DISTINCT group_id) AS groups, count_if(fits)::BIGINT AS compatible, count_if(total > {LIMIT})::BIGINT AS truncated, count_if(prompt_tokens >= {LIMIT} - 8)::BIGINT AS prompt_overflow, count_if(fits AND sealed)::BIGINT AS sealed_overlap,
  count_if({INITIAL} AND len(completion_tools) > 0)::BIGINT AS initial_calls, count_if({INITIAL} AND len(completion_tools) = 0)::BIGINT AS initial_direct, count_if(NOT ({INITIAL}) AND list_contains(roles, 'tool') AND len(completion_tools) = 0)::BIGINT AS after_tool_direct, count_if(list_contains(roles, 'system'))::BIGINT AS with_system, max(total) AS total_max,
  {', '.join(f"{nearest_sql(c, f)} AS {k}_{n}" for k, c in (("prompt", "prompt_tokens"), ("completion", "completion_tokens"), ("total", "total")) for n, f in (("p50", 0.5), ("p95", 0.95)))}
  FROM (SELECT *, prompt_tokens + completion_tokens AS total, list_has_all(['bash', 'edit', 'read'], tools) AS fits, h IN (SELECT sha256(text) FROM documents WHERE source = 'src3') AS sealed FROM ({DUCK_EXAMPLE})) GROUP BY source"""


def examples(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("text", *split_columns(SPARK_EXAMPLE)).withColumn("h", X.sha(F.col("text"))).drop("text")


def split_columns(sql: str) -> list[str]:
    """The columns of a select list; commas within brackets don't part them."""
    out, depth = [""], 0
    for c in sql:
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def sealed(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("source = 'src3'").select(X.sha(F.col("text")).alias("h"))


@query(PROFILE_SQL)
def preflight_profile(spark, sf):
    return P.profile(examples(spark, sf), ALLOWED, LIMIT, sealed(spark, sf))


@query(f"""SELECT source, tool, count_if(k = 0)::BIGINT AS n, count_if(k = 1)::BIGINT AS unknown FROM (SELECT source, unnest(completion_tools) AS tool, 0 AS k FROM ({DUCK_EXAMPLE}) UNION ALL SELECT source, unnest(list_filter(tools, lambda t: NOT list_contains(['bash', 'edit', 'read'], t))), 1 FROM ({DUCK_EXAMPLE})) GROUP BY ALL""")
def tool_frequencies(spark, sf):
    return P.tool_counts(examples(spark, sf), ALLOWED)


WARNING_SQL = f"""(WITH p AS ({PROFILE_SQL}), r AS (SELECT source, unnest([{{'severity': 'error', 'code': 'SEALED_SOURCE_REUSE', 'hit': source = 'src3'}}, {{'severity': 'warning', 'code': 'UNKNOWN_TOOLS', 'hit': compatible < normalized}}, {{'severity': 'warning', 'code': 'NO_INITIAL_ABSTENTION_EXAMPLES', 'hit': initial_calls > 0 AND initial_direct = 0}},
  {{'severity': 'warning', 'code': 'NO_SCHEMA_CONDITIONED_EXAMPLES', 'hit': initial_calls > 0 AND with_system = 0}}, {{'severity': 'warning', 'code': 'HIGH_TOOL_FILTER_REJECTION', 'hit': (normalized - compatible) / normalized >= 0.5}}, {{'severity': 'warning', 'code': 'LOW_COMPATIBLE_SAMPLE_COUNT', 'hit': compatible < 100}}], recursive := true) FROM p),
  t AS (SELECT sum(normalized) AS n, sum(compatible) AS c, sum(truncated) AS t, sum(prompt_overflow) AS o, sum(sealed_overlap) AS s FROM p), f AS (SELECT tool, count(*) AS n FROM (SELECT unnest(completion_tools) AS tool FROM ({DUCK_EXAMPLE})) GROUP BY 1),
  g AS (SELECT NULL::VARCHAR AS source, unnest([{{'severity': 'error', 'code': 'SEALED_CONTENT_OVERLAP', 'hit': s > 0}}, {{'severity': 'error', 'code': 'PROMPT_OVERFLOW', 'hit': o > 0}}, {{'severity': 'error', 'code': 'EXCESSIVE_TRUNCATION', 'hit': o = 0 AND t / n > 0.25}}, {{'severity': 'warning', 'code': 'SOME_TRUNCATION', 'hit': o = 0 AND t > 0 AND t / n <= 0.25}},
    {{'severity': 'warning', 'code': 'MISSING_TOOL_COVERAGE', 'hit': (SELECT count(*) FROM f WHERE tool IN ('bash', 'edit', 'read')) < 3}}, {{'severity': 'warning', 'code': 'TOOL_IMBALANCE', 'hit': (SELECT max(n) / sum(n) FROM f) > 0.75}}, {{'severity': 'error', 'code': 'NO_COMPATIBLE_SAMPLES', 'hit': c = 0}}], recursive := true) FROM t)
  SELECT source, severity, code FROM (FROM r UNION ALL FROM g) WHERE hit)"""


def warned(spark, sf, rows: DataFrame) -> DataFrame:
    sources = table(spark, sf, "documents").where("source = 'src3'").select("source")
    return P.warnings(P.profile(rows, ALLOWED, LIMIT, sealed(spark, sf)), P.tool_counts(rows, ALLOWED), ALLOWED, sources)


@query(WARNING_SQL)
def preflight_warnings(spark, sf):
    return warned(spark, sf, examples(spark, sf))


@query(f"SELECT CASE WHEN count_if(severity = 'error') > 0 THEN 'blocked' WHEN count(*) > 0 THEN 'warning' ELSE 'ready' END AS status FROM {WARNING_SQL}")
def preflight_status(spark, sf):
    return P.verdict(warned(spark, sf, examples(spark, sf)))


@query(f"""SELECT code, role, count(*) AS n FROM (SELECT *, 'training' AS role FROM {WARNING_SQL.replace('FROM documents)) GROUP BY source', 'FROM documents)) WHERE doc_id % 4 <> 0 GROUP BY source').replace(DUCK_EXAMPLE + ')) GROUP BY 1', DUCK_EXAMPLE + ') WHERE doc_id % 4 <> 0) GROUP BY 1').replace(DUCK_EXAMPLE + ')) GROUP BY source', DUCK_EXAMPLE + ') WHERE doc_id % 4 <> 0) GROUP BY source')}
  UNION ALL SELECT *, 'validation' FROM {WARNING_SQL.replace(DUCK_EXAMPLE + ')) GROUP BY 1', DUCK_EXAMPLE + ') WHERE doc_id % 4 = 0) GROUP BY 1').replace(DUCK_EXAMPLE + ')) GROUP BY source', DUCK_EXAMPLE + ') WHERE doc_id % 4 = 0) GROUP BY source')}
  UNION ALL SELECT NULL, 'error', 'TRAIN_VALIDATION_OVERLAP', 'both' WHERE (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 4 <> 0 INTERSECT SELECT text FROM documents WHERE doc_id % 4 = 0)) > 0) GROUP BY ALL""")
def preflight_recipe(spark, sf):
    rows = examples(spark, sf)
    train, held = rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0")
    return P.recipe(warned(spark, sf, train), warned(spark, sf, held), train.select("h"), held.select("h")).groupBy("code", "role").agg(F.count("*").alias("n"))


# Capabilities, dialogues and menus.

TURN = {"is_tool": "CASE WHEN n_chars % 11 = 0 THEN true END", "is_parallel": "CASE WHEN n_chars % 13 = 0 THEN true END", "is_multiturn": "CASE WHEN n_chars % 17 = 0 THEN false END", "is_typed": "CASE WHEN n_chars % 19 = 0 THEN false END", "is_docstring_derived": "CASE WHEN n_chars % 23 = 0 THEN true END", "expected_call_count": "CASE WHEN n_chars % 29 = 0 THEN 3 END"}
META = {"is_tool": "CASE WHEN n_chars % 7 = 0 THEN false END", "is_parallel": "CASE WHEN n_chars % 5 = 0 THEN false END", "is_multiturn": "CASE WHEN n_chars % 31 = 0 THEN true END", "is_typed": "CASE WHEN n_chars % 37 = 0 THEN true END", "is_docstring_derived": "CASE WHEN n_chars % 41 = 0 THEN true END", "expected_call_count": "CASE WHEN n_chars % 43 = 0 THEN 0 END"}
CATEGORY = "CASE lang WHEN 'en' THEN 'Parallel_java' WHEN 'fr' THEN 'multi_turn_base' WHEN 'de' THEN 'plain' END"


def chosen_sql(name: str, default: str) -> str:
    return f"coalesce({TURN[name]}, {META[name]}, {default})"


TOOL_SQL = chosen_sql("is_tool", "doc_id % 3 = 0")


@query(f"""SELECT doc_id, {TOOL_SQL}::INT AS cap_is_tool, {chosen_sql('is_parallel', "coalesce(lang = 'en', false)")}::INT AS cap_is_parallel, {chosen_sql('is_multiturn', "1 + doc_id % 4 > 1 OR lang = 'fr'")}::INT AS cap_is_multiturn, {chosen_sql('is_typed', f"{TOOL_SQL} OR lang = 'en'")}::INT AS cap_is_typed,
  (doc_id % 4)::INT AS turn_index, (1 + doc_id % 4)::INT AS turn_count, 1.0::DOUBLE / (1 + doc_id % 4) AS trajectory_weight, {chosen_sql('is_docstring_derived', 'n_chars % 2 = 0')}::INT AS cap_is_docstring_derived,
  greatest(1, coalesce(nullif({chosen_sql('expected_call_count', 'n_chars % 3')}, 0), 1))::INT AS cap_expected_call_count FROM documents""")
def capability_targets(spark, sf):
    from chatloom.operators.conversations import capabilities

    pack = lambda names: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in names.items()) + ")"
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{pack(TURN)} as turn", f"{pack(META)} as meta", "named_struct('is_docstring_derived', n_chars % 2 = 0, 'expected_call_count', n_chars % 3) as structure", f"{CATEGORY} as category", "if(doc_id % 6 = 0, 'bash', null) as expected_tool", "doc_id % 6 = 3 as inferred_tool", "cast(doc_id % 4 as int) as turn_index", "cast(1 + doc_id % 4 as int) as turn_count")
    return capabilities(rows).select("doc_id", "cap_is_tool", "cap_is_parallel", "cap_is_multiturn", "cap_is_typed", "turn_index", "turn_count", "trajectory_weight", "cap_is_docstring_derived", "cap_expected_call_count")


CHAT = """'USER: ' || {safe} || chr(10) || chr(10) || 'ASSISTANT: ' || CASE doc_id % 4 WHEN 0 THEN 'done<|endoftext|>' WHEN 1 THEN '<functioncall> {{"name": "find", "arguments": {{"q": "' || source || '"}}}} <|endoftext|>' || chr(10) || chr(10) || 'FUNCTION RESPONSE: {{"n": 1}}' || chr(10) || chr(10) || 'ASSISTANT: one'
  WHEN 2 THEN '<functioncall> {{"name": "find", "arguments": "oops' ELSE 'so' || chr(10) || chr(10) || 'USER: and' || chr(10) || chr(10) || 'ASSISTANT: more' END"""


@query(f"""WITH d AS (SELECT doc_id, source, doc_id % 4 AS k, trim({DUCK_SAFE}) AS v FROM documents), v AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY doc_id) AS rn FROM d)
  SELECT doc_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 5 END::INT AS messages, CASE k WHEN 0 THEN 'rehearsal' WHEN 2 THEN 'rehearsal' ELSE 'glaive_multiturn' END AS category, CASE WHEN k = 1 THEN 'external_tool' END AS expected_tool,
    CASE k WHEN 0 THEN 'done' WHEN 1 THEN '<|tool_call_start|>[find(q=''' || source || ''')]<|tool_call_end|>' WHEN 2 THEN '<functioncall> {{"name": "find", "arguments": "oops' ELSE 'so' END AS first_reply FROM v WHERE rn = 1 ORDER BY doc_id LIMIT 1500""")
def dialogue_records(spark, sf):
    from chatloom.operators.conversations import dialogues

    rows = table(spark, sf, "documents").selectExpr("doc_id", "'SYSTEM: You are a helpful assistant' as system", CHAT.format(safe=SAFE).replace("chr(10)", "char(10)") + " as chat")
    return dialogues(rows, "doc_id", 1500).select("doc_id", F.size("messages").alias("messages"), "category", "expected_tool", F.get("messages", F.lit(2)).getField("content").alias("first_reply"))


KNOWN_TOOLS = ", ".join(f"('{name}', '{json.dumps(schema)}')" for name, schema in sorted(G.menu_schemas(list(G.TOOLS)).items()))
OTHER_TOOL = """'{"type": "function", "function": {"name": "' || t || '", "description": "Call the ' || t || ' tool.", "parameters": {"type": "object", "properties": {}, "required": [], "additionalProperties": true}}}'"""


@query(f"SELECT t AS tool, coalesce(k.schema, {OTHER_TOOL}) AS schema FROM (SELECT DISTINCT unnest(string_split(names, ',')) AS t FROM ({SQL['tool_names']}) WHERE names <> '') LEFT JOIN (VALUES {KNOWN_TOOLS}) k(tool, schema) ON k.tool = t")
def tool_menu(spark, sf):
    """The schemas of all tools that the documents' calls name; unknown ones take any arguments."""
    return G.tool_menu(texts(spark, sf).select(F.explode(K.tool_names(F.col("t"))).alias("tool")))


# Instruction checks that aren't in the registry.

JOIN = "text || ' Mr. A. Smith paid 3.50 to x.com... He left. Ph.D. work? \"Yes!\" U.S. Inc. closed.'"


@query("SELECT doc_id, lang = 'en' AS english, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])(\\s+)', '\\1\x01', 'g'), '\x01'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')) >= 5 AS five_sentences FROM documents".replace("\\\\", "\\"))
def ifeval_language_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.in_language(F.col("lang"), "en").alias("english"), X.sentences_as_said(F.col("text"), "at least", 5).alias("five_sentences"))


SPEECH = """' "I CANNOT go--it''s 3.50 (NASA''s)!" THEY don''t... U.S.A. WON, 50% of it; he said ''gonna'' [OK].'"""


@query(f"""SELECT doc_id, len(w)::BIGINT AS words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}'))) < 9 AS few_capitals, array_to_string(w[-12:], ' ') AS last_words FROM (SELECT doc_id, {treebank.words_sql(f"text || {SPEECH}")} AS w FROM documents)""")
def ifeval_capital_words(spark, sf):
    """Words by the treebank's rules, and whether few are in capitals."""
    t = F.concat("text", F.expr(SPEECH.replace("\\", "\\\\")))
    rows, own = table(spark, sf, "documents").select("doc_id", treebank.words(t).alias("w")), F.col("w")
    return rows.select("doc_id", F.size(own).cast("long").alias("words"), X.capitals_among(own, "less than", 9).alias("few_capitals"), F.array_join(F.slice(own, -12, 12), " ").alias("last_words"))


SHORTS = "' Mr. Smith met Dr. No. He left the U.S. today. The work of Mr. Smith was at home by 3. May he rest... He is, e.g. here. mr smith? ' || source || '. It is.'"
#: For the checking engine.
POWER = "(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0.0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0.0 END)"


def power_sql(k: str, n: str, p: str) -> str:
    return POWER.format(k=f"({k})", n=f"({n})", p=f"({p})")


SENTENCES_SQL = rf"""WITH c AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text || {SHORTS}, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '{N.OPENING.replace("'", "''")}', ''), '{N.CLOSING.replace("'", "''")}', '')) AS c FROM documents),
  o AS (SELECT doc_id, unnest(c) AS core, unnest(list_append(c[2:], NULL)) AS after FROM c), t AS (SELECT *, regexp_matches(core, '[^.][.]$') AS dotted, lower(regexp_replace(core, '[.,;:!?]$', '')) AS word, lower(regexp_replace(after, '[.,;:!?]$', '')) AS next FROM o),
  n AS (SELECT word, count_if(dotted)::DOUBLE AS a, count_if(NOT dotted)::DOUBLE AS b, length(replace(word, '.', ''))::DOUBLE AS size FROM t WHERE word <> '' GROUP BY word), z AS (SELECT sum(a) AS dots, sum(a) + sum(b) AS al FROM n),
  ab AS (SELECT word FROM (SELECT word, -2 * ({power_sql('a', 'a + b', 'dots / al')} - {power_sql('a', 'a + b', '0.99')}) * exp(-size) * (length(word) - size + 1) * pow(size, -b) AS score FROM n, z WHERE a > 0 AND regexp_matches(word, '\p{{L}}')) WHERE score >= 0.3),
  f AS (SELECT next AS word, count(*)::DOUBLE AS s FROM t WHERE word <> '' AND next IS NOT NULL AND (regexp_matches(core, '[!?]$') OR dotted AND word NOT IN (SELECT word FROM ab) AND NOT regexp_matches(word, '^\p{{L}}$')) GROUP BY 1), y AS (SELECT sum(s) AS e FROM f),
  st AS (SELECT word FROM (SELECT word, -2 * ({power_sql('s', 'e', 'k / al')} + {power_sql('k - s', 'al - e', 'k / al')} - {power_sql('s', 'e', 's / e')} - {power_sql('k - s', 'al - e', '(k - s) / (al - e)')}) AS score, al / e > k / s AS more FROM (SELECT f.word, s, a + b AS k, al, e FROM f JOIN n USING (word), z, y) WHERE regexp_matches(word, '^\p{{L}}+$')) WHERE score >= 30 AND more),
  r AS (SELECT doc_id, CASE WHEN after IS NULL THEN true WHEN regexp_matches(core, '[!?]$') THEN true WHEN regexp_matches(core, '[.]{{2,}}$') THEN regexp_matches(after, '^\p{{Lu}}') WHEN dotted THEN CASE WHEN word IN (SELECT word FROM ab) OR regexp_matches(word, '^\p{{L}}$') THEN regexp_matches(after, '^\p{{Lu}}') AND next IN (SELECT word FROM st)
    WHEN regexp_matches(word, '^[0-9]+$') THEN NOT regexp_matches(after, '^\p{{Ll}}') AND NOT regexp_matches(after, '^[0-9]') ELSE true END ELSE false END AS ends FROM t)
  SELECT doc_id, count_if(ends)::BIGINT AS sentences, count_if(ends) >= 20 AS enough FROM r GROUP BY doc_id"""


@query(SENTENCES_SQL)
def learned_sentences(spark, sf):
    """Sentences by abbreviations and first words that are learned from all documents, and whether there are at least twenty."""
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.expr(SHORTS)).alias("t"))
    found = N.counted(rows, "doc_id", "t", *N.learn(rows, "t"))
    return found.select("doc_id", "sentences", X.relation(F.col("sentences"), "at least", 20).alias("enough"))


@query()
def detected_languages(spark, sf):
    """The language of every document, by a model of those whose crc32 of the id modulo 5 isn't 0; whether it is English, and English in capitals or in small letters."""
    docs = table(spark, sf, "documents")
    model = D.learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), "text", "lang")
    rows = docs.withColumn("detected", model.column(F.col("text")))
    english = X.in_language(F.col("detected"), "en")
    return rows.select("doc_id", "lang", "detected", english.alias("english"), (X.all_capital(F.upper("text")) & english).alias("english_capital"), (X.all_lowercase(F.col("text")) & english).alias("english_lowercase"))


def split_sql(t: str) -> str:
    """The same sentence rules for the checking engine."""
    t = f"replace(' ' || {t} || '  ', chr(10), ' ')"
    duck = lambda p: p.replace("$", "\\")
    for pattern, to in X.RULES:
        t = f"regexp_replace({t}, '{pattern}', '{duck(to)}', 'g')"
    for n in range(12, 1, -1):  # runs of dots, longest first
        t = f"replace({t}, '{'.' * n}', '{'<prd>' * n}<stop>')"
    t = f"replace({t}, 'Ph.D.', 'Ph<prd>D<prd>')"
    for pattern, to in X.LATER:
        t = f"regexp_replace({t}, '{pattern}', '{duck(to)}', 'g')"
    for old, new in ((".\u201d", "\u201d."), ('."', '".'), ('!"', '"!'), ('?"', '"?'), (".", ".<stop>"), ("?", "?<stop>"), ("!", "!<stop>"), ("<prd>", ".")):
        t = f"replace({t}, '{old}', '{new}')"
    return f"list_transform(string_split({t}, '<stop>'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


@query(f"SELECT doc_id, len(s) - (s[-1] = '')::INT AS sentences, s[1] AS first_sentence, list_contains(s, 'He left.') AND NOT list_contains(s, 'nothing') AS has_key FROM (SELECT doc_id, {split_sql(JOIN)} AS s FROM documents)")
def sentence_splitter(spark, sf):
    t = F.expr(JOIN.replace("\\", "\\\\"))
    own = X.sentences(t)
    return table(spark, sf, "documents").select("doc_id", F.size(own).cast("long").alias("sentences"), F.get(own, F.lit(0)).alias("first_sentence"), X.key_sentences(t, ["He left.", "nothing"], 1).alias("has_key"))


@query(r"""SELECT doc_id, lang <> 'fr' AS rephrased, n BETWEEN 5 AND 60 AS shares FROM documents JOIN (SELECT doc_id, sum(least(a, b))::BIGINT AS n FROM (SELECT doc_id, w, count_if(k = 0) AS a, count_if(k = 1) AS b FROM (SELECT doc_id, 0 AS k, unnest(regexp_extract_all(lower(text || ' ' || source), '[\p{L}\p{M}\p{N}_]+')) AS w FROM documents
  UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(lower('The the and de la ' || text), '[\p{L}\p{M}\p{N}_]+')) FROM documents) GROUP BY ALL) GROUP BY 1) USING (doc_id)""")
def ifeval_rephrasing(spark, sf):
    c = F.col
    value, reference = F.concat(F.lit("say *now* "), c("source")), F.concat(F.lit("say *" ), c("lang"), F.lit("* "), F.when(c("lang") == "fr", F.lit("x")).otherwise(c("source")))
    rows = table(spark, sf, "documents").select("doc_id", X.rephrased(value, reference).alias("rephrased"), F.concat_ws(" ", "text", "source").alias("value"), F.concat(F.lit("The the and de la "), "text").alias("original"))
    return X.shares_words(rows, ["doc_id", "rephrased"], "value", "original", 5, 60)


# Classifiers.

SCORED = "SELECT doc_id, toxic AS label, (n_chars % 100 + 40 * toxic) / 140.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH s AS ({SCORED}), c AS (SELECT count_if(label = 1 AND p >= 0.5)::DOUBLE AS tp, count_if(label = 0 AND p >= 0.5)::DOUBLE AS fp, count_if(label = 1 AND p < 0.5)::DOUBLE AS fn, count_if(label = 0 AND p < 0.5)::DOUBLE AS tn FROM s)
  SELECT round((SELECT sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) FROM s a, s b WHERE a.label = 1 AND b.label = 0), 9) AS auroc, round(tp / greatest(1, tp + fp), 9) AS "precision", round(tp / greatest(1, tp + fn), 9) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 9) AS f1, round(tn / greatest(1, tn + fp), 9) AS specificity FROM c""")
def classifier_metrics(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("label"), ((F.col("n_chars") % 100 + 40 * F.col("toxic")) / 140.0).cast("double").alias("p"))
    return rounded(M.classifier(rows, "label", "p"), ["auroc", "precision", "recall", "f1", "specificity"])


def rounded(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.round(n, 9).alias(n) for n in names])


@query()
def router_logreg(spark, sf):
    """A class-balanced logistic router over embeddings, label 0 against the others: fitted on four fifths by a hash of the id, measured on the rest."""
    from chatloom.operators.router import fitted

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") == 0).cast("double").alias("label"), (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("held"))
    scores = fitted(rows.where("not held"), rows.where("held"))
    return M.classifier(scores.withColumn("label", F.col("label").cast("int")), "label", "p")


# Literals in token streams.

@query(f"SELECT doc_id, n, start, role > 0 AS literal FROM ({known_sql(LITERAL_FORMS)})")
def literal_mask(spark, sf, tokenizer: str = B.TOKENIZER):
    """Pieces of a vocabulary that touch what stands in code marks; marks within fences don't count on their own."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{known_text(LITERAL_FORMS)} as t")
    return B.tokens(rows, "doc_id", "t", tokenizer, lambda t: [s | {"role": 1} for s in L.literals(t)]).select("doc_id", "n", F.col("start").cast("long").alias("start"), (F.col("role") > 0).alias("literal"))


# Manifests, unions and generated corpora.


@query("SELECT coalesce(CASE WHEN lang <> 'es' THEN lang END, 'unknown') AS category, count(*) AS n, count_if(doc_id % 3 = 0)::BIGINT AS fold0, count_if(doc_id % 3 = 1)::BIGINT AS fold1, count_if(doc_id % 3 = 2)::BIGINT AS fold2 FROM documents GROUP BY 1")
def corpus_manifest(spark, sf):
    rows = table(spark, sf, "documents").select(F.expr("nullif(lang, 'es')").alias("category"), (F.col("doc_id") % 3).alias("fold"))
    return rows.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), *[F.count_if(F.col("fold") == k).alias(f"fold{k}") for k in range(3)])


@query("SELECT 'documents' AS part, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'turns', count(*), sum(length(text))::BIGINT FROM conversations UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages")
def normalized_union(spark, sf):
    """All sources as (part, text), whatever their columns."""
    parts = [table(spark, sf, "documents").select(F.lit("documents").alias("part"), "text"), table(spark, sf, "conversations").select("text", F.lit("turns").alias("part")), table(spark, sf, "pages").select(F.lit("pages").alias("part"), F.col("html").alias("text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT source, max(text_hash) AS text_hash, count(*) AS stores FROM (SELECT DISTINCT source, sha256(source) AS text_hash, k FROM documents, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR doc_id % 2 = 0) GROUP BY source")
def result_stores(spark, sf):
    """Results of two folders that overlap: each path counts once."""
    rows = table(spark, sf, "documents")
    store = lambda k, some: some.select("source", X.sha(F.col("source")).alias("text_hash"), F.lit(k).alias("store")).dropDuplicates(["source", "store"])
    both = store(0, rows).unionByName(store(1, rows.where("doc_id % 2 = 0")))
    return both.groupBy("source").agg(F.max("text_hash").alias("text_hash"), F.count("*").alias("stores"))


@query("SELECT (SELECT count(*) FROM (SELECT lang FROM documents EXCEPT SELECT lang FROM documents WHERE doc_id % 2 = 0)) = 0 AS subset, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents EXCEPT SELECT 'src0')) = 0 AS equal")
def set_tests(spark, sf):
    rows = table(spark, sf, "documents")
    sets = rows.agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("b"), F.countDistinct("source").alias("n"), F.max(F.when(F.col("source") == "src0", 1)).alias("z"))  # a handful of languages
    return sets.select((F.size(F.array_except("a", "b")) == 0).alias("subset"), ((F.col("n") == 1) & (F.col("z") == 1)).alias("equal"))


@query("SELECT json_extract_string(p, '$.sheet') AS sheet, count(*) AS runs, min(doc_id) AS first_run FROM (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '{\"sheet\": ' ELSE '{\"sheet\": \"' || source || '\", \"lr\": 0.1}' END AS p FROM documents) WHERE json_valid(p) GROUP BY 1")
def sheet_runs(spark, sf):
    """Runs by the sheet that their recipe names; a recipe that is no JSON names none."""
    recipe = F.expr("if(n_chars % 5 = 0, '{\"sheet\": ', '{\"sheet\": \"' || source || '\", \"lr\": 0.1}')")
    rows = table(spark, sf, "documents").select("doc_id", F.from_json(recipe, "sheet string").getField("sheet").alias("sheet")).where("sheet is not null")
    return rows.groupBy("sheet").agg(F.count("*").alias("runs"), F.min("doc_id").alias("first_run"))


@query(f"SELECT split, category, count(*) AS n, count(*) AS prompts, count_if(category <> 'rehearsal')::BIGINT AS with_tool, count(*) AS menus FROM part, (VALUES ('train'), ('dev'), ('sealed')) s(split), (SELECT unnest({sorted(G.CATEGORIES)!r}) AS category) GROUP BY split, category")
def generated_suite(spark, sf):
    """Rows of every category and split with the number of each part in their requests."""
    rows = G.suite(table(spark, sf, "part").select(F.col("p_partkey").alias("id")))
    return rows.groupBy("split", "category").agg(F.count("*").alias("n"), F.countDistinct(G.short(F.col("prompt"))).alias("prompts"), F.count_if(F.col("tool").isNotNull()).alias("with_tool"), F.count_if(F.col("prompt").contains("List of tools: [")).alias("menus"))


@query(f"SELECT category, CASE WHEN n > 0 THEN 'ready' ELSE 'blocked' END AS status, 0::BIGINT AS ungrounded FROM (SELECT unnest([{', '.join(repr(c) for c in G.CATEGORIES)}]) AS category), (SELECT count(*) AS n FROM part)")
def generated_audit(spark, sf):
    """Generated rows keep what the audits ask for: even counts, no repeats, one menu, arguments that the prompt shows."""
    return G.audited(G.suite(table(spark, sf, "part").select(F.col("p_partkey").alias("id"))))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h, lang AS category, row_number() OVER (ORDER BY sha256('v:' || doc_id)) AS rn, count(*) OVER () AS n FROM documents), s AS (SELECT *, CASE WHEN rn <= floor(n * 0.85) THEN 'train' ELSE 'dev' END AS side, (rn - 1) % 3 AS fold FROM d)
  SELECT side, category, count(*) AS rows_kept FROM s WHERE side = 'dev' OR h NOT IN (SELECT h FROM s WHERE side = 'dev') GROUP BY ALL""")
def corpus_assembly(spark, sf):
    """Folds, a split by position and decontamination of the training side against the other."""
    rows = table(spark, sf, "documents").select("doc_id", X.sha(F.col("text")).alias("h"), F.col("lang").alias("category"))
    return G.assembled(rows, "doc_id", "v").groupBy("side", "category").agg(F.count("*").alias("rows_kept"))
