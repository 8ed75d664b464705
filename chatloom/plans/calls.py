"""Queries over tool calls: texts with calls are made from all documents, and SQL builds what reading them must give from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators import calls as K
from chatloom.plans.pieces import ARGUMENTS, FIRST_ARGUMENTS, FIRST_NAME, FORMS, N_CALLS, NAME, TEXT, V, duck, flat, spans_sql, spark_sql
from chatloom.plans.registry import query
from chatloom.sources.readers import table


def texts(spark, sf, e: str = TEXT, name: str = "t") -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", "lang", "source", "n_chars", "text", f"{spark_sql(e)} as {name}")


def first_call(p: str) -> list[Column]:
    call = F.get(f"{p}.calls", F.lit(0))
    return [F.size(f"{p}.calls").cast("long").alias("n_calls"), call.getField("name").alias("name"), call.getField("arguments").alias("arguments")]


@query(duck(f"""SELECT doc_id, CASE WHEN {N_CALLS} > 0 THEN 'lead' ELSE trim(replace({TEXT}, '<|im_end|>', '')) END AS content, ({N_CALLS})::BIGINT AS n_calls, {FIRST_NAME} AS name, {FIRST_ARGUMENTS} AS arguments FROM documents"""))
def call_parse_native(spark, sf):
    from chatloom.operators import call_udfs as U

    return U.with_parse(texts(spark, sf).select("doc_id", "t"), "t", "p").select("doc_id", "p.content", *first_call("p"))


OBJECT = f"""'{{"name": "' || {NAME} || '", "arguments": ' || {ARGUMENTS} || '}}'"""
BARE = " || ".join(flat(FORMS[0])[0][3:-3])
GENERIC = f"""CASE doc_id % 9 WHEN 0 THEN {OBJECT} WHEN 1 THEN 'x <tool_call>' || {OBJECT} || '</tool_call>' WHEN 2 THEN '```json' || chr(10) || '[{{"function": ' || {OBJECT} || '}}]' || chr(10) || '```' WHEN 3 THEN {BARE} WHEN 4 THEN 'I would say ' || {OBJECT} || ' here'
  WHEN 5 THEN '{{"tool_calls": [{{"tool_name": "' || {NAME} || '", "args": "' || {{safe}} || '"}}]}}' WHEN 6 THEN '[' || {BARE} || ', 3]' WHEN 7 THEN '[f(1 + x[0], **{{''a'': 1}}, k=' || {V[0]} || '), g()]' ELSE 'f(k=0b1 + ' || n_chars || ')' END"""


def found_in(none: str, odd: str, one: str) -> str:
    return f"CASE WHEN doc_id % 9 IN (4, 6, 8) THEN {none} WHEN doc_id % 9 = 7 THEN {odd} ELSE {one} END"


ODD = """'{"k": "' || {safe} || '"}'"""
VALUE = """CASE WHEN NOT regexp_full_match({safe}, '[0-9]+') THEN '{"value": "' || {safe} || '"}' END"""


@query(duck(f"""SELECT doc_id, CASE WHEN doc_id % 9 IN (4, 6, 8) THEN trim({GENERIC}) WHEN doc_id % 9 = 1 THEN 'x' ELSE '' END AS content, ({found_in('0', '2', '1')})::BIGINT AS n_calls, {found_in('NULL', "'f'", NAME)} AS name,
  CASE WHEN doc_id % 9 = 5 THEN {VALUE} ELSE {found_in('NULL', ODD, ARGUMENTS)} END AS arguments FROM documents"""))
def call_parse_generic(spark, sf):
    from chatloom.operators import call_udfs as U

    return U.with_parse_any(texts(spark, sf, GENERIC).select("doc_id", "t"), "t", "p").select("doc_id", "p.content", *first_call("p"))


LISTED = """CASE doc_id % 4 WHEN 0 THEN '[{"function": {"name": "exec_command", "arguments": "{\\"cmd\\": \\"' || {safe} || '\\"}"}}]' WHEN 1 THEN '[{"name": "lsp", "arguments": {"path": "' || {safe} || '", "line": ' || n_chars || '}}, {"arguments": {}}]' WHEN 2 THEN '[{"name": "read_file", "arguments": "<' || {safe} || '"}]' ELSE '[{}, 5]' END"""


@query(duck("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '<|tool_call_start|>[bash(command=''' || {safe} || ''')]<|tool_call_end|>' WHEN 1 THEN source || '<|tool_call_start|>[lsp(filePath=''' || {safe} || ''', line=' || n_chars || ')]<|tool_call_end|>'
  WHEN 2 THEN source || '<|tool_call_start|>[read(raw=''<' || {safe} || ''')]<|tool_call_end|>' ELSE source END AS shown FROM documents"""))
def render_tool_calls(spark, sf):
    from chatloom.operators import call_udfs as U

    rows = texts(spark, sf, LISTED.replace("\\", "\\\\"), "calls")
    return rows.select("doc_id", U.render_udf("calls", "source").alias("shown"))


REFERENCE = "CASE doc_id % 3 WHEN 0 THEN '{''name'': ''shell'', ''arguments'': {''cmd'': ''' || {safe} || ''', ''n'': ' || n_chars || '}}' WHEN 1 THEN '{''value'': 1}' ELSE 'see ' || {safe} END"


@query(duck(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<|tool_call_start|>[bash(command=''' || {{safe}} || ''', n=' || n_chars || ')]<|tool_call_end|>' ELSE {REFERENCE} END AS reply FROM documents"))
def reference_answers(spark, sf):
    from chatloom.operators import call_udfs as U

    return texts(spark, sf, REFERENCE).select("doc_id", U.reference_udf("t").alias("reply"))


DUCK_NAMES = r"list_sort(list_distinct(flatten(list_transform(regexp_extract_all(t, '(?s)<\|tool_call_start\|>(.*?)<\|tool_call_end\|>', 1), lambda b: regexp_extract_all(b, '(?:\[|,)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)))))"


@query(duck(f"SELECT doc_id, array_to_string({DUCK_NAMES}, ',') AS names FROM (SELECT doc_id, {TEXT} AS t FROM documents)"))
def tool_names(spark, sf):
    return texts(spark, sf).select("doc_id", F.array_join(K.tool_names(F.col("t")), ",").alias("names"))


def only_allowed(rows: DataFrame, text: str, allowed: list[str]) -> DataFrame:
    """Rows whose native calls name allowed tools only; that none is left is an error."""
    out = rows.where(F.size(F.array_except(K.tool_names(F.col(text)), F.array(*map(F.lit, allowed)))) == 0)
    if out.isEmpty():
        raise ValueError("no row is left with allowed tools only")
    return out


@query(duck(f"SELECT doc_id FROM (SELECT doc_id, {TEXT} AS t FROM documents) WHERE list_has_all(['bash', 'read'], {DUCK_NAMES})"))
def allowed_tools_filter(spark, sf):
    return only_allowed(texts(spark, sf), "t", ["bash", "read"]).select("doc_id")


@query("""SELECT doc_id, name, CASE WHEN name = 'lsp' AND a IN ('file_path', 'filePath', 'path') THEN 'filePath' WHEN a = 'cmd' THEN 'command' WHEN a IN ('file_path', 'filePath') THEN 'path' WHEN a IN ('old_string', 'oldString') THEN 'oldText' WHEN a IN ('new_string', 'newString') THEN 'newText' ELSE a END AS argument
  FROM (SELECT doc_id, CASE WHEN t IN ('exec_command', 'run_command', 'shell', 'terminal') THEN 'bash' WHEN t IN ('read_file', 'write_file', 'edit_file') THEN replace(t, '_file', '') ELSE t END AS name, a FROM (SELECT doc_id,
    ['exec_command', 'run_command', 'shell', 'terminal', 'read_file', 'write_file', 'edit_file', 'lsp', 'grep'][1 + doc_id % 9] AS t, ['cmd', 'file_path', 'filePath', 'old_string', 'oldString', 'new_string', 'newString', 'path', 'other', 'lang'][1 + n_chars % 10] AS a FROM documents))""")
def tool_aliases(spark, sf):
    tools, names = [*K.TOOLS, "lsp", "grep"], [*K.ARGUMENTS, "path", "other", "lang"]
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (F.col(at) % len(values)).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", K.alias(pick(tools, "doc_id")).alias("name"), pick(names, "n_chars").alias("a"))
    return rows.select("doc_id", "name", K.argument_alias(F.col("name"), F.col("a")).alias("argument"))


KEY = "CASE doc_id % 10 WHEN 0 THEN 'n' WHEN 1 THEN 'n' WHEN 2 THEN 'flag' WHEN 3 THEN 'x' WHEN 4 THEN 'content' WHEN 5 THEN 'path' WHEN 6 THEN 'command' WHEN 7 THEN 'query' WHEN 8 THEN 'todos' ELSE 'options' END"
GOT = """CASE doc_id % 10 WHEN 0 THEN '" ' || n_chars || '"' WHEN 1 THEN '"' || n_chars || '.0"' WHEN 2 THEN '"TRUE "' WHEN 3 THEN '"' || n_chars || '.5"' WHEN 4 THEN '"' || {safe} || '\\r\\n\\n"' WHEN 5 THEN '"' || source || '//' || lang || '/./x"' WHEN 6 THEN '"run ''' || source || ''' ' || lang || '"'
  WHEN 7 THEN '"' || {safe} || '\\n"' WHEN 8 THEN '[' || n_chars || ', "2", "' || lang || '"]' ELSE '{"a": "' || n_chars || '", "path": "./' || source || '"}' END"""
WANT = """CASE doc_id % 10 WHEN 0 THEN n_chars || '' WHEN 1 THEN n_chars || '' WHEN 2 THEN CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END WHEN 3 THEN n_chars || '.5' WHEN 4 THEN '"' || {safe} || '"' WHEN 5 THEN '"' || source || '/' || lang || '/x"' WHEN 6 THEN '"run ' || source || ' ' || lang || '"'
  WHEN 7 THEN '"' || {safe} || '"' WHEN 8 THEN '[' || n_chars || ', 2, "en"]' ELSE '{"a": ' || n_chars || ', "path": "' || source || CASE WHEN lang = 'fr' THEN '/y' ELSE '' END || '"}' END"""


@query("SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN false WHEN 2 THEN lang = 'en' WHEN 7 THEN false WHEN 8 THEN lang = 'en' WHEN 9 THEN lang <> 'fr' ELSE true END AS equal FROM documents")
def elastic_equal(spark, sf):
    from chatloom.operators import call_udfs as U

    sides = [spark_sql(e.replace("\\", "\\\\")) for e in (KEY, GOT, WANT)]
    rows = table(spark, sf, "documents").selectExpr("doc_id", *[f"{e} as {c}" for e, c in zip(sides, ("k", "got", "want"), strict=True)])
    return rows.select("doc_id", U.same_udf("k", "got", "want").alias("equal"))


@query(duck(spans_sql(FORMS)))
def role_spans(spark, sf):
    """Where the parts of calls stand: in native blocks, read or not, and in code with nested, chained and multi-line calls."""
    from chatloom.operators import call_udfs as U

    return U.with_spans(texts(spark, sf).select("doc_id", "t"), "t", "s").select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.start", "s.stop", "s.role")


@query(duck("""WITH d AS (SELECT doc_id, length({safe}) AS v FROM documents) SELECT doc_id, unnest([{'start': 0, 'stop': 1, 'role': 4}, {'start': 2, 'stop': 3, 'role': 1}, {'start': 4, 'stop': 8, 'role': 2}, {'start': 8, 'stop': 9, 'role': 1}, {'start': 9, 'stop': 10, 'role': 3}, {'start': 10, 'stop': 11, 'role': 1},
  {'start': 11, 'stop': 13 + v, 'role': 4}, {'start': 13 + v, 'stop': 14 + v, 'role': 1}, {'start': 15 + v, 'stop': 18 + v, 'role': 2}, {'start': 18 + v, 'stop': 19 + v, 'role': 1}, {'start': 19 + v, 'stop': 20 + v, 'role': 4}, {'start': 20 + v, 'stop': 21 + v, 'role': 1}, {'start': 21 + v, 'stop': 31 + v, 'role': 5}], recursive := true) FROM d"""))
def state_spans(spark, sf):
    """Of two statements: one names a call's result, the other uses it."""
    from chatloom.operators import call_udfs as U

    rows = texts(spark, sf, "'x = load(p=''' || {safe} || ''')' || chr(10) || 'use(x)<|im_end|>'")
    return U.with_spans(rows.select("doc_id", "t"), "t", "s").select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.start", "s.stop", "s.role")


FIRST = r"nullif(regexp_extract(t, '\[\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), '')"


@query(duck(f"""SELECT doc_id, {FIRST} AS first_tool, n > 0 OR t LIKE '%<|tool_call_start|>%' OR t LIKE '%<|tool_call_end|>%' OR {FIRST} IS NOT NULL AS attempted, {FIRST} IS NULL OR {FIRST} IN ('bash', 'read') AS valid,
  CASE WHEN lang = 'en' THEN t LIKE '%<|tool_call_start|>%' AND n > 0 ELSE t NOT LIKE '%<|tool_call_start|>%' AND {FIRST} IS NULL END AS format_correct FROM (SELECT doc_id, lang, {TEXT} AS t, {N_CALLS} AS n FROM documents)"""))
def call_shapes(spark, sf):
    from chatloom.operators import call_udfs as U

    rows, t = U.with_parse(texts(spark, sf).select("doc_id", "lang", "t"), "t", "p"), F.col("t")
    calls = F.col("p.calls")
    return rows.select("doc_id", K.first_tool(t).alias("first_tool"), K.attempted(t, calls).alias("attempted"), K.well_formed(t, F.array(F.lit("bash"), F.lit("read"))).alias("valid"), K.shape_fits(t, F.col("lang") == "en", calls).alias("format_correct"))


@query(r"""SELECT doc_id, n_chars % 3 <> 0 AND CASE WHEN lang = 'en' THEN contains(s, 'the') AND contains(s, source) WHEN lang = 'fr' THEN contains(s, 'le la') ELSE s <> '' END AS passes FROM (SELECT *, trim(regexp_replace(lower(text || ' ' || source), '\s+', ' ', 'g')) AS s FROM documents)""")
def direct_answers(spark, sf):
    rows = table(spark, sf, "documents").withColumn("content", F.concat_ws(" ", "text", "source"))
    terms = F.when(F.col("lang") == "en", F.array(F.lit(" THE "), F.lit("  "), F.upper("source"))).when(F.col("lang") == "fr", F.array(F.lit("Le la"))).otherwise(F.array(F.lit(" ")))
    return rows.select("doc_id", K.answers_directly(F.col("content"), F.col("n_chars") % 3 == 0, terms).alias("passes"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(text || '<|pad|>', '<|im_end|>', ''), '<|pad|>', ''), '^\s+|\s+$', '', 'g') AS content, CASE WHEN lang = 'en' THEN rtrim(text || chr(10) || chr(10), chr(10)) ELSE text || chr(10) || chr(10) END AS diagnostic FROM documents")
def clean_texts(spark, sf):
    key, value = F.when(F.col("lang") == "en", "content").otherwise("query"), F.concat("text", F.lit("\r\n\n"))
    return table(spark, sf, "documents").select("doc_id", K.cleaned_column(F.concat("text", F.lit("<|pad|>"))).alias("content"), K.unpadded(key, value).alias("diagnostic"))


@query("SELECT doc_id, source || '(lang=''' || lang || ''', text=''' || text || ''')' AS call FROM documents")
def naive_kwargs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.naive_call(F.col("source"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))).alias("call"))


@query(r"""SELECT doc_id, contains(t, '<tool_call>') OR regexp_full_match(trim(t), '(?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*\s*\([^\n]*\)') OR lang = 'fr' AS attempted FROM (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN source || '.run(' || n_chars || ')' WHEN 1 THEN 'see <tool_call> ' || source ELSE text END AS t FROM documents)""")
def legacy_attempts(spark, sf):
    t = "CASE doc_id % 3 WHEN 0 THEN source || '.run(' || n_chars || ')' WHEN 1 THEN 'see <tool_call> ' || source ELSE text END"
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"array({t}, CASE WHEN lang = 'fr' THEN 'go( x )' ELSE '-' END) as t")
    return rows.select("doc_id", K.looks_like_call(F.col("t")).alias("attempted"))


PREDICTION = """CASE doc_id % 6 WHEN 0 THEN '[["' || {safe} || '"]]' WHEN 1 THEN '["Error: ' || source || '"]' WHEN 2 THEN '[["find(lang=1, n=2)"], ["' || lang || '"]]' WHEN 3 THEN '"find the lang ' || lang || ' of ' || source || '"' WHEN 4 THEN '[["' || source || '.run(1)"]]' ELSE '"go ' || lang || '"' END"""
ANSWER = """CASE doc_id % 6 WHEN 2 THEN '{"ground_truth": [["x.find(lang=3, n=4)"], ["stop(now=1)"]]}' WHEN 3 THEN '{"ground_truth": [{"a.find": {"lang": 5, "of": ["src1", "src2"]}}]}' WHEN 5 THEN '{"possible_answers": ["go en", "x.go(1)"]}' END"""
ROW = "CASE WHEN doc_id % 6 IN (0, 4) THEN 'irrelevance' ELSE 'simple' END"


@query(duck("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NOT (contains(s, 'def ') OR contains(s, 'invoke')) WHEN 3 THEN contains(source, 'src1') OR contains(source, 'src2') WHEN 5 THEN lang = 'en' ELSE false END AS strict,
  CASE doc_id % 6 WHEN 0 THEN NOT (contains(s, 'def ') OR contains(s, 'invoke')) WHEN 2 THEN true WHEN 3 THEN true WHEN 5 THEN true ELSE false END AS elastic FROM (SELECT *, {safe} AS s FROM documents)"""))
def legacy_scorer(spark, sf):
    from chatloom.operators import call_udfs as U

    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{spark_sql(PREDICTION)} as p", f"{ANSWER} as a", f"{ROW} as c", "CAST(NULL AS BOOLEAN) as tried")
    return rows.select("doc_id", U.legacy_udf("p", "a", "c", "tried").alias("r")).select("doc_id", "r.strict", "r.elastic")


NESTED = """'{"a": ["' || {safe} || '", {"n": ' || n_chars || ', "z": null}], "b": {"c": ["' || lang || '", "' || source || '"]}}'"""


@query(duck("SELECT doc_id, unnest([{safe}, n_chars || '', lang, source]) AS leaf FROM documents"))
def leaf_scalars(spark, sf):
    from chatloom.operators import call_udfs as U

    return texts(spark, sf, NESTED).select("doc_id", F.explode(U.leaves_udf("t")).alias("leaf"))


QUESTION = """CASE doc_id % 3 WHEN 0 THEN '["' || {safe} || '", [{"role": "system", "content": "' || lang || '"}]]' WHEN 1 THEN '{"role": "user", "content": "' || {safe} || '"}' ELSE 'plain ' || {safe} END"""


@query(duck("SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [{'role': 'user', 'content': {safe}}, {'role': 'system', 'content': lang}] WHEN 1 THEN [{'role': 'user', 'content': {safe}}] ELSE [{'role': 'user', 'content': 'plain ' || {safe}}] END, recursive := true) FROM documents"))
def question_messages(spark, sf):
    from chatloom.operators import call_udfs as U

    return texts(spark, sf, QUESTION).select("doc_id", F.explode(U.messages_udf("t")).alias("m")).select("doc_id", "m.role", "m.content")
