"""Conversations as prompt/completion examples, and instruction records of several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import sha


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn with at least one turn before it: the turns before as prompt, it as completion, and its place.

    turns: conv_id, turn, role, text. One shuffle by conversation gives both the prompt and the turn numbers.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    message = F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role").alias("role"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.where("role is not null").withColumn("message", message).withColumn("prompt", F.collect_list("message").over(before))
    rows = rows.where((F.col("role") == "assistant") & (F.size("prompt") > 0))
    rows = rows.withColumn("turn_index", F.row_number().over(by) - 1).withColumn("turn_count", F.count("*").over(Window.partitionBy("conv_id")).cast("int"))
    rows = rows.withColumn("completion", F.array("message"))
    return rows.select("conv_id", "turn", "turn_index", "turn_count", "prompt", "completion", example_hash(F.col("completion"), F.col("prompt")).alias("example_hash"))


def example_hash(completion: Column, prompt: Column) -> Column:
    return sha(F.to_json(F.struct(completion.alias("completion"), prompt.alias("prompt"))))


def records(turns: DataFrame) -> DataFrame:
    """Each conversation's messages in order and the hash of their canonical JSON, its group id."""
    entry = F.struct("turn", F.struct(F.col("text").alias("content"), F.col("role").alias("role")).alias("m"))
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.m).alias("messages"))
    return rows.withColumn("group_id", sha(F.to_json(F.struct("messages"))))


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def instruction_pairs(rows: DataFrame) -> DataFrame:
    """rows: instruction, question, output, answer, reference_answer, prompt, completion. What one turn asks and answers; rows without both are dropped."""
    ask = first_truthy(F.col("instruction"), F.col("question"))
    reply = first_truthy(F.col("output"), F.col("answer"), F.col("reference_answer"))
    given = ask.isNotNull() & reply.isNotNull()
    out = rows.withColumn("ask", F.when(given, ask).otherwise(F.col("prompt"))).withColumn("reply", F.when(given, reply).otherwise(F.col("completion")))
    return out.where("ask is not null and reply is not null")


def text_of(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m.content), "\n")


def menu_conditioned(rows: DataFrame, menu: str) -> DataFrame:
    """Puts a tool menu in the system message once; without tools nothing changes. rows have prompt."""
    head = F.get("prompt", F.lit(0))
    line = F.lit(f"List of tools: [{menu}]")
    with_menu = F.struct(F.concat(head.content, F.lit("\n"), line).alias("content"), head.role.alias("role"))
    own = F.struct(line.alias("content"), F.lit("system").alias("role"))
    rest = F.slice("prompt", F.lit(2), F.greatest(F.size("prompt") - 1, F.lit(0)))
    changed = F.when(head.role != "system", F.concat(F.array(own), F.col("prompt"))).when(head.content.contains("List of tools: ["), F.col("prompt")).otherwise(F.concat(F.array(with_menu), rest))
    return rows.withColumn("prompt", changed) if menu else rows


def first_prompt_dedup(turns: DataFrame, cap: int | None = None) -> DataFrame:
    """Of conversations that open with the same user message, the first; at most cap of them."""
    opening = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    first = opening.groupBy("opening").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("conversations"))
    return first if cap is None else first.orderBy("conv_id").limit(cap)


#: What a category's name says about its calls.
TYPED_NAMES = ("java", "javascript", "sql", "typed")


def capabilities(rows: DataFrame) -> DataFrame:
    """rows: turn and meta (structs of flags, each may be null), structure, category, expected_tool, inferred_tool, turn_index, turn_count.

    What the turn's metadata says comes first, then the record's, then its structure, then what the category and the text suggest.
    """
    category = F.lower(F.coalesce("category", F.lit("canonical")))
    said = lambda name, *rest: F.coalesce(F.col(f"turn.{name}"), F.col(f"meta.{name}"), *rest)
    tool = said("is_tool", F.col("expected_tool").isNotNull() | F.coalesce("inferred_tool", F.lit(False)))
    typed = tool
    for name in TYPED_NAMES:
        typed = typed | category.contains(name)
    calls = said("expected_call_count", F.col("structure.expected_call_count"), F.lit(1))
    return rows.withColumns({
        "cap_is_tool": tool.cast("int"), "cap_is_parallel": said("is_parallel", category.contains("parallel")).cast("int"), "cap_is_multiturn": said("is_multiturn", (F.col("turn_count") > 1) | category.contains("multi_turn") | category.contains("multiturn")).cast("int"),
        "cap_is_typed": said("is_typed", typed).cast("int"), "trajectory_weight": 1.0 / F.greatest(F.lit(1), F.col("turn_count")), "cap_is_docstring_derived": said("is_docstring_derived", F.col("structure.is_docstring_derived"), F.lit(False)).cast("int"),
        "cap_expected_call_count": F.greatest(F.lit(1), F.coalesce(F.nullif(calls, F.lit(0)), F.lit(1))).cast("int"),
    })


#: How turns of a dialogue begin, and how a call is written in them.
SPEAKERS = r"(?:USER|ASSISTANT|FUNCTION RESPONSE):"
WRITTEN_CALL = r"(?s)<functioncall>\s*(\{.*?\}(?:\s*\})?)"


def dialogues(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, system, chat): messages, category and expected_tool of each dialogue; of equal openings the first, `most` at most.

    Calls become native ones, answers of functions the user's; a dialogue with an unreadable call goes, and so does one of fewer than three messages.
    """
    from chatloom.operators import call_udfs as U

    turns = F.split(F.trim("chat"), rf"\n\n(?={SPEAKERS})")
    said = rows.select(key, "system", F.posexplode(turns).alias("pos", "turn")).withColumn("turn", F.regexp_replace("turn", r"(?U)^\s+|\s+$", ""))
    said = said.withColumn("who", F.regexp_extract("turn", f"^({SPEAKERS})", 1)).where("who <> ''").withColumn("content", F.trim(F.regexp_replace("turn", f"^{SPEAKERS}", "")))
    said = said.withColumn("content", F.when(F.col("who") == "ASSISTANT:", F.trim(F.replace("content", F.lit("<|endoftext|>"), F.lit("")))).otherwise(F.col("content")))
    said = said.withColumn("calls", F.when(F.col("who") == "ASSISTANT:", F.regexp_extract_all("content", F.lit(WRITTEN_CALL), F.lit(1))).otherwise(F.array().cast("array<string>")))
    said = said.withColumn("readable", F.forall("calls", lambda c: F.try_parse_json(c).isNotNull()))
    shown = U.render_udf(F.concat(F.lit("["), F.array_join("calls", ","), F.lit("]")), F.lit(""))
    content = F.when(F.size("calls") > 0, shown).when(F.col("who") == "FUNCTION RESPONSE:", F.concat(F.lit("[Tool Output: "), F.col("content"), F.lit("]"))).otherwise(F.col("content"))
    message = F.struct(F.when(F.col("who") == "ASSISTANT:", "assistant").otherwise("user").alias("role"), content.alias("content"))
    whole = said.withColumn("m", F.struct("pos", message.alias("message"))).groupBy(key).agg(
        F.first("system").alias("system"), F.array_sort(F.collect_list("m")).alias("list"), F.max(F.size("calls") > 0).alias("tool"), F.min("readable").alias("valid"), F.min_by("content", F.when(F.col("who") == "USER:", F.col("pos"))).alias("opening"))
    head = F.struct(F.lit("system").alias("role"), F.trim(F.regexp_replace("system", r"SYSTEM:\s*", "")).alias("content"))
    whole = whole.withColumn("messages", F.concat(F.array(head), F.transform("list", lambda x: x["message"]))).where(F.col("valid") & (F.size("messages") >= 3))
    first = Window.partitionBy("opening").orderBy(key)
    whole = whole.withColumn("rn", F.row_number().over(first)).where("rn = 1").orderBy(key).limit(most)
    category = F.when(F.size("messages") > 3, "glaive_multiturn").when(F.col("tool"), "glaive_single").otherwise("rehearsal")
    return whole.select(key, "messages", category.alias("category"), F.when(F.col("tool"), "external_tool").alias("expected_tool"))
