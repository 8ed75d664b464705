"""Generated rows and corpora: tool menus, balanced suites from templates, assembly into folds and sides. Rows come from ranges, not from the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import sha
from chatloom.operators import sampling as S
from chatloom.operators import tables as T

#: Tools with the types of their arguments, those that are required, and what they do.
TOOLS = {
    "bash": ({"command": "string", "timeout": "integer"}, ["command"], "Run a command."),
    "glob": ({"pattern": "string", "path": "string"}, ["pattern"], "Find files by pattern."),
    "grep": ({"pattern": "string", "path": "string", "include": "string"}, ["path", "pattern"], "Search in files."),
    "read": ({"path": "string", "limit": "integer", "offset": "integer"}, ["path"], "Read a file."),
    "write": ({"path": "string", "content": "string"}, ["content", "path"], "Write a file."),
}
TYPES = {"array": {"type": "array", "items": {"type": "string"}}}


def menu_schemas(names: list[str]) -> dict[str, dict]:
    """The function schema of each tool; an unknown one takes any arguments."""
    out = {}
    for name in sorted(set(names)):
        types, required, does = TOOLS.get(name, ({}, [], f"Call the {name} tool."))
        properties = {k: TYPES.get(v, {"type": v}) for k, v in types.items()}
        out[name] = {"type": "function", "function": {"name": name, "description": does, "parameters": {"type": "object", "properties": properties, "required": sorted(required), "additionalProperties": not types}}}
    return out


def tool_menu(rows: DataFrame) -> DataFrame:
    """rows (tool): each distinct tool with its schema; tools are few, rows need not be."""
    names = rows.select("tool").distinct()
    known = F.create_map(*[F.lit(x) for name, s in menu_schemas(list(TOOLS)).items() for x in (name, json.dumps(s))])
    other = F.concat(F.lit('{"type": "function", "function": {"name": "'), F.col("tool"), F.lit('", "description": "Call the '), F.col("tool"), F.lit(' tool.", "parameters": {"type": "object", "properties": {}, "required": [], "additionalProperties": true}}}'))
    return names.select("tool", F.coalesce(F.element_at(known, F.col("tool")), other).alias("schema"))


def menu_prompt(policy: str, names: list[str]) -> str:
    """A system prompt that lists the tools after the policy."""
    menu = f"List of tools: [{', '.join(json.dumps(s) for s in menu_schemas(names).values())}]"
    return f"{policy.strip()}\n{menu}" if policy.strip() else menu


#: What suites are made of: a category's tool, its request and its required argument, both with the row's words.
CATEGORIES = {
    "run": ("bash", "Please run make target-{} for me.", "command", "make target-{}"),
    "find": ("glob", "Which files match src/part{}/*.py here?", "pattern", "src/part{}/*.py"),
    "search": ("grep", "Look for TODO-{} in the sources.", "pattern", "TODO-{}"),
    "open": ("read", "Show me notes/page{}.md please.", "path", "notes/page{}.md"),
    "rehearsal": (None, "What is a good name for item {}?", None, None),
}
SPLITS = ["train", "dev", "sealed"]


def suite(words: DataFrame) -> DataFrame:
    """A row for each of words (id, whole numbers), category and split, no two alike: split, category, case_id, prompt, request, tool, key, value."""
    lookup = words.sparkSession.createDataFrame([(c, t, p, k, v) for c, (t, p, k, v) in CATEGORIES.items()], "category string, tool string, template string, key string, pattern string")
    sides = F.explode(F.array(*map(F.lit, SPLITS)))
    words = words.select("id").repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "id")  # a small file is one task, its suite isn't small
    rows = words.select("id", sides.alias("split")).join(F.broadcast(lookup))  # a row a category
    word = F.concat(F.substring(F.col("split"), 1, 1), F.lpad(F.col("id").cast("string"), F.greatest(F.lit(5), F.length(F.col("id").cast("string"))), "0"))
    filled = lambda c: F.replace(F.col(c), F.lit("{}"), word)
    menu = F.lit(menu_prompt("Use a tool where one fits.", list(TOOLS)) + "\n")
    return rows.select("split", "category", F.concat_ws("-", "split", "category", "id").alias("case_id"), F.concat(menu, filled("template")).alias("prompt"), filled("template").alias("request"), "tool", "key", filled("pattern").alias("value"))


def short(c: Column) -> Column:
    """What stands for a long text where only equality counts: 32 bytes."""
    return F.unhex(sha(c))


def audited(rows: DataFrame) -> DataFrame:
    """Of each category the verdict over all splits, and how many rows ask for an argument that the request doesn't show."""
    shown = T.grounded(F.col("request"), F.array(F.struct(F.lit("text").alias("kind"), F.col("value").alias("value"), F.lit(None).cast("array<string>").alias("items"))))
    out = rows.withColumn("shown", F.col("tool").isNull() | shown).groupBy("category").agg(
        F.count("*").alias("n"), F.countDistinct(short(F.col("prompt"))).alias("distinct_n"), F.size(F.collect_set("split")).alias("splits"), F.count_if(~F.col("prompt").contains("List of tools: [")).alias("bare"), F.count_if(~F.col("shown")).alias("ungrounded"))
    found = T.problems([(F.col("distinct_n") < F.col("n"), F.lit("repeated")), (F.col("splits") != len(SPLITS), F.lit("splits")), (F.col("bare") > 0, F.lit("menu")), (F.col("ungrounded") > 0, F.lit("ungrounded"))])
    return out.select("category", T.status(found).alias("status"), "ungrounded")


def assembled(rows: DataFrame, key: str, seed: str, share: float = 0.85, folds: int = 3) -> DataFrame:
    """rows (key, h, ...) in a drawn order: the first part trains, the rest develops, both in folds; training rows whose h the others have go."""
    order = S.draw(seed, F.col(key))
    rows = S.ranked(rows, "rn", S.drawn_bucket(order), [order])
    rows = rows.withColumn("side", F.when(F.col("rn") <= F.floor(F.col("n") * share), "train").otherwise("dev")).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(folds))).drop("rn", "n")
    train, dev = rows.where("side = 'train'"), rows.where("side = 'dev'")
    return train.join(dev.select("h").distinct(), "h", "left_anti").unionByName(dev)


def identity(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumn("h", sha(F.to_json(F.struct(*sorted(names)))))
