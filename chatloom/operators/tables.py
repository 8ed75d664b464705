"""Tables with rules: closures, grids, gates, fitness, audits, mutations. Each takes and gives DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions.text import sha
from chatloom.sources.shared import kept


def share(hits: str, of: str) -> Column:
    """The share of rows, 0 where there are none."""
    return F.expr(f"count_if({hits}) / greatest(1, count_if({of}))")


def rates(rows: DataFrame, terms: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """All the shares at once: one aggregation, whatever their number."""
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), *[share(a, b).alias(name) for name, (a, b) in terms.items()])


def melted(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return rows.select(*by, F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (metric, x)"))


def deltas(rows: DataFrame, by: str, base: object, names: list[str]) -> DataFrame:
    """Every metric less the base row's; what is missing counts as 0."""
    long = melted(rows, [by], names)
    first = long.where(F.col(by) == F.lit(base)).select("metric", F.col("x").alias("b"))
    out = long.join(F.broadcast(first), "metric", "left")  # a row a metric
    return out.select(by, "metric", (F.coalesce("x", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def weighted(terms: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(n) for n, w in terms.items()])


def best_by(rows: DataFrame, label: str, *keys: str) -> DataFrame:
    """The label whose keys are largest in order; one row, null for no rows."""
    return rows.agg(F.max_by(label, F.struct(*keys)).alias("winner"))


def dual_seed(scores: DataFrame, by: str, score: str, seeds: int = 2) -> DataFrame:
    """Of each `by`: mean, worst, deviation and robust score over its seeds. Another number of seeds is an error."""
    rows = scores.groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("worst"), F.stddev_pop(score).alias("std"))
    wrong = F.raise_error(F.concat(F.lit(f"exactly {seeds} seed scores are required for "), F.col(by).cast("string")))
    rows = rows.withColumn("mean", F.when(F.col("n") == seeds, F.col("mean")).otherwise(wrong.cast("double")))
    return rows.withColumn("robust", 0.7 * F.col("mean") + 0.3 * F.col("worst") - 0.15 * F.col("std")).drop("n")


def closure(entries: DataFrame, needs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of wanted (id) and all that they need over needs (id, need), whatever the depth. An id that entries (id) lacks is an error.

    Every round joins only what the round before added, so a cycle ends and no edge is walked twice; what was found is put in one table now and then.
    """
    found = fresh = kept(wanted.select("id").distinct(), "closure")
    rounds = 0
    while not fresh.isEmpty():
        rounds += 1
        if rounds % 8 == 0:
            found = kept(found, "closure")
        lost = fresh.join(entries, "id", "left_anti").orderBy("id").limit(5).collect()
        if lost:
            raise ValueError(f"missing ids: {[r['id'] for r in lost]}")
        step = needs.join(fresh, "id").select(F.col("need").alias("id")).distinct().join(found, "id", "left_anti")
        fresh = kept(step, "closure")
        found = found.unionByName(fresh)
    return entries.join(found, "id", "left_semi")


def aligned(selected: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """selected with what answers has for its key; a row without an answer is an error that shows the first five."""
    lost = selected.join(answers, key, "left_anti").orderBy(key).limit(5).collect()
    if lost:
        raise ValueError(f"no answers for {[r[key] for r in lost]}")
    return selected.join(answers, key)


def grid(spark: SparkSession, domains: dict[str, list], seed: str, most: int = 100_000, draws: int = 1000) -> DataFrame:
    """All combinations of the domains' values in a drawn order; of more than `most`, `draws` drawn ones (a cell may come twice).

    Cells are numbers in mixed radix, so neither way needs a product of tables.
    """
    total = reduce(lambda a, b: a * b, [len(v) for v in domains.values()], 1)
    if total <= most:
        rows = spark.range(total).select(F.col("id").alias("cell")).withColumn("key", sha(F.concat(F.lit(f"{seed}:"), F.col("cell").cast("string"))))
    else:
        digits = F.conv(F.substring(sha(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("long")
        rows = spark.range(draws).select((digits % total).alias("cell"), F.lpad(F.col("id").cast("string"), 12, "0").alias("key"))
    return unranked(rows, domains)


def unranked(cells: DataFrame, domains: dict[str, list]) -> DataFrame:
    """cells (cell, ...) with the value of each domain that their number stands for."""
    below = 1
    for name, values in domains.items():
        cells = cells.withColumn(name, F.get(F.array(*map(F.lit, values)), (F.floor(F.col("cell") / below) % len(values)).cast("int")))
        below *= len(values)
    return cells


#: The gates that a cell has to pass.
GATES = "specificity >= 0.60 and recall >= 0.85 and balanced >= 0.70 and mcc > 0.0"


def screened(rows: DataFrame, by: str, base: object) -> DataFrame:
    """Whether each row (recall, specificity, balanced, mcc, named_accuracy, exact_accuracy) passes, its score, and whether it is the one to take."""
    first = rows.where(F.col(by) == F.lit(base)).agg(F.coalesce(F.max("named_accuracy"), F.lit(0.0)).alias("bt"), F.coalesce(F.max("exact_accuracy"), F.lit(0.0)).alias("be"))
    rows = rows.join(F.broadcast(first))  # one row
    score = weighted({"balanced": 0.30, "specificity": 0.15, "recall": 0.15, "named_accuracy": 0.20, "exact_accuracy": 0.20})
    rows = rows.withColumn("passes", F.expr(f"{GATES} and named_accuracy >= bt - 0.02 and exact_accuracy >= be")).withColumn("score", score).drop("bt", "be")
    best = rows.where("passes").agg(F.max_by(by, F.struct("score", by)).alias("best"))
    return rows.join(F.broadcast(best)).withColumn("recommended", F.coalesce(F.col(by) == F.col("best"), F.lit(False))).drop("best")  # one row


# Preference pairs.

TYPED = "array<struct<key:string,kind:string,value:string,items:array<string>>>"


def shown_value(v: Column) -> Column:
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    items = F.concat(F.lit("["), F.array_join(F.transform(v["items"], quoted), ", "), F.lit("]"))
    return F.when(v["kind"] == "text", quoted(v["value"])).when(v["kind"] == "list", items).otherwise(v["value"])


def shown_call(tool: Column, arguments: Column) -> Column:
    """A native call of arguments whose values are shown: array of (key, shown)."""
    return F.concat(F.lit("<|tool_call_start|>["), tool, F.lit("("), F.array_join(F.transform(arguments, lambda a: F.concat(a["key"], F.lit("="), a["shown"])), ", "), F.lit(")]<|tool_call_end|>"))


def corrupted(v: Column) -> Column:
    """A near miss of a value: a flag turned, a number one more, a text with an ending, a list without its last."""
    shorter = F.transform(F.slice(v["items"], F.lit(1), F.greatest(F.size(v["items"]) - 1, F.lit(0))), lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    some = F.concat(F.lit("["), F.array_join(shorter, ", "), F.lit("]"))
    return (
        F.when(v["kind"] == "flag", F.when(v["value"] == "True", "False").otherwise("True")).when(v["kind"] == "whole", (v["value"].cast("long") + 1).cast("string"))
        .when(v["kind"] == "text", F.concat(F.lit("'"), v["value"], F.lit("__near_miss'"))).when(F.size(v["items"]) > 0, some).otherwise("[{'content': 'wrong', 'status': 'pending'}]")
    )


#: How a right call is turned into a wrong one, by a row's position.
MUTATIONS = ["missing-key", "wrong-value", "extra-key", "wrong-type", "wrong-tool", "extra-prose"]


def near_misses(rows: DataFrame, tools: list[str]) -> DataFrame:
    """rows (idx long, prompt, tool, arguments as TYPED): chosen, rejected and the kind of mutation. A row without a tool is answered with a needless call."""
    args = F.transform("arguments", lambda a: F.struct(a["key"].alias("key"), shown_value(a).alias("shown")))
    rows = rows.withColumn("a", args).withColumn("head", F.get("arguments", F.lit(0)))
    head, some, rest = F.col("head"), F.size("a") > 0, F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))
    with_first = lambda shown: F.when(some, F.concat(F.array(F.struct(head["key"].alias("key"), shown.alias("shown"))), rest)).otherwise(F.col("a"))
    kind = F.get(F.array(*map(F.lit, MUTATIONS)), F.pmod("idx", F.lit(len(MUTATIONS))).cast("int"))
    extra = F.concat(F.col("a"), F.array(F.struct(F.lit("unrequested").alias("key"), F.concat(F.lit("'extra-"), F.when(F.col("idx") < 10_000, F.lpad(F.col("idx").cast("string"), 4, "0")).otherwise(F.col("idx").cast("string")), F.lit("'")).alias("shown"))))
    changed = (
        F.when(F.col("mutation") == "missing-key", rest).when(F.col("mutation") == "wrong-value", with_first(corrupted(head))).when(F.col("mutation") == "extra-key", extra)
        .when(F.col("mutation") == "wrong-type", with_first(F.concat(F.lit("{'wrong': "), shown_value(head), F.lit("}")))).otherwise(F.col("a"))
    )
    names = F.array(*map(F.lit, tools))
    at = F.array_position(names, F.col("tool"))
    other = F.when(at == 0, "read").otherwise(F.element_at(names, (at % len(tools) + 1).cast("int")))
    rows = rows.withColumn("mutation", F.when(F.col("tool").isNull(), "overtrigger").otherwise(kind))
    chosen = F.when(F.col("tool").isNull(), F.lit("")).otherwise(shown_call(F.col("tool"), F.col("a")))
    needless = F.concat(F.lit("<|tool_call_start|>[websearch(query='"), F.substring("prompt", 1, 96), F.lit("')]<|tool_call_end|>"))
    wrong = F.concat(F.when(F.col("mutation") == "extra-prose", "Certainly.\n").otherwise(""), shown_call(F.when(F.col("mutation") == "wrong-tool", other).otherwise(F.col("tool")), changed))
    return rows.withColumn("chosen", chosen).withColumn("rejected", F.when(F.col("tool").isNull(), needless).otherwise(wrong)).drop("a", "head")


# Expectations and rules.


def normalized(c: Column) -> Column:
    """As people write names: camel case apart, underscores and white space as blanks, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")), r"(?U)[_\s]+", " "))


def grounded(prompt: Column, required: Column) -> Column:
    """Whether every required argument (array of (kind, value, items)) can be seen in the prompt; flags always can, a missing one can't."""
    said = normalized(prompt)
    seen = lambda v: F.contains(said, normalized(v))
    return F.forall(required, lambda a: F.when(a["kind"] == "flag", True).when(a["kind"] == "list", F.forall(a["items"], seen)).when(a["value"].isNull(), False).otherwise(seen(a["value"])))


def problems(rules: list[tuple[Column, Column]]) -> Column:
    """The messages of the rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]))


def status(found: Column, blocked: str = "blocked", fine: str = "ready") -> Column:
    return F.when(F.size(found) > 0, blocked).otherwise(fine)


def gene_problems(cap: int = 1408, rank: int = 16) -> Column:
    """The caps. Of genes (sequence_length, lora_rank, target_profile, value_weight, intent_weight; null counts as the safe default, but for the profile)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return problems([
        (F.coalesce("sequence_length", F.lit(cap)) > cap, F.lit(f"sequence length exceeds {cap}")), (F.coalesce("lora_rank", F.lit(rank)) > rank, F.lit(f"rank exceeds {rank}")),
        (~F.col("target_profile").eqNullSafe("attention"), F.lit("only the attention profile is allowed")), ((zero("value_weight") > 0) | (zero("intent_weight") > 0), F.lit("consistency adds a second forward pass")),
    ])


def corpus_audit(rows: DataFrame, folds: DataFrame, per_category: int | None, per_fold: int | None) -> DataFrame:
    """rows and folds: (h, category, menus, parsed; folds also fold). One row: the counts that are expected to hold, the problems, the status.

    Everything comes from aggregations of two tables and one join by hash; nothing is compared pair by pair.
    """
    def uniform(counts: DataFrame, by: list[str], wanted: int | None) -> DataFrame:
        right = F.min("n") == F.max("n") if wanted is None else (F.min("n") == wanted) & (F.max("n") == wanted)
        return counts.groupBy(*by, "category").agg(F.count("*").alias("n")).agg(F.coalesce(right, F.lit(False)).alias("even"))

    own = rows.agg(F.count("*").alias("rows"), F.countDistinct("h").alias("distinct_rows"), F.count_if(F.col("menus") != 1).alias("odd_menus"), F.count_if(~F.col("parsed")).alias("unreadable"))
    dev = folds.agg(F.count("*").alias("fold_rows"), F.countDistinct("fold", "h").alias("distinct_fold_rows"), F.count_if(F.col("menus") != 1).alias("odd_fold_menus"), F.count_if(~F.col("parsed")).alias("unreadable_folds"))
    shared = folds.select("h", "fold").distinct().join(rows.select("h").distinct(), "h", "left_semi").agg(F.count("*").alias("train_overlap"))
    across = folds.groupBy("h").agg(F.countDistinct("fold").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, 1)), F.lit(0)).alias("fold_overlap"))
    parts = [own, dev, uniform(rows, [], per_category), uniform(folds, ["fold"], per_fold).withColumnRenamed("even", "even_folds"), shared, across]
    out = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    found = problems([
        (~F.col("even"), F.lit("unexpected category distribution")), (F.col("distinct_rows") < F.col("rows"), F.lit("rows are not unique")), (~F.col("even_folds"), F.lit("unexpected fold distribution")),
        (F.col("distinct_fold_rows") < F.col("fold_rows"), F.lit("fold rows are not unique")), (F.col("train_overlap") > 0, F.lit("training overlaps folds")), (F.col("fold_overlap") > 0, F.lit("folds overlap")),
        (F.col("odd_menus") + F.col("odd_fold_menus") > 0, F.lit("every prompt must have one menu")), (F.col("unreadable") + F.col("unreadable_folds") > 0, F.lit("calls are not readable")),
    ])
    return out.withColumn("problems", F.array_join(found, "; ")).withColumn("status", status(found))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def latest_of(rows: DataFrame, label: str, *times: str) -> DataFrame:
    """The label of the newest row by the first of its times that is given."""
    return rows.agg(F.max_by(label, F.struct(F.coalesce(*times), label)).alias(label))


def first_of_each(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first row of every key in order, `most` of them at most."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn").orderBy(order).limit(most)


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def coordinate(role: Column, is_tool: Column, several: Column, typed: Column) -> Column:
    """The points. The target of a token: action, arity and syntax by its role (0 ordinary, 1 and 5 marks, 2 tool name, 3 and 4 arguments)."""
    point = lambda *v: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in v])
    arity, strict = several.cast("double"), typed.cast("double")
    thought = F.when(several, point(0.05, 0.85, 0.10)).otherwise(point(0.0, 0.0, 0.0))
    return (
        F.when(~is_tool, point(0.0, 0.0, 0.0)).when(role == 0, thought).when(role == 2, point(1.0, arity, 1.0)).when(role.isin(3, 4), point(1.0, arity, F.when(typed, 1.0).otherwise(0.88)))
        .when(role.isin(1, 5), point(1.0, arity, 0.92)).otherwise(point(1.0, arity, strict))
    )


#: Categories whose ids stand for several cases, and which scopes take which kind.
VARIANTS = {"memory": ["kv", "vector", "rec_sum"], "web_search": ["base", "no_snippet"]}
MULTI_TURN, AGENTIC = ("multi-turn", "single-and-multi", "all"), ("agentic", "all")


def expanded(rows: DataFrame, scope: str) -> DataFrame:
    """rows (kind, id) that a scope takes, once for each variant of their kind: category, id."""
    turns, agents = F.col("kind").startswith("multi_turn"), F.col("kind").isin(*VARIANTS)
    taken = F.when(turns, F.lit(scope in MULTI_TURN)).when(agents, F.lit(scope in AGENTIC)).otherwise(F.lit(scope not in ("multi-turn", "agentic")))
    names = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    some = rows.where((F.col("kind") != "format_sensitivity") & taken).select("kind", "id", F.explode_outer(F.element_at(names, F.col("kind"))).alias("v"))
    at, own = F.instr("id", F.col("kind")), F.concat("kind", F.lit("_"), "v")
    first = F.concat(F.substring("id", F.lit(1), at - 1), own, F.substring("id", at + F.char_length("kind"), F.char_length("id")))
    return some.select(F.coalesce(own, "kind").alias("category"), F.coalesce(first, "id").alias("id"))


def bound(names: DataFrame, key: str) -> DataFrame:
    """names (key, name, start, gives): every use with the start of the latest giving of that name before it."""
    before = Window.partitionBy(key, "name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return names.withColumn("producer", F.last(F.when(F.col("gives"), F.col("start")), ignorenulls=True).over(before)).where("not gives")


def suite_profile(rows: DataFrame, with_tool: Column, skeleton: str) -> DataFrame:
    """How many examples a suite has, how many of them call, how many kinds of prompts there are, and what that warns of."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(with_tool).alias("tool_samples"), F.countDistinct(skeleton).alias("skeletons"))
    plain = F.col("n") - F.col("tool_samples")
    return out.withColumn("warnings", problems([
        (F.least("tool_samples", plain) < 0.5 * F.greatest(F.lit(1), F.col("tool_samples"), plain), F.lit("tool and other answers are imbalanced")), (F.col("skeletons") < F.greatest(F.lit(10), F.floor(F.col("n") / 5)), F.lit("prompts are alike")),
    ]))


def fingerprint(rows: DataFrame, number: str, order: list[str], h: str, levels: int = 2, width: int = 1024) -> DataFrame:
    """One hash of all rows' hashes h in order, repeats included; number is the whole number that order begins with."""
    join = lambda keys, c: sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col(c).alias("_h")))), lambda x: x["_h"]), "\n"))
    level = rows.groupBy(F.floor(F.col(number) / width).alias("b")).agg(join(order, h).alias("h"))
    for _ in range(levels - 1):
        level = level.groupBy(F.floor(F.col("b") / width).alias("up")).agg(join(["b"], "h").alias("h")).withColumnRenamed("up", "b")
    return level.agg(join(["b"], "h").alias("fingerprint"))
