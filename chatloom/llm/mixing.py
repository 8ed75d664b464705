"""Mixing sources to target weights with budgets that follow a domain - language - source tree.

A token budget is shared out from the root by the weights of each node's children. No node can take more than its texts give in
`max_epochs` passes; what one cannot take goes to its siblings by their weights, and only what a whole subtree cannot take goes up
to the siblings of its ancestors. A leaf's budget is then filled: whole epochs as often as they fit, and of the next epoch, in an
order drawn from the seed and the epoch's number, the longest prefix that fits.

Prefixes are found without sorting a leaf: its rows are dealt by their random order to buckets of bounded size, bucket totals are
added up, and only the bucket where the budget ends is summed row by row. Null levels form a node of their own. Tokens are words;
null and empty texts have none, very long ones all of theirs. Rows that repeat exactly are taken or left together, as one of all their
words. Other columns pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.store import kept, numbered_columns

WORD = r"[^\x20\x09-\x0D]+"
ROWS = 5_000


def poured(amount: Fraction, nodes: dict[str, tuple[Fraction, Fraction]]) -> dict[str, Fraction]:
    """Shares amount among nodes (weight, capacity) by weight; what a full one cannot take goes to the others. Nodes of weight 0 come last, by capacity."""
    got = dict.fromkeys(nodes, Fraction(0))
    for weighted in (True, False):
        open_ = {k: (w if weighted else cap) for k, (w, cap) in nodes.items() if (w > 0) == weighted and cap > 0}
        while open_ and amount > 0:
            whole = sum(open_.values())
            full = {k for k, w in open_.items() if amount * w / whole >= nodes[k][1]}
            if not full:
                return got | {k: amount * w / whole for k, w in open_.items()}
            for k in full:
                got[k] = nodes[k][1]
                amount -= got[k]
                del open_[k]
    return got


def budgets(leaves: dict[tuple, int], amount: int, max_epochs: int, weight: Callable[[tuple], float]) -> dict[tuple, int]:
    """Tokens for each leaf (a path of names with its tokens). weight gives that of a node by its path."""
    def share(paths: list[tuple], level: int, amount: Fraction) -> dict[tuple, Fraction]:
        if level == len(paths[0]):
            return {paths[0]: amount}
        groups: dict[tuple, list[tuple]] = {}
        for p in sorted(paths, key=str):
            groups.setdefault(p[: level + 1], []).append(p)
        nodes = {k: (Fraction(weight(k)).limit_denominator(10**6), Fraction(max_epochs * sum(leaves[p] for p in v))) for k, v in groups.items()}
        out = {}
        for k, got in poured(amount, nodes).items():
            out |= share(groups[k], level + 1, got)
        return out

    return {k: int(x) for k, x in share(list(leaves), 0, Fraction(amount)).items()} if leaves else {}


def taken_units(docs: DataFrame, levels: list[str], weight: Callable[[tuple], float], share: float = 0.8, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """What the mix takes of docs (id, text, levels...): _id, _t (a hash of the text), the levels as _l0..., n_tokens and copies (how often). The budget is `share` of all tokens. Only the leaves' totals, one row a source and language, come to the driver."""
    spark = docs.sparkSession
    keys = [F.col(c).cast("string").alias(f"_l{k}") for k, c in enumerate(levels)]
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    path = [f"_l{k}" for k in range(len(levels))]
    slim = docs.select(*keys, "id", F.xxhash64("text").alias("_tag"), tokens.alias("n_tokens"))
    slim = kept(slim.groupBy(*path, "id", "_tag").agg(F.sum("n_tokens").alias("n_tokens")), "mix_rows")
    totals = slim.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).collect()
    leaves = {tuple(r[p] for p in path): r.tokens for r in totals}
    got = budgets(leaves, int(sum(leaves.values()) * Fraction(share).limit_denominator(10**6)), max_epochs, weight)
    plan = []
    for r in totals:
        leaf = tuple(r[p] for p in path)
        epochs = got[leaf] // r.tokens if r.tokens else 0
        plan.append((*leaf, int(epochs), int(got[leaf] - epochs * r.tokens), max(1, -(-r.rows // ROWS))))
    schema = ", ".join(f"{p} string" for p in path) + ", epochs long, rest long, buckets long"
    same = lambda a, b: [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in path]  # noqa: E731, ARG005
    # one row a leaf: as many as there are sources, whatever the number of documents
    rows = slim.alias("a").join(spark.createDataFrame(plan, schema).alias("b"), same("a", "b")).select("a.*", "epochs", "rest", "buckets")
    rows = rows.withColumn("_u", F.xxhash64(F.lit(seed), "epochs", "id", "_tag")).withColumn("_bucket", F.floor((F.col("_u") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = rows.groupBy(*path, "_bucket").agg(F.sum("n_tokens").alias("own"))
    by = Window.partitionBy(*path).orderBy("_bucket")
    sums = kept(sums.withColumn("upto", F.sum("own").over(by)).withColumn("before", F.col("upto") - F.col("own")), "mix_buckets")
    rows = rows.alias("a").join(sums.alias("b"), [*same("a", "b"), F.col("a._bucket") == F.col("b._bucket")]).select("a.*", "before", "upto")
    whole = rows.where("upto <= rest").withColumn("last", F.lit(1))
    none = rows.where("upto > rest and before > rest").withColumn("last", F.lit(0))
    order = Window.partitionBy(*path, "_bucket").orderBy("_u", "id", "_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("upto > rest and before <= rest").withColumn("last", (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int"))
    rows = whole.unionByName(none).unionByName(edge)
    taken = rows.withColumn("copies", F.col("epochs") + F.col("last")).where("copies > 0")
    return taken.select(F.col("id").alias("_id"), F.col("_tag").alias("_t"), *path, "n_tokens", "copies")


def mix(docs: DataFrame, levels: list[str], weight: Callable[[tuple], float], **options) -> DataFrame:
    """The rows of docs (id, text, levels..., ...) that the mix takes, with n_tokens and copies, which replace columns of these names."""
    taken, path = taken_units(docs, levels, weight, **options), [f"_l{k}" for k in range(len(levels))]
    plain, back = numbered_columns(docs)
    own = {c: F.col(f"c{docs.columns.index(c)}") for c in ("id", "text", *levels)}
    on = [own["id"].eqNullSafe(F.col("_id")), F.xxhash64(own["text"]) == F.col("_t"), *[own[c].cast("string").eqNullSafe(F.col(p)) for c, p in zip(levels, path, strict=True)]]
    return plain.join(taken, reduce(and_, on)).select(*[x for c, x in back.items() if c not in ("n_tokens", "copies")], "n_tokens", "copies")
