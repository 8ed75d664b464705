"""Seeded, order-independent sampling, splitting, mixing and ordering; the order of a draw is that of sha256(seed:key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import sha


def draw(seed: str, *keys: Column) -> Column:
    return sha(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def drawn_bucket(c: Column) -> Column:
    """Which of 65536 even parts of the order a drawn key is in."""
    return F.conv(F.substring(c, 1, 4), 16, 10).cast("long")


def id_bucket(c: Column) -> Column:
    """Which run of 65536 whole numbers a number is in."""
    return F.floor(c / 65536)


def ranked(rows: DataFrame, name: str, bucket: Column, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the position from 1 of each row in a total order (within each `by`), and n, how many there are.

    The order is cut in buckets that rise with it. Rows are numbered within their bucket, and what the buckets before hold is added: the
    only window over all is over one row a bucket, so no task takes all rows.
    """
    rows = rows.withColumn("_bucket", bucket)
    every = Window.partitionBy(*(by or (F.lit(0),)))
    sums = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_own"))
    sums = sums.withColumn("_before", F.sum("_own").over(every.orderBy("_bucket")) - F.col("_own")).withColumn("n", F.sum("_own").over(every)).drop("_own")
    same = [rows[c].eqNullSafe(sums[c]) for c in (*by, "_bucket")]
    rows = rows.join(sums, same).drop(*[sums[c] for c in (*by, "_bucket")])
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return rows.withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_before", "_bucket")


def shuffled_limit(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by their drawn order; a top-n, not a full sort."""
    return rows.withColumn("drawn", draw(seed, F.col(key))).orderBy("drawn").limit(n)


def group_split(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Adds `side`: whole groups go to eval, at least one and not all, about share of them (half to even)."""
    groups = rows.select(group).distinct().withColumn("drawn", draw(seed, F.col(group)))
    n = groups.agg(F.count("*").alias("n")).select("n", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * share))).cast("int").alias("k"))
    # the k lowest draws: one row of counts meets the groups
    chosen = ranked(groups, "rank", drawn_bucket(F.col("drawn")), [F.col("drawn")]).drop("n").join(F.broadcast(n), F.col("rank") <= F.col("k"), "left_semi").select(group, F.lit("eval").alias("side"))
    return rows.join(chosen, group, "left").withColumn("side", F.coalesce("side", F.lit("train")))


def stratified(rows: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """Of each stratum max(1, min(n, ceil(n * share))) rows without replacement."""
    key_order = draw(seed, F.col(stratum), F.col(key))
    rows = ranked(rows, "rank", drawn_bucket(key_order), [key_order, F.col(key)], (stratum,)).withColumnRenamed("n", "size")
    return rows.where(F.col("rank") <= F.greatest(F.lit(1), F.least(F.col("size"), F.ceil(F.col("size") * share))))


def drawn_with_replacement(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """Each row once until the pool is used up, then further draws: (key, copies) of exactly count draws from a non-empty pool."""
    n = rows.count()
    if not n:
        raise ValueError("nothing to draw from")
    order = draw(seed, F.col(key))
    drawn = ranked(rows.select(key), "rank", drawn_bucket(order), [order, F.col(key)]).withColumn("rank", F.col("rank") - 1)
    if count <= n:
        return drawn.where(F.col("rank") < count).select(key, F.lit(1).cast("long").alias("copies"))
    # as many times as the draws go round, and once more for the first of the rest
    return drawn.select(key, (F.lit(count // n) + F.when(F.col("rank") < count % n, 1).otherwise(0)).cast("long").alias("copies"))


def weighted_quotas(categories: DataFrame, total: int) -> DataFrame:
    """categories: category, idx, weight. A floor for each, then whole parts of weighted rest, then what is left by largest remainder."""
    n = categories.count()
    floor = min(12, max(1, total // (n * 4)))
    rest = total - floor * n
    if rest < 0:
        raise ValueError("too few rows to cover every category")
    rows = categories.withColumn("share", F.lit(rest) * F.col("weight")).withColumn("whole", F.floor("share")).withColumn("part", F.round(F.col("share") - F.col("whole"), 9))
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("missing", F.lit(rest) - F.sum("whole").over(every)).withColumn("rank", F.row_number().over(every.orderBy(F.desc("part"), "idx")))
    return rows.withColumn("quota", F.lit(floor) + F.col("whole") + F.when(F.col("rank") <= F.col("missing"), 1).otherwise(0))


def interleaved(rows: DataFrame, category: str, category_order: Column, order: str) -> DataFrame:
    """Round-robin over categories: position is by turn, then category. order is a whole number."""
    rows = ranked(rows, "turn", id_bucket(F.col(order)), [F.col(order)], (category,)).drop("n").withColumn("cat_idx", category_order)
    return ranked(rows, "position", id_bucket(F.col("turn")), [F.col("turn"), F.col("cat_idx"), F.col(order)]).drop("n")


def spaced(rows: DataFrame, is_rehearsal: Column, order: str) -> DataFrame:
    """One rehearsal row after every third other row; what is left of them comes last. order is a whole number."""
    rows = rows.withColumn("rehearsal", is_rehearsal)
    sizes = rows.agg(F.count_if("rehearsal").alias("easy"), F.count_if(~F.col("rehearsal")).alias("hard"))
    rows = ranked(rows, "rn", id_bucket(F.col(order)), [F.col(order)], ("rehearsal",)).drop("n").join(F.broadcast(sizes))  # one row
    at_hard = F.col("rn") + F.least(F.floor((F.col("rn") - 1) / 3), F.col("easy"))
    at_easy = F.when(3 * F.col("rn") <= F.col("hard"), 4 * F.col("rn")).otherwise(F.col("hard") + F.col("rn"))
    return rows.withColumn("position", F.when(F.col("rehearsal"), at_easy).otherwise(at_hard).cast("long"))


def folds(rows: DataFrame, order: str, k: int) -> DataFrame:
    return ranked(rows, "rn", id_bucket(F.col(order)), [F.col(order)]).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k))).drop("rn", "n")


def composed(rows: DataFrame, key: str, is_replay: Column, ratio: float, total: int, seed: str) -> DataFrame:
    """A stream of `total` rows: a share of them drawn from the replayed rows, the rest from the others, each without repeats until its pool is
    used up, in a drawn order: rows' columns with pool, copy (from 1) and position (from 1)."""
    again = int(round(total * ratio))
    marked = rows.withColumn("pool", F.when(F.coalesce(is_replay, F.lit(False)), "replay").otherwise("canonical"))
    parts = [drawn_with_replacement(marked.where(F.col("pool") == name), key, n, f"{seed}:{name}").select(key, "copies") for name, n in (("replay", again), ("canonical", total - again)) if n]
    drawn = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = marked.join(drawn, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).drop("copies")
    order = draw(seed, F.col(key), F.col("copy"))
    return ranked(out, "position", drawn_bucket(order), [order, F.col(key), F.col("copy")]).drop("n")
