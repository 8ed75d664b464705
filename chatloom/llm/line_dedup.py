"""Line dedup across documents with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without spaces, tabs and the characters 0x0A-0x0D at either end, A-Z lower-cased; keys are held as two
64-bit hashes. Documents come in batches. Every batch is reduced to its keys (how many documents have each, the largest id among
them). Keys that no run has are found by merge anti-joins and become a run of their own; so a key stands in one run only, that of
the batch which had it first. What is left of the batch, keys seen again, goes to a table of increments. As soon as `fan_in` runs
share a level they are merged into one of the next level, so a batch meets a number of runs that grows with the logarithm of the
batches. Runs and batches are tables in buckets by key, each sorted, so these joins move no rows.

Keys of at least `min_chars` code points in at least `min_docs` documents, by a run's count and the key's increments, then lose their
lines in all documents but the one with the largest id. Keys in a large share of all lines, of which there can't be many, meet the
lines by broadcast; all others in a join by key.

Null and empty texts are one empty line. Rows of one id count as one document, and each keeps or loses its lines like any other;
rows whose id is null keep their lines and count for nothing. Very long texts are lines like others. Extra columns pass through
untouched, whatever their names, but for columns named n_lines or n_dropped, which the results replace. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.store import kept, numbered_columns, sorted_buckets

BLANK = "\t\n\x0b\f\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Keys that stand in more than one of so many lines are at most so many.
HOT = 10_000


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of one byte a character take the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_keys(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """One row for each line that is long enough: which row of docs (id, text), where in it, and the key's two hashes."""
    rows = docs.where("id is not null").select("id", F.xxhash64("text").alias("tag"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANK))
    rows = rows.where(F.char_length("line") >= min_chars).withColumn("line", line).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id", "tag", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class Runs:
    """Sorted runs of (h1, h2, docs, top) by level, no key in two of them; `again` has what later batches add to their keys."""

    def __init__(self, spark: SparkSession, fan_in: int = 3) -> None:
        self.spark, self.fan_in, self.levels, self.again = spark, fan_in, [[]], []

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's keys: those that the runs lack as a new run, the others as increments."""
        own = sorted_buckets(batch, KEY, "line_batch")
        if runs := self.all():
            fresh = reduce(lambda a, run: a.join(run.select(KEY).hint("merge"), KEY, "left_anti"), runs, own)
            fresh = sorted_buckets(fresh, KEY, "line_run")
            self.again.append(own.join(fresh.select(KEY).hint("merge"), KEY, "left_anti"))
            own = fresh
        self.levels[0].append(own)
        self.compact()

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fan_in:
                continue
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(sorted_buckets(reduce(DataFrame.unionByName, level).repartition(*KEY), KEY, "line_run"))
            self.levels[k] = []

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys (h1, h2, docs, top) of at least min_docs documents, with the largest id that has them."""
        if not self.again:
            return reduce(DataFrame.unionByName, self.all()).where(F.col("docs") >= min_docs)
        more = reduce(DataFrame.unionByName, self.again).groupBy(KEY).agg(F.sum("docs").alias("more"), F.max("top").alias("later"))
        more = sorted_buckets(more, KEY, "line_again")
        whole = [run.join(more.hint("merge"), KEY, "left").select(*KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("top", "later").alias("top")) for run in self.all()]
        return reduce(DataFrame.unionByName, [x.where(F.col("docs") >= min_docs) for x in whole])


def lost_lines(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of keys whose line goes: the key is repeated and has a larger id."""
    often = -(-keys.count() // HOT)
    hot = F.broadcast(repeated.where(F.col("docs") > often))  # HOT rows of 32 bytes at most, as each has over 1 / HOT of all rows of keys
    cold = repeated.where(F.col("docs") <= often)
    found = keys.join(hot, KEY).unionByName(keys.join(hot, KEY, "left_anti").join(cold, KEY))
    return found.where(F.col("id") < F.col("top"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """docs (id, text, ...) with text cut to the lines that stay, and n_lines, n_dropped."""
    keys = kept(long_keys(docs.select("id", "text"), min_chars, batches), "line_keys")
    runs = Runs(docs.sparkSession, fan_in)
    for b in range(batches):  # an id is in one batch, so document counts of batches add up
        one = keys.where(F.col("batch") == b).groupBy(*KEY, "id").agg(F.lit(1).alias("one"))
        runs.add(one.groupBy(KEY).agg(F.count("*").alias("docs"), F.max("id").alias("top")))
    lost = lost_lines(keys, kept(runs.repeated(min_docs), "line_repeated"))
    lost = lost.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("pos").alias("_lost"))
    plain, back = numbered_columns(docs)
    id_, text = (F.col(f"c{docs.columns.index(c)}") for c in ("id", "text"))
    rows = plain.withColumns({"_tag2": F.xxhash64(text), "_lines": lines_of(text)}).drop(f"c{docs.columns.index('text')}")
    rows = rows.join(lost, (id_ == F.col("_id")) & (F.col("_tag2") == F.col("_tag")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    stays = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda k: F.get("_lines", k)))
    own = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long")}
    return rows.select(*[F.array_join(stays, "\n").alias("text") if c == "text" else x for c, x in back.items() if c not in own], *[x.alias(c) for c, x in own.items()])
