"""Sentence ends by what a corpus tells: abbreviations and words that begin sentences are learned without labels, by likelihood ratios
(Kiss and Strunk 2006).

A word that keeps company with a final dot far more than dots are frequent is an abbreviation; short ones and such with dots inside are
likelier, and each time it stands without a dot counts against it. A word that follows sentence ends far more often than it would by
chance begins sentences. Both are counts by word, so learning is two aggregations over all texts, and the model is two tables of words, of
all whose score is high enough; Spark sends them to all tasks while they are small, and otherwise joins them by word.

A word's last mark ends a sentence if it is ! or ?; a run of dots does before a capital; a dot after an abbreviation or a single letter
does only before a capitalised word that begins sentences, after a number only where no digit or small letter follows; any other dot
does. Texts are split at white space; null and blank ones have no sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.sources.shared import kept

#: Quotes and brackets around words, as patterns and as characters, and the method's constants.
OPENING, CLOSING = r"""^["'(\[{«“‘]+""", r"""["')\]}»”’]+$"""
OPENERS, CLOSERS = """"'([{«“‘""", """"')]}»”’"""
ABBREVIATION, STARTER, CERTAIN = 0.3, 30.0, 0.99


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def core(token: Column) -> Column:
    """Without the quotes and brackets around it: trimmed, which takes a fraction of a pattern's time."""
    return F.rtrim(F.ltrim(token, F.lit(OPENERS)), F.lit(CLOSERS))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, a and b: how often it stands with a final dot and without. Equal tokens are counted before they are read."""
    found = texts.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    one = found.select("n", core(F.col("token")).alias("core")).select("n", is_dotted(F.col("core")).alias("dotted"), word(F.col("core")).alias("word")).where("word <> ''")
    total = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    return one.groupBy("word").agg(total(F.col("dotted")).alias("a"), total(~F.col("dotted")).alias("b"))


def marked(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, core, dotted, word and the next token's core and word, of tokens that hold a mark and of each text's last, as no others can end
    a sentence; next ones are null at the end. A text without tokens has one row of nulls."""
    split = rows.select(key, tokens(text).alias("_t"))
    holds = lambda t: t["after"].isNull() | t["token"].contains(".") | t["token"].contains("!") | t["token"].contains("?")
    some = F.filter(F.arrays_zip(F.col("_t").alias("token"), F.slice("_t", 2, F.size("_t")).alias("after")), holds)
    one = split.select(key, F.explode_outer(some).alias("t")).select(key, core(F.col("t.token")).alias("core"), core(F.col("t.after")).alias("after"))
    return one.select(key, "core", "after", is_dotted(F.col("core")).alias("dotted"), word(F.col("core")).alias("word"), word(F.col("after")).alias("next"))


def is_dotted(core: Column) -> Column:
    return core.endswith(".") & ~core.endswith("..") & (core != ".")


def is_loud(core: Column) -> Column:
    return core.endswith("!") | core.endswith("?")


def word(core: Column) -> Column:
    return F.lower(F.when(F.right(core, F.lit(1)).isin(*".,;:!?"), F.left(core, F.char_length(core) - 1)).otherwise(core))


def power(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1 - p)^(n - k), with nothing for 0 log 0."""
    part = lambda x, q: F.when(x > 0, x * F.ln(q)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def learn(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Of all texts: abbreviations (word, score) and words that begin sentences (word, score). Texts are read once for each."""
    counts = kept(word_counts(texts, text), "sentence_words")
    sums = counts.agg(F.sum("a").alias("dots"), (F.sum("a") + F.sum("b")).alias("all"))
    size = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.char_length("word") - size
    chance, n = F.col("dots") / F.col("all"), F.col("a") + F.col("b")
    ratio = -2 * (power(F.col("a"), n, chance) - power(F.col("a"), n, F.lit(CERTAIN)))
    score = ratio * F.exp(-size.cast("double")) * (inner + 1) * F.pow(size.cast("double"), -F.col("b").cast("double"))
    short = counts.where(r"a > 0 and word rlike '\\p{L}'").join(F.broadcast(sums)).where("dots < all").select("word", score.alias("score")).where(F.col("score") >= ABBREVIATION)  # one row of sums
    abbreviations = kept(short, "abbreviations")
    rows = marked(texts.withColumn("_one", F.lit(1)), "_one", text).where("word <> ''")
    ended = rows.join(abbreviations.select("word", F.lit(True).alias("short")), "word", "left")
    end = is_loud(F.col("core")) | (F.col("dotted") & F.col("short").isNull() & ~F.col("word").rlike(r"^\p{L}$"))
    after = ended.where(end & F.col("next").isNotNull()).groupBy(F.col("next").alias("word")).agg(F.count("*").alias("s"))
    ends = after.agg(F.sum("s").alias("ends"))
    both = after.join(counts, "word").join(F.broadcast(sums)).join(F.broadcast(ends))  # one row each
    c, k, e, total = F.col("a") + F.col("b"), F.col("s"), F.col("ends"), F.col("all")
    apart = -2 * (power(k, e, c / total) + power(c - k, total - e, c / total) - power(k, e, k / e) - power(c - k, total - e, (c - k) / (total - e)))
    starters = both.where((total > e) & (c >= k) & (c - k <= total - e) & (total / e > c / k)).where(r"word rlike '^\\p{L}+$'").select("word", apart.alias("score")).where(F.col("score") >= STARTER)
    return abbreviations, kept(starters, "starters")


def counted(rows: DataFrame, key: str, text: str, abbreviations: DataFrame, starters: DataFrame) -> DataFrame:
    """key and sentences, of every row; rows of one key count together."""
    t = marked(rows, key, text)
    t = t.join(abbreviations.select("word", F.lit(True).alias("short")), "word", "left")
    t = t.join(starters.select(F.col("word").alias("next"), F.lit(True).alias("starts")), "next", "left")
    upper, lower, own = F.col("after").rlike(r"^\p{Lu}"), F.col("after").rlike(r"^\p{Ll}"), F.col("core")
    single = F.col("word").rlike(r"^\p{L}$")
    dot = F.when(F.col("short").isNotNull() | single, upper & F.col("starts").isNotNull()).when(F.col("word").rlike(r"^[0-9]+$"), ~lower & ~F.col("after").rlike("^[0-9]")).otherwise(True)
    ends = F.when(own.isNull(), False).when(F.col("after").isNull(), True).when(is_loud(own), True).when(own.endswith(".."), upper).when(F.col("dotted"), dot).otherwise(False)
    return t.groupBy(key).agg(F.count_if(ends).alias("sentences"))
