"""Column functions over text: identity hashes, screening, skeletons and instruction checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import words as treebank

#: What counts as a secret.
SECRETS = [r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"\b(?:sk|ghp|github_pat)_[A-Za-z0-9_-]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b"]
SPACE = r"(?U)\s+"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical(*names: str) -> Column:
    """Canonical JSON of columns, nulls kept; fields in alphabetical order."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def secret_hits(c: Column) -> Column:
    """How many of the patterns a text has, each once."""
    hits = [c.rlike(p).cast("long") for p in SECRETS]
    return hits[0] + hits[1] + hits[2]


def where_seen(c: Column, sign: str, pattern: str, mark: str) -> Column:
    """Replaces a pattern in texts that have a sign of it; the others aren't searched."""
    return F.when(F.contains(c, F.lit(sign)), F.regexp_replace(c, pattern, mark)).otherwise(c)


def skeleton(c: Column) -> Column:
    """Digits, then paths, made alike."""
    return where_seen(F.regexp_replace(c, r"\d+", "<N>"), "/", r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+", "<PATH>")


#: What is made alike, in this order, and a sign without which it can't be there.
MARKS = [("```", r"```[\s\S]*?```", "<BLOCK>"), ("`", r"`[^`]+`", "<LITERAL>"), ("://", r"https?://\S+", "<URL>"), ("/", r"(?:[a-z0-9_.-]+/)+[a-z0-9_.-]+", "<PATH>")]


def full_skeleton(c: Column) -> Column:
    """Fences, inline code, links, paths and digits made alike, in this order, on one lower-cased line."""
    c = F.lower(c)
    for sign, pattern, mark in MARKS:
        c = where_seen(c, sign, pattern, mark)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\d+", "<N>"), r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\w+"))


def relation(value: Column, how: str, n: int) -> Column:
    return value < n if how == "less than" else value >= n


# Instruction checks; each takes the response and gives a boolean. Their patterns are the rules themselves.


def has_keywords(c: Column, keywords: list[str]) -> Column:
    out = F.lit(True)
    for k in keywords:
        out = out & c.rlike(f"(?iu){k}")
    return out


def keyword_frequency(c: Column, keyword: str, how: str, n: int) -> Column:
    return relation(F.regexp_count(c, F.lit(f"(?iu){keyword}")), how, n)


def no_forbidden(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~c.rlike(rf"(?iuU)\b{w}\b")
    return out


def letter_frequency(c: Column, letter: str, how: str, n: int) -> Column:
    low = F.lower(c)
    return relation(F.char_length(low) - F.char_length(F.replace(low, F.lit(letter.lower()), F.lit(""))), how, n)


def paragraphs(c: Column, n: int) -> Column:
    """As many paragraphs between *** marks; a blank first or last one doesn't count, a blank one between fails."""
    parts = F.transform(F.split(c, r"\s?\*\*\*\s?"), stripped)
    size = F.size(parts)
    inner = F.forall(F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda x: x != "")
    blank = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((size > 1) & (F.get(parts, size - 1) == ""), 1).otherwise(0)
    return inner & (size - blank == n)


def words(c: Column, how: str, n: int) -> Column:
    return relation(word_count(c), how, n)


def nth_paragraph_first_word(c: Column, n: int, total: int, word: str) -> Column:
    """As many non-blank paragraphs between empty lines as said, and the n-th piece starts with the word."""
    parts = F.split(c, "\n\n")
    full = F.size(F.filter(parts, lambda x: stripped(x) != ""))
    own = stripped(F.get(parts, F.lit(n - 1)))
    first = F.lower(F.regexp_extract(F.regexp_replace(F.get(F.split(own, SPACE), F.lit(0)), "^['\"]+", ""), r"^([^.,?!'\"]*)", 1))
    return F.coalesce((full == total) & (own != "") & (first == word.lower()), F.lit(False))


def placeholders(c: Column, n: int) -> Column:
    return F.regexp_count(c, F.lit(r"\[.*?\]")) >= n


def postscript(c: Column, marker: str) -> Column:
    pattern = {"P.P.S": r"\s*p\.\s?p\.\s?s.*$", "P.S.": r"\s*p\.\s?s\..*$"}.get(marker, r"\s*" + marker.lower() + r".*$")
    return F.lower(c).rlike("(?m)" + pattern)


def bullets(c: Column, n: int) -> Column:
    return F.regexp_count(c, F.lit(r"(?m)^\s*\*[^\*].*$")) + F.regexp_count(c, F.lit(r"(?m)^\s*-.*$")) == n


def constrained(c: Column, options: list[str]) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | stripped(c).contains(o)
    return out


def highlights(c: Column, n: int) -> Column:
    one = F.filter(F.regexp_extract_all(c, F.lit(r"\*[^\n\*]*\*"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\*+|\*+$", "").rlike(r"\S"))
    two = F.filter(F.regexp_extract_all(c, F.lit(r"\*\*[^\n\*]*\*\*"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\*\*|\*\*$", "").rlike(r"\S"))
    return F.size(one) + F.size(two) >= n


def sections(c: Column, splitter: str, n: int) -> Column:
    return F.size(F.split(c, rf"\s?{splitter}\s?\d+\s?")) - 1 >= n


def is_json(c: Column) -> Column:
    """One JSON value within an optional fence. The readers take a value's end for the text's, so it is read in a list, which must hold
    nothing else, and as a field: what follows a value can't close both."""
    body = stripped(c)
    for fence in ("^```json", "^```Json", "^```JSON", "^```", "```$"):
        body = F.regexp_replace(body, fence, "")
    read = lambda e, kind: F.from_json(e, f"a {kind}, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    listed = read(F.concat(F.lit('{"a": ['), body, F.lit("]}")), "array<string>")
    named = read(F.concat(F.lit('{"a": '), body, F.lit("}")), "string")
    return listed.getField("_bad").isNull() & (F.size(listed.getField("a")) == 1) & named.getField("_bad").isNull()


def has_title(c: Column) -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda x: F.regexp_replace(x, r"^<+|>+$", "").rlike(r"\S"))


def two_responses(c: Column) -> Column:
    """Exactly two different answers between ******; blank pieces are allowed at the ends only."""
    parts = F.transform(F.split(c, r"\*\*\*\*\*\*"), stripped)
    size = F.size(parts)
    inner = F.forall(F.slice(parts, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda x: x != "")
    full = F.filter(parts, lambda x: x != "")
    return inner & (F.size(full) == 2) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))


def repeats_prompt(c: Column, prompt: Column) -> Column:
    return F.lower(stripped(c)).startswith(F.lower(stripped(prompt)))


def ends_with(c: Column, phrase: str) -> Column:
    return F.lower(F.regexp_replace(stripped(c), '^"+|"+$', "")).endswith(phrase.strip().lower())


def all_capital(c: Column) -> Column:
    return (c == F.upper(c)) & c.rlike(r"\p{L}")


def all_lowercase(c: Column) -> Column:
    return (c == F.lower(c)) & c.rlike(r"\p{L}")


def capital_words(c: Column, how: str, n: int) -> Column:
    return capitals_among(treebank.words(c), how, n)


def capitals_among(words: Column, how: str, n: int) -> Column:
    return relation(F.size(F.filter(words, treebank.in_capitals)), how, n)


def no_comma(c: Column) -> Column:
    return ~c.contains(",")


def quoted(c: Column) -> Column:
    s = stripped(c)
    return (F.char_length(s) > 1) & s.startswith('"') & s.endswith('"')


def starts_with_line(c: Column, starter: str) -> Column:
    return c.rlike(rf"(?m)^\s*{starter}.*$")


def sentence_count(c: Column) -> Column:
    """Sentences by closing punctuation (an approximation of a trained splitter)."""
    return F.size(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: stripped(x) != ""))


def in_language(detected: Column, code: str) -> Column:
    """Whether a text is in a language; where none was detected it passes."""
    return F.coalesce(detected == code, F.lit(True))


def sentences_as_said(c: Column, how: str, n: int) -> Column:
    return relation(sentence_count(c), how, n)


#: What a sentence splitter by rules protects or breaks, in this order. <prd> stands for a dot that ends nothing.
LETTER, PREFIXES, SUFFIXES = "([A-Za-z])", "(Mr|St|Mrs|Ms|Dr)[.]", "(Inc|Ltd|Jr|Sr|Co)"
STARTERS = r"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
ACRONYMS, SITES = "([A-Z][.][A-Z][.](?:[A-Z][.])?)", "[.](com|net|org|io|gov|edu|me)"
RULES = [(PREFIXES, "$1<prd>"), (SITES, "<prd>$1"), (r"([0-9])[.]([0-9])", "$1<prd>$2")]
LATER = [
    (rf"\s{LETTER}[.] ", " $1<prd> "), (rf"{ACRONYMS} {STARTERS}", "$1<stop> $2"), (rf"{LETTER}[.]{LETTER}[.]{LETTER}[.]", "$1<prd>$2<prd>$3<prd>"), (rf"{LETTER}[.]{LETTER}[.]", "$1<prd>$2<prd>"),
    (rf" {SUFFIXES}[.] {STARTERS}", " $1<stop> $2"), (rf" {SUFFIXES}[.]", " $1<prd>"), (rf" {LETTER}[.]", " $1<prd>"),
]


def sentences(c: Column) -> Column:
    """The sentences of a text by rules: abbreviations, numbers, sites and initials keep their dots."""
    c = F.replace(F.concat(F.lit(" "), c, F.lit("  ")), F.lit("\n"), F.lit(" "))
    for pattern, to in RULES:
        c = F.regexp_replace(c, pattern, to)
    # runs of dots: each is protected, and the run ends a sentence
    c = F.regexp_replace(c, r"(?<![.])([.]{2,})(?![.])", "$1<stop>")
    c = F.regexp_replace(c, r"[.](?=[.]+<stop>)|(?<=[.])[.](?=<stop>)", "<prd>")
    c = F.replace(c, F.lit("Ph.D."), F.lit("Ph<prd>D<prd>"))
    for pattern, to in LATER:
        c = F.regexp_replace(c, pattern, to)
    for old, new in ((".\u201d", "\u201d."), ('."', '".'), ('!"', '"!'), ('?"', '"?'), (".", ".<stop>"), ("?", "?<stop>"), ("!", "!<stop>"), ("<prd>", ".")):
        c = F.replace(c, F.lit(old), F.lit(new))
    parts = F.transform(F.split(c, "<stop>"), stripped)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def key_sentences(c: Column, wanted: list[str], n: int) -> Column:
    """As many of the wanted sentences are among a text's."""
    own = sentences(c)
    return sum((F.array_contains(own, w).cast("int") for w in wanted), F.lit(0)) == n


def rephrased(c: Column, original: Column) -> Column:
    """Texts that differ between asterisks only; without asterisks there is nothing to compare, which is an error."""
    plain = lambda x: F.regexp_replace(x, r"\*.*\*", "")
    return F.when(c.rlike(r"\*.*\*"), plain(c) == plain(original)).otherwise(F.raise_error(F.lit("no change in the form *change me*")).cast("boolean"))


def shares_words(rows: DataFrame, key: str | list[str], value: str, original: str, low: int, high: int) -> DataFrame:
    """key, a column or several, and `shares`: whether the words that two texts of a row share, as often as both have them, are from low to high. Rows are counted
    where they are."""
    words_ = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), " ")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [(Counter(a.as_py().split()) & Counter(b.as_py().split())).total() for a, b in zip(*batch.columns[-2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(shared, pa.int64())], names=[*keys, "n"])

    keys = [key] if isinstance(key, str) else key
    found = rows.select(*keys, words_(F.col(value)).alias("_a"), words_(F.col(original)).alias("_b")).mapInArrow(count, T.StructType([*[rows.schema[k] for k in keys], T.StructField("n", T.LongType())]))
    return found.select(*keys, F.col("n").between(low, high).alias("shares"))
