"""Words of a text by a cascade of rules, in the way of the Penn treebank: marks, brackets, quotes and the parts of contractions are words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and what they become, in this order. Both engines know the syntax; $1 is a group.
QUOTES_OPEN = [(r'^"', "`` "), (r"""([ (\[{<])("|'')""", "$1 `` ")]
MARKS = [
    (r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"[.]{2,}", " ... "), (r"([;@#$%&])", " $1 "), (r"""([^.])([.])([\])}>"']*)\s*$""", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "), (r"--", " -- "),
]
QUOTES_CLOSE = [(r"''", " '' "), (r'"', " '' "), (r"\s+", " "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 ")]
CONTRACTIONS = [(r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(d)('ye)\b", "$1 $2"), (r"(?i)\b(gim|lem)(me)\b", "$1 $2"), (r"(?i)\b(gon|wan)(na)\b", "$1 $2"), (r"(?i)\b(got)(ta)\b", "$1 $2"), (r"(?i)\b(more)('n)\b", "$1 $2"), (r"(?i) ('t)(is|was)\b", " $1 $2")]
CASCADE = [*QUOTES_OPEN, *MARKS, (r"^(.*)$", " $1 "), *QUOTES_CLOSE, *CONTRACTIONS]


def words(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    for pattern, to in CASCADE:
        c = F.regexp_replace(c, pattern, to)
    return F.filter(F.split(c, " +"), lambda w: w != "")


def words_sql(text: str) -> str:
    """The same for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')"
    for pattern, to in CASCADE:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({out}, ' +'), lambda w: w <> '')"


def in_capitals(w: Column) -> Column:
    """Whether a word has capital letters and no small ones."""
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
