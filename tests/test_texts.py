"""Words by rules, learned sentence ends and languages."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.functions import words as W
from chatloom.operators import languages as D
from chatloom.operators import sentences as N


@pytest.mark.parametrize(("text", "want"), [
    ('He said, "I cannot go--it\'s 3.50 (NASA\'s)!"', ["He", "said", ",", "``", "I", "can", "not", "go", "--", "it", "'s", "3.50", "(", "NASA", "'s", ")", "!", "''"]), ("They don't... U.S.A. won.", ["They", "do", "n't", "...", "U.S.A.", "won", "."]),
    ('"Quoted" at 10:30, or 1,000: we\'ll', ["``", "Quoted", "''", "at", "10:30", ",", "or", "1,000", ":", "we", "'ll"]), ("Gonna lemme gotta WANNA; 50% $5 #1", ["Gon", "na", "lem", "me", "got", "ta", "WAN", "NA", ";", "50", "%", "$", "5", "#", "1"]),
    ("a well-known e-mail @home\n\ttwo", ["a", "well-known", "e-mail", "@", "home", "two"]), (None, []), ("", []), ("  ", []), ("word " * 9000, ["word"] * 9000),
])
def test_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(W.words(F.col("t"))).head()[0] == want


def test_words_in_capitals(spark):
    rows = spark.createDataFrame([("NASA\'s U.S.A. I am A-1 É 中 42 Ok -- OK",)], "t string")
    assert rows.select(F.filter(W.words(F.col("t")), W.in_capitals)).head()[0] == ["NASA", "U.S.A.", "I", "A-1", "É", "OK"]
    assert rows.select(X.capital_words(F.col("t"), "at least", 6), X.capital_words(F.col("t"), "less than", 6)).head()[:] == (True, False)


def plain_sentences(texts):
    """The same method over lists: (abbreviations, words that begin sentences, sentences by text)."""
    word = lambda c: None if c is None else re.sub(r"[.,;:!?]$", "", c).lower()
    talks = [[re.sub(N.CLOSING, "", re.sub(N.OPENING, "", x)) for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x] for t in texts]
    dotted = lambda c: re.search(r"[^.]\.$", c) is not None
    pairs = [(c, after) for cores in talks for c, after in zip(cores, (cores[1:] + [None])[: len(cores)], strict=True)]
    a, b = Counter(word(c) for c, _ in pairs if dotted(c) and word(c)), Counter(word(c) for c, _ in pairs if not dotted(c) and word(c))
    dots, total = sum(a.values()), sum(a.values()) + sum(b.values())
    power = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    short = set()
    for w in a:
        if re.search(r"[^\W\d_]", w) and dots < total:
            size = len(w.replace(".", ""))
            if -2 * (power(a[w], a[w] + b[w], dots / total) - power(a[w], a[w] + b[w], 0.99)) * math.exp(-size) * (len(w) - size + 1) * size ** -b[w] >= 0.3:
                short.add(w)
    letter = lambda w: re.fullmatch(r"[^\W\d_]", w) is not None
    ended = [(c, n) for c, n in pairs if word(c) and n is not None and (c[-1] in "!?" or dotted(c) and word(c) not in short and not letter(word(c)))]
    s, e, starters = Counter(word(n) for _, n in ended), len(ended), set()
    for w, k in s.items():
        c = a[w] + b[w]
        if c and re.fullmatch(r"[^\W\d_]+", w) and total / e > c / k and -2 * (power(k, e, c / total) + power(c - k, total - e, c / total) - power(k, e, k / e) - power(c - k, total - e, (c - k) / (total - e))) >= 30:
            starters.add(w)

    def ends(c, after):
        if after is None or c[-1:] in ("!", "?"):
            return True
        if c.endswith(".."):
            return after[:1].isupper()
        if not dotted(c):
            return False
        if word(c) in short or letter(word(c)):
            return after[:1].isupper() and word(after) in starters
        return not (after[:1].islower() or after[:1].isdigit()) if word(c).isdigit() else True

    return short, starters, [sum(ends(c, n) for c, n in zip(cores, (cores[1:] + [None])[: len(cores)], strict=True)) for cores in talks]


def test_sentences_by_what_is_learned(spark):
    base = "The man saw Dr. Who at home. He was not there! The dog of Mr. Brown (a pet) ran to the U.S. The cat was old... and it slept. Is it 3. May? Yes. J. Smith paid. We go, e.g. home. It is the dr of the man at it"
    texts = [base + f" by no. {k} day" for k in range(40)] + [None, "", "  ", "one", "Dr. Who. He left.", "no end here " * 3000, "«Quoted.» “He said.” (So!)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    short, starters, want = plain_sentences(texts)
    found = N.learn(rows, "t")
    assert ({r.word for r in found[0].collect()}, {r.word for r in found[1].collect()}) == (short, starters)
    assert {"mr", "e.g", "u.s"} <= short and "the" in starters and not {"dr", "it", "is"} & short
    got = {r.id: r.sentences for r in N.counted(rows, "id", "t", *found).collect()}
    assert [got[k] for k in range(len(texts))] == want
    none = N.learn(rows.limit(0), "t")
    assert none[0].count() == none[1].count() == 0 and N.counted(rows.limit(0), "id", "t", *none).count() == 0


def test_all_learned_words_count(spark):
    """More abbreviations, and more words that begin sentences, than the 10000 that were kept of each; joins by word give the same."""
    letters = [chr(0x4E00 + k) for k in range(10_050)]
    short = spark.createDataFrame([(k, f"{c}. no") for k, c in enumerate(letters)], "id long, t string")
    found = N.learn(short, "t")
    assert found[0].count() == len(letters)
    names = ["".join(chr(97 + k // 26**i % 26) for i in range(3)) for k in range(10_050)]
    rows = spark.createDataFrame([(k, f"so! {n} " * 6 + "x " * 108) for k, n in enumerate(names)], "id long, t string")
    assert N.learn(rows, "t")[1].where("length(word) = 3").count() == len(names)
    want = [r.sentences for r in N.counted(short, "id", "t", *found).collect()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(r.sentences for r in N.counted(short, "id", "t", *found).collect()) == sorted(want) == [1] * len(letters)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sentences_read_tokens_with_marks_only(spark):
    texts = ["one two three. Four (five!) six", "«no marks» here", None, "", "a.” \"b?\" c", "... ''"]
    rows = spark.createDataFrame([(None if k == 1 else k, t) for k, t in enumerate(texts)], "id long, t string")
    got = [(r.core, r.after) for r in N.marked(rows, "id", "t").orderBy("id", "core", "after").collect()]
    assert len(got) == 11 and {x for x in got if x[0] is not None} == {("three.", "Four"), ("five!", "six"), ("six", None), ("here", None), ("a.", "b?"), ("b?", "c"), ("c", None), ("...", ""), ("", None)}
    words = {r.word: (r.a, r.b) for r in N.word_counts(rows.unionAll(rows), "t").collect()}
    assert words["three"] == (2, 0) and words["five"] == (0, 2) and words["a"] == (2, 0) and "" not in words
    none = spark.createDataFrame([], "word string, score double")
    found = N.counted(rows, "id", "t", none, none)
    assert {r.id: r.sentences for r in found.collect()} == {0: 3, None: 1, 2: 0, 3: 0, 4: 2, 5: 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1  # keys come with their tokens, not by another reading


def test_languages_held_out(spark, sf):
    from chatloom.plans.all import QUERIES

    rows = QUERIES["detected_languages"](spark, sf.replace("0.001", "0.01")).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert len(rows) > 150 and sum(r.lang == r.detected for r in rows) >= 0.98 * len(rows)
    assert all(r.english == (r.detected in (None, "en")) for r in rows) and any(r.english_capital for r in rows)


def test_languages_of_odd_texts(spark):
    rows = spark.createDataFrame([("the house and the dog", "en"), ("das Haus und der Hund", "de"), (None, "de"), ("x", None), ("", "en")], "t string, l string")
    model = D.learn(rows, "t", "l")
    odd = spark.createDataFrame([("the HOUSE!",), ("Der Hund?",), (None,), ("",), ("123 ... !",), ("und das " * 20000,)], "t string")
    got = {r.t: r.d for r in odd.withColumn("d", model.column(F.col("t"))).collect()}
    assert [got[t] for t in ("the HOUSE!", "Der Hund?", None, "", "123 ... !", "und das " * 20000)] == ["en", "de", None, None, None, "de"]
    assert odd.withColumn("d", D.learn(rows.limit(0), "t", "l").column(F.col("t"))).where("d is not null").count() == 0
    with pytest.raises(ValueError, match="languages"):
        D.learn(rows, "t", "t", most=1)
