"""Offsets of a vocabulary's pieces."""

import json
import random

import pytest

from chatloom.operators import subwords
from chatloom.operators.literals import overlapping

TEXTS = [(1, "one two"), (2, None), (3, ""), (4, "é ü 🙂🙃 ≠\n\n  x"), (5, "<|endoftext|> " * 3), (6, "very long " * 9000), (4, "again"), (None, "null key")]


def test_pieces_cover_texts(spark):
    rows = spark.createDataFrame(TEXTS, "id long, t string")
    got = {}
    for r in subwords.tokens(rows.where("id <> 4 or t = 'again'"), "id", "t").collect():
        got.setdefault(r.id, []).append((r.n, r.start, r.stop, r.token))
    assert sorted(got) == [1, 4, 5, 6]
    for i, t in TEXTS:
        if t and i in (1, 5, 6):
            assert [n for n, *_ in sorted(got[i])] == list(range(len(got[i])))
            assert "".join(t[a:b] for _, a, b, _ in sorted(got[i])) == t


def test_pieces_of_one_character_have_its_place():
    found = subwords.offsets(TEXTS[3][1], subwords.TOKENIZER)
    places = [(x["start"], x["stop"]) for x in found]
    assert len(places) > len(set(places)) and {k for a, b in places for k in range(a, b)} == set(range(len(TEXTS[3][1])))


@pytest.mark.parametrize("empty", [True, False])
def test_pieces_keep_their_number_when_they_meet_spans(spark, empty):
    tokens = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 2), (1, 2, 2, 300)], "id long, n int, start int, stop int")
    spans = spark.createDataFrame([] if empty else [(1, 1, 2, 3), (1, 250, 251, 2), (1, 5, 5, 9)], "id long, start int, stop int, role int")
    assert sorted((r.n, r.role) for r in overlapping(tokens, spans, "id").collect()) == ([(0, 0), (1, 0), (2, 0)] if empty else [(0, 3), (1, 3), (2, 2)])


def test_words_give_the_pieces_of_whole_texts():
    draw = random.Random(3)
    odd = [*"abZ09  \t\n\r\x0b'''stremvld.,_`|<>()\x1c\x85\xa0 　é中ü🙂ñ́²½٣ª​\x00", "'re", "<|endoftext|>"]
    texts = ["".join(draw.choices(odd, k=draw.randrange(40))) for _ in range(4000)] + [t for _, t in TEXTS] + ["a" * 5000, " " * 3000, "é" * 1000]
    size, found = subwords.pieces(texts, subwords.TOKENIZER)
    want = [subwords.offsets(t, subwords.TOKENIZER) for t in texts]
    assert size.tolist() == [len(w) for w in want] and list(map(tuple, found.T.tolist())) == [tuple(x.values()) for w in want for x in w]


def test_a_word_is_read_once():
    subwords._words.clear()
    size, _ = subwords.pieces(["one two, " * 5000, "two one"], subwords.TOKENIZER)
    assert size.sum() == 15_002 + 1 and len(subwords._words[subwords.TOKENIZER]) <= 7
    many = [" ".join(f"w{k}x{n}" for k in range(3000)) for n in range(60)]
    for t in many:
        subwords.pieces([t], subwords.TOKENIZER)
    assert len(subwords._words[subwords.TOKENIZER]) <= subwords.WORDS + 10_000 and subwords.pieces(many[:1], subwords.TOKENIZER)[0].tolist() == [len(subwords.offsets(many[0], subwords.TOKENIZER))]


def test_other_vocabularies_read_whole_texts(tmp_path):
    own = json.loads(subwords.loaded(subwords.TOKENIZER).to_str())
    own["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(own))
    path = str(tmp_path / "v.json")
    texts = [t for _, t in TEXTS]
    assert subwords.by_words(subwords.TOKENIZER) and not subwords.by_words(path)
    assert subwords.pieces(texts, path)[1].T.tolist() == [list(x.values()) for t in texts for x in subwords.offsets(t, path)]
