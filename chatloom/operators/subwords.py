"""Tokens of a vocabulary with the characters that each stands for.

The vocabulary is a file of the `tokenizers` library, loaded once a Python worker; its path has to be there on every executor. Offsets are
those of the text itself: several pieces of one character all have its place, so a token is known by its number, not by where it starts.
Null and empty texts have no tokens; marks of special tokens in a text are text.

Byte-level vocabularies cut a text in words first, and a word's pieces are the same wherever it stands. So words are found here, by the
vocabulary's own rule, and each is read by the library once while a worker remembers it. Around characters that aren't ASCII, whose classes
are the library's matter, it gets all up to the next blank that surely ends a word. Other vocabularies read each text as a whole."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatloom.operators.batches import runs

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@cache
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def offsets(text: str | None, path: str) -> list[dict]:
    found = loaded(path).encode(text or "", add_special_tokens=False)
    return [{"token": token, "start": start, "stop": stop} for token, (start, stop) in zip(found.ids, found.offsets, strict=True)]


#: What a worker remembers of words ends at so many words or pieces.
WORDS, PIECES = 1 << 17, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: The rule of byte-level vocabularies for ASCII; a character that isn't, and from it on up to a blank behind an ASCII character, as that always begins a word.
WORD = re.compile(rf" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANKS}A-Za-z0-9]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
OTHER, REST = re.compile(r"[^\x00-\x7f]"), re.compile(rf"(?:[^{BLANKS}]|(?<!(?![{BLANKS}])[\x00-\x7f])[{BLANKS}])*")


def words_of(text: str | None) -> list[str]:
    text = text or ""
    out, at = [], 0
    while not text.isascii() and (other := OTHER.search(text, at)):
        low = other.start()
        while low > at and not (text[low] in BLANKS and text[low - 1].isascii() and text[low - 1] not in BLANKS):
            low -= 1
        out += WORD.findall(text, at, low)
        at = REST.match(text, other.start()).end()
        out.append(text[low:at])
    return out + WORD.findall(text, at)


@cache
def by_words(path: str) -> bool:
    """Whether the vocabulary reads words of WORD's rule one by one."""
    own = json.loads(loaded(path).to_str())
    rule = own["pre_tokenizer"] or {}
    plain = all(own[k] is None for k in ("normalizer", "post_processor", "truncation", "padding")) and all(t["special"] for t in own["added_tokens"])
    return plain and own["model"].get("type", "BPE") == "BPE" and not own["model"].get("dropout") and rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True)


class Words(dict):
    """Numbers of the words met so far, with each one's pieces."""

    def __init__(self, path: str) -> None:
        self.path, self.first, self.chars, self.pieces = path, [0], [], []

    def __missing__(self, word: str) -> int:
        found = loaded(self.path).encode(word, add_special_tokens=False)
        self.pieces += [(token, start, stop) for token, (start, stop) in zip(found.ids, found.offsets, strict=True)]
        self.first.append(len(self.pieces))
        self.chars.append(len(word))
        self[word] = len(self)
        return self[word]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's pieces begin, its characters, and all pieces; made anew when words were added."""
        if not hasattr(self, "made") or len(self.made[1]) != len(self.chars):
            self.made = np.array(self.first), np.array(self.chars), np.array(self.pieces, dtype=np.int32).reshape(-1, 3).T
        return self.made


_words: dict[str, Words] = {}


def pieces(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has, and of all their token, start and stop."""
    if not by_words(path):
        found = [loaded(path).encode(t or "", add_special_tokens=False) for t in texts]
        ids = np.concatenate([np.array(f.ids, dtype=np.int32) for f in found])
        return np.array([len(f.ids) for f in found]), np.stack([ids, *np.concatenate([np.array(f.offsets, dtype=np.int32).reshape(-1, 2) for f in found]).T])
    words = _words.get(path)
    if words is None or len(words) > WORDS or len(words.pieces) > PIECES:
        words = _words[path] = Words(path)
    numbers = [np.fromiter(map(words.__getitem__, split), np.int64, len(split)) for split in map(words_of, texts)]
    first, chars, known = words.tables()
    text_begins = np.append(0, np.cumsum([len(n) for n in numbers]))
    all_ = np.concatenate(numbers)
    count, at = (first[1:] - first[:-1])[all_], np.append(0, np.cumsum(chars[all_]))
    ends = np.append(0, np.cumsum(count))
    at = at[:-1] - np.repeat(at[text_begins[:-1]], np.diff(text_begins))  # of the word in its text
    out = known[:, np.arange(ends[-1]) + np.repeat(first[all_] - ends[:-1], count)]
    out[1:] += np.repeat(at, count).astype(np.int32)
    return np.diff(ends[text_begins]), out


def tokens(rows: DataFrame, key: str, text: str, path: str = TOKENIZER, spans: str | Callable[[str | None], list[dict]] | None = None) -> DataFrame:
    """key, n (from 0), token, start, stop of every token of every text. spans, a column of arrays of (start, stop, role) or what makes
    them of a text, adds the largest role of the spans that a token touches, else 0. What a task holds is a run of texts, never a batch's tokens."""
    column = isinstance(spans, str)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in runs(batch.column(1)):
                size, found = pieces(texts, path)
                ends = np.append(0, np.cumsum(size))
                columns = [(np.arange(ends[-1]) - np.repeat(ends[:-1], size)).astype(np.int32), *found]
                if spans:
                    own = batch.column(2).slice(lo, hi - lo).to_pylist() if column else map(spans, texts)
                    columns.append(np.concatenate([largest(found[1, a:b], found[2, a:b], s or []) for a, b, s in zip(ends[:-1], ends[1:], own, strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(lo, hi), size))), *map(pa.array, columns)], names=names)

    names = [key, "n", "token", "start", "stop"] + ["role"] * bool(spans)
    schema = T.StructType([rows.schema[key], *[T.StructField(c, T.IntegerType()) for c in names[1:]]])
    return rows.select(key, text, *[spans] * column).mapInArrow(read, schema)


def largest(start: np.ndarray, stop: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Of tokens in order of their places the largest role of the spans that they touch, else 0; empty tokens and spans touch nothing."""
    out = np.zeros(len(start), dtype=np.int32)
    for s in spans:
        if s["stop"] > s["start"]:
            there = slice(np.searchsorted(stop, s["start"], "right"), np.searchsorted(start, s["stop"], "left"))
            out[there] = np.maximum(out[there], s["role"])
    return np.where(stop > start, out, 0)
