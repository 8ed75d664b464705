"""Array kernels over Arrow text columns: words, word hashes and shingles without a Python object per word.

Words are maximal runs of bytes outside space, tab and the line breaks 0x0A-0x0D, with A-Z lower-cased; UTF-8 never uses
those bytes inside a longer character, so bytes give the same words as code points. Hashes have 64 bits. Null counts as an
empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from inspect import isgeneratorfunction, signature
from pathlib import Path

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers = np.ones(1, dtype=U)
_inverse = np.ones(1, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of x over the word (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, CHUNK + 1)
        both = []
        for base in (BASE, U(pow(int(BASE), -1, 1 << 64))):
            table = np.full(n, base, dtype=U)
            table[0] = 1
            both.append(np.cumprod(table, dtype=U))
        _powers, _inverse = both
    return _powers, _inverse


@dataclass
class Words:
    """The words of some consecutive texts. bounds[i]:bounds[i+1] are those of text i; start and end index buf."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans that don't depend on where they stand."""
        _, inverse = powers(len(self.buf) + 1)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """For each word, the text that it stands in."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int64), self.counts())


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    buf = LOWER[buf]
    solid = SOLID[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    finish[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    sums = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf) + 1)[0][: len(buf)], out=sums[1:])
    return Words(buf, start, end, np.searchsorted(start, offsets), sums)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins in them."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """Splits a text column in runs lo:hi of about `limit` bytes (a longer text makes a run of its own) with their words."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of n words that lies in one text, and the run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    acc = np.full(m, n, dtype=U)
    for k in range(n):
        acc *= BASE
        acc += h[k : k + m]
    inside = np.ones(m, dtype=bool)
    for k in range(1, n):  # a text that begins at word b takes no run that starts at b-k
        at = bounds - k
        inside[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(inside)
    return mix(acc[at]), at


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of n words, or its one shorter sequence. Returns sorted hashes and their bounds by text."""
    h, counts = w.hashes(), w.counts()
    grams, at = ngrams(h, w.bounds, n)
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    for size in range(1, n):
        few = np.flatnonzero(counts == size)
        if len(few):
            acc = np.full(len(few), size, dtype=U)
            for k in range(size):
                acc *= BASE
                acc += h[w.bounds[few] + k]
            grams, doc = np.concatenate([grams, mix(acc)]), np.concatenate([doc, few])
    order = np.argsort(grams)
    order = order[np.argsort(doc[order], kind="stable")]
    grams, doc = grams[order], doc[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[first], doc[first]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Lookup:
    """Finds 64-bit hashes in a fixed set by open addressing; find() gives each one's place in `keys`, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.asarray(keys, dtype=U)
        self.bits = max(4, int(2 * max(1, len(self.keys)) - 1).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, step = np.arange(len(self.keys)), 0
        while len(left):
            at = self._slot(self.keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left, step = left[self.slots[at] != left], step + 1
        self.steps = step

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return (((h >> U(64 - self.bits)).astype(np.int64)) + step) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        left = np.arange(len(h))
        for step in range(self.steps + 1):
            got = self.slots[self._slot(h[left], step)]
            live = got >= 0
            left, got = left[live], got[live]
            hit = self.keys[got] == h[left]
            out[left[hit]] = got[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def lean(run: Callable) -> Callable:
    """run, a task's function of batches or of a table, gives what it freed back to the system at its end. Workers are used again, so
    else each keeps the most that one of its tasks ever took."""
    if isgeneratorfunction(run):

        def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            give_back()
    else:

        def wrapped(*args) -> pa.Table:
            out = run(*args)
            give_back()
            return out

    wrapped.__signature__ = signature(run)  # by it Spark tells whether a function wants the key
    return wrapped


def give_back() -> None:
    """Where the C library can't, only Arrow's memory goes back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def one_thread() -> Iterator[None]:
    """Small matrix products inside take one thread of numpy's own OpenBLAS, as a task has its core: a second one waits busily for
    most of its time. Without that library nothing changes."""
    found = [ctypes.CDLL(str(x)) for x in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas64*")]
    found = [x for x in found if hasattr(x, "scipy_openblas_set_num_threads64_")]
    before = [x.scipy_openblas_get_num_threads64_() for x in found]
    try:
        for x in found:
            x.scipy_openblas_set_num_threads64_(1)
        yield
    finally:
        for x, n in zip(found, before, strict=True):
            x.scipy_openblas_set_num_threads64_(n)


@contextmanager
def memory_at_hand() -> Iterator[None]:
    """Arrays that are made and freed again and again inside take what was freed before: else the C library gives each one back to the
    system and gets it anew, page by page. At the end all goes back. Without glibc nothing changes."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    at_least, trim = -3, -1  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
    if tune:
        tune(at_least, 1 << 25)
        tune(trim, 1 << 30)
    try:
        yield
    finally:
        if tune:
            tune(at_least, 1 << 17)
            tune(trim, 1 << 17)
        give_back()
