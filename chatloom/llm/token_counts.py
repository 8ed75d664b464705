"""Token counts by a linear longest-match automaton.

Greedy longest-match pieces of a word against a vocabulary are counted without building them: a trie of the vocabulary has, for
each node, a failure link to the node that stands for what is left after the longest pieces are cut off, and the number of pieces
so cut. Reading a character follows an edge, or pops pieces and tries again from the failure link, so a word costs time linear in
its length. All distinct words of a chunk are read in step.

Words are maximal runs without white space, A-Z lower-cased, read as bytes with an end mark. A word that can't be cut into pieces
counts as one token, and as unknown. Null and empty texts have no token; very long ones are read whole. Rows are counted one by one, so
repeated rows have equal counts. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.llm.kernel import U, Lookup, Words, chunks, segment_sum

END = 256
WORD_END = "</w>"


def byte_of_char() -> dict[str, int]:
    """The public byte-level convention: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends, as bytes and, at a word's end, END."""
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    chars, out = byte_of_char(), []
    for piece in pieces:
        ends = piece.endswith(WORD_END)
        body = piece.removesuffix(WORD_END)
        if all(c in chars for c in body):
            out.append((*[chars[c] for c in body], *[END] * ends))
    return [x for x in out if x]


class Automaton:
    """child: (node, symbol) -> node; fail and pops by node; a fail of -1 means that no cut is possible."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    final.append(False)
                node = edges[node][c]
            final[node] = True
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for c, u in edges[v].items():
                queue.append(u)
                if final[u]:
                    fail[u], pops[u] = 0, 1
                    continue
                z, n = fail[v], pops[v]
                while z >= 0 and c not in edges[z]:
                    z, n = fail[z], n + pops[z]
                if z >= 0:
                    fail[u], pops[u] = edges[z][c], n
        at = [(v << 9 | c, u) for v, out in enumerate(edges) for c, u in out.items()]
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        self.root = np.full(END + 1, -1, dtype=np.int32)
        for c, u in edges[0].items():
            self.root[c] = u
        keys = np.array([k for k, _ in at], dtype=U)
        self.edge = Lookup(keys * U(0x9E3779B97F4A7C15))  # odd: one to one
        self.to = np.array([u for _, u in at], dtype=np.int32)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        found = self.edge.find(((node.astype(U) << U(9)) | symbol.astype(U)) * U(0x9E3779B97F4A7C15))
        return np.where(found >= 0, self.to[found], -1)

    def read(self, node: np.ndarray, count: np.ndarray, symbol: np.ndarray) -> None:
        """Advances all readers by a symbol in place; a node of -1 marks a word that can't be cut."""
        left = np.arange(len(node))
        while len(left):
            to = self.step(node[left], symbol[left])
            done = to >= 0
            node[left[done]] = to[done]
            left = left[~done]
            stuck = self.fail[node[left]] < 0
            node[left[stuck]] = -1
            left = left[~stuck]
            count[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]

    def lengths(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:end] and its end mark, or -1."""
        order = np.argsort(start - end, kind="stable")  # long words first
        start, size = start[order], (end - start)[order]
        node, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        live = len(start)
        for k in range(int(size[0]) + 1 if len(size) else 0):
            live = int(np.searchsorted(-size, -k, side="right"))  # words that have a symbol k, the end mark included
            some = np.flatnonzero(node[:live] >= 0)
            last = size[some] == k
            symbol = np.where(last, END, buf[np.where(last, 0, start[some] + k)].astype(np.int64))
            n, c = node[some], count[some]
            self.read(n, c, symbol)
            node[some], count[some] = n, c
        alive = np.flatnonzero(node >= 0)
        while len(alive := alive[node[alive] > 0]):  # what is left is cut as well
            stuck = self.fail[node[alive]] < 0
            node[alive[stuck]] = -1
            alive = alive[~stuck]
            count[alive] += self.pops[node[alive]]
            node[alive] = self.fail[node[alive]]
        out = np.empty(len(start), dtype=np.int64)
        out[order] = np.where(node < 0, -1, count)
        return out

    def counts(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and unknown words of each text."""
        _, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
        n = self.lengths(w.buf, w.start[first], w.end[first])[where] if len(first) else np.zeros(0, dtype=np.int64)
        return segment_sum(np.where(n < 0, 1, n), w.bounds), segment_sum((n < 0).astype(np.int64), w.bounds)


def token_counts(docs: DataFrame, pieces: list[tuple[int, ...]]) -> DataFrame:
    """docs (id, text) as id, n_words, n_tokens, n_unknown."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in chunks(batch.column(1)):
                tokens, unknown = automaton.value.counts(w)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(w.counts()), pa.array(tokens), pa.array(unknown)], names=["id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("id", "text").mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long")
