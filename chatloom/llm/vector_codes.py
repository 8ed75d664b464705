"""Product codes of whole-number vectors: each part of a vector becomes the index of its nearest codebook entry.

Codebooks start as the parts of the vectors with the smallest ids. In each round a kd-tree per codebook goes to all tasks with the
closure (entries x components, however many rows there are); a task assigns its rows' parts and adds up, per entry, how many it has and
their components; Spark adds the tasks' sums, and the driver, which gets a row an entry, takes the floors of the means.

The search in a tree is branch and bound for many points at once: each goes to the nearer side first, then to the other unless its box
is farther than the best so far. Boxes at an equal distance are visited too, and of equally near entries the lowest index stays. Numbers
below 2^24 are worked on as 64-bit integers, which hold all sums of squares of parts of up to 4096 components; rows or entries beyond
are worked on as Python integers.

Vectors of the most frequent size that is a multiple of the number of parts (of equally frequent ones the smallest) have codes. Of
vectors without a code (null, with null components, of another size) the code and the error are null. Null ids come last in the
codebooks' order; rows of equal id are taken by their vectors. Repeated rows count repeatedly. With fewer vectors than entries,
codebooks are shorter; without any, they are empty. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.topk_search import by_size

LEAF = 8
#: Points that are searched at once, so that what they need stays in the processor's cache.
POINTS = 1 << 13
PLAIN = 1 << 24
LONG = (1 << 63) - 1


class Tree:
    """A kd-tree over a codebook's entries: inner nodes have two children, leaves the indices of their entries; each has its entries' box."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.nodes = entries, []
        self._add(np.arange(len(entries)))

    def _add(self, some: np.ndarray) -> int:
        own, node = self.entries[some], len(self.nodes)
        low, high = own.min(axis=0), own.max(axis=0)
        self.nodes.append([low, high, some, None])
        if len(some) > LEAF and (high > low).any():
            axis = int(np.argmax([int(h) - int(lo) for lo, h in zip(low, high, strict=True)]))
            order = some[np.argsort(own[:, axis], kind="stable")]
            self.nodes[node][3] = [self._add(np.sort(side)) for side in (order[: len(order) // 2], order[len(order) // 2 :])]
        return node

    def away(self, node: int, points: np.ndarray) -> np.ndarray:
        """Squared distances from points to a node's box."""
        low, high = self.nodes[node][:2]
        over = np.maximum(np.maximum(low - points, points - high), 0)
        return (over * over).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, the lowest index of equally near ones, and its squared distance."""
        index, best = np.full(len(points), len(self.entries)), np.full(len(points), LONG, points.dtype)
        if points.dtype == object:
            best[:] = 1 << 200
        self._visit(0, np.arange(len(points)), points, index, best)
        return index, best

    def _visit(self, node: int, at: np.ndarray, points: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(at):
            return
        _, _, some, children = self.nodes[node]
        if children is None:
            for entry in some:  # by rising index
                apart = points[at] - self.entries[entry]
                far = (apart * apart).sum(axis=1)
                nearer = (far < best[at]) | ((far == best[at]) & (entry < index[at]))
                index[at[nearer]], best[at[nearer]] = entry, far[nearer]
            return
        one, two = (self.away(child, points[at]) for child in children)
        first = one <= two
        for child, own, mine in ((0, first, one), (1, ~first, two), (1, first, two), (0, ~first, one)):
            open_ = own & (mine <= best[at])
            self._visit(children[child], at[open_], points, index, best)


@dataclass
class Codebooks:
    """By part: the entries, rows of whole numbers. size: of the vectors they are for."""

    books: list[np.ndarray]
    size: int

    def numbers(self) -> list[int]:
        """All components by part, entry and position."""
        return [int(x) for book in self.books for x in book.ravel()]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.numbers())).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(book) for book in self.books]


def narrow(m: np.ndarray) -> bool:
    return not m.size or max(-int(m.min()), int(m.max())) < PLAIN


def assigned(trees: list[Tree], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and part of m: the nearest entry and its squared distance."""
    width = m.shape[1] // len(trees)
    codes, far = np.zeros((len(m), len(trees)), np.int64), np.zeros((len(m), len(trees)), m.dtype)
    for p, tree in enumerate(trees):
        for lo in range(0, len(m), POINTS):
            codes[lo : lo + POINTS, p], far[lo : lo + POINTS, p] = tree.nearest(np.ascontiguousarray(m[lo : lo + POINTS, p * width : (p + 1) * width]))
    return codes, far


def pieces(column: pa.ListArray, size: int, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a size, with their matrix: plain integers, or Python's for rows or codebooks that need them."""
    for own, of, m in by_size(column):
        if own == size:
            big = np.full(len(of), True) if wide else (np.abs(m.astype(np.float64)) >= PLAIN).any(axis=1)
            for some, kind in ((~big, np.int64), (big, object)):
                if some.any():
                    yield of[some], m[some].astype(kind)


def rounded(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the componentwise floor of its parts' mean; entries without parts stay."""
    width, wide = books.size // len(books.books), not all(narrow(b) for b in books.books)
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        many = [np.zeros(len(b), np.int64) for b in books.books]
        sums = [np.zeros(b.shape, object) for b in books.books]
        for batch in batches:
            for _, m in pieces(batch.column(0), books.size, wide):
                codes, _ = assigned(trees, m)
                for p, tree in enumerate(trees):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    sums[p][used] += np.add.reduceat(m[order, p * width : (p + 1) * width], first, axis=0).astype(object)
                    many[p] += np.bincount(codes[:, p], minlength=len(tree.entries))
        slot, count, total = [], [], []
        for p, n in enumerate(many):
            for entry in np.flatnonzero(n):
                slot.append(p * len(n) + entry)
                count.append(n[entry])
                total.append([str(x) for x in sums[p][entry]])
        columns = list(zip(*total, strict=True)) if total else [()] * width
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(count, pa.int64()), *[pa.array(c, pa.string()) for c in columns]], names=["slot", "n", *names])

    schema = ", ".join(["slot long", "n long", *[f"{c} string" for c in names]])
    sums = rows.select("vector").mapInArrow(run, schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
    new = [b.astype(object) for b in books.books]
    for r in sums.collect():  # a row an entry
        p, entry = divmod(r["slot"], len(books.books[0]))
        new[p][entry] = [int(r[c]) // r["n"] for c in names]
    return Codebooks([b.astype(np.int64) if narrow(b) else b for b in new], books.size)


def learn(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of vectors (id, vector of longs)."""
    rows = vectors.select("id", "vector").where("vector is not null and forall(vector, x -> x is not null)")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().where((F.col("size") % parts == 0) & (F.col("size") > 0))
    size = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    if not size:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, 0)
    rows, width = rows.where(F.size("vector") == size[0]["size"]), size[0]["size"] // parts
    first = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()]
    start = np.array(first, dtype=np.int64)
    start = start if narrow(start) else start.astype(object)
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(parts)], size[0]["size"])
    for _ in range(rounds):
        books = rounded(rows, books)
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors with code (an array of indices, one a part) and error (the squared distances' sum) after their columns; columns of these names are replaced."""
    wide, stay = not all(narrow(b) for b in books.books), [f for f in vectors.schema if f.name not in ("code", "error")]
    names = [f"c{k}" for k in range(len(stay))]
    whole = F.when(F.forall(vectors["vector"], lambda x: x.isNotNull()), vectors["vector"])
    plain = vectors.select(*[vectors[f"`{f.name}`"].alias(c) for c, f in zip(names, stay, strict=True)], whole.alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees() if books.size else []
        for batch in batches:
            column, n = batch.column(len(stay)), batch.num_rows
            codes, error, known = np.zeros((n, len(books.books)), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            for of, m in pieces(column, books.size, wide) if trees else ():
                codes[of], far = assigned(trees, m)
                total = far.sum(axis=1)
                error[of], known[of] = total if total.dtype != object else [min(int(x), LONG) for x in total], True
            missing = pa.array(~known)
            code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(books.books), pa.int32()), pa.array(codes.ravel(), pa.int64()), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array(error, mask=~known)], names=[*names, "code", "error"])

    schema = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(stay)], T.StructField("code", T.ArrayType(T.LongType())), T.StructField("error", T.LongType())])
    return plain.mapInArrow(run, schema).toDF(*[f.name for f in stay], "code", "error")
