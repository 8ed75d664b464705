"""Approximate nearest neighbours by cosine: few stable (Gaussian) projections in a kd-tree, with incremental verification.

Vectors are scaled to length 1, so cosine falls as distance grows. Gaussian projections keep distances in this sense: the squared
projected distance over the squared true one follows a chi-square law with as many degrees as projections. For a query the tree's
leaves are taken by rising projected distance and their vectors verified in full; it stops when, by that law, an unseen vector
nearer than the k-th found would with probability `certainty` have been projected nearer than all that is left.

The top of the tree is fitted on a bounded sample of projections (`sample` rows of a vector size) and deals all rows to cells of about
`cell` rows; a cell has the exact box of its rows and a tree of its own. Every query first searches its own cell. Its k-th distance then
tells which cells the stopping test can't exclude, and only to these it goes on, with what it has as its floor. Cells of more than
`shard` rows are split, and the queries of a cell go in blocks of about `block`, so that no task's memory grows with the tables. What
comes to the driver are the boxes of at most sample / 16 cells a vector size.

Scores are exact cosines in double precision; ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
components take no part, nor do null ids; vectors of different sizes never meet. Rows with the query's id are its own; of a repeated
id's vectors the nearest counts, and queries of one id are one. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.kernel import binaries
from chatloom.llm.store import kept

LEAF = 128


def chi_square(x: np.ndarray | float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    half = x / 2
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, degrees) < p else (lo, mid)
    return hi


class Tree:
    """Leaves of a kd-tree over points: `order` lists the points leaf by leaf, low and high are the leaves' boxes."""

    def __init__(self, points: np.ndarray) -> None:
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            some = todo.pop()
            spread = points[some].max(axis=0) - points[some].min(axis=0)
            if len(some) <= LEAF or not spread.any():
                leaves.append(some)
                continue
            by = np.argpartition(points[some, spread.argmax()], len(some) // 2)
            todo += [some[by[len(some) // 2 :]], some[by[: len(some) // 2]]]
        self.order = np.concatenate(leaves)
        self.bounds = np.append(0, np.cumsum([len(x) for x in leaves]))
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to every leaf's box."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(axis=1)


def projection(size: int, degrees: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, size)).standard_normal((size, degrees))


class Cuts:
    """The top of a tree: nodes in heap order, each with the axis and the value that part its points."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
        todo = [(0, points)]
        while todo:
            node, some = todo.pop()
            if node >= len(self.axis) or not len(some):
                continue
            self.axis[node] = axis = int((some.max(axis=0) - some.min(axis=0)).argmax())
            self.cut[node] = cut = np.median(some[:, axis])
            right = some[:, axis] >= cut
            todo += [(2 * node + 1, some[~right]), (2 * node + 2, some[right])]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[row, self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)


@dataclass
class Boxes:
    """Of one vector size: the cells that have rows, and the least box of each one's projections."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to every box."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(axis=1)


def searched(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, lines: np.ndarray, stop: float) -> list[tuple[int, int, float]]:
    """For each query its k nearest of the vectors, as far as they reach its floor."""
    norms, q_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    tree = Tree((vectors / norms[:, None]) @ lines)
    rows, lengths, names = vectors[tree.order], norms[tree.order], ids[tree.order]
    out = []
    for q_id, q, length, floor in zip(q_ids, queries, q_norms, floors, strict=True):
        away = tree.distances((q / length) @ lines)
        order = np.argsort(away, kind="stable")
        best_id, best, done, width = np.zeros(0, dtype=np.int64), np.zeros(0), 0, 2
        while done < len(order):
            reach = max(floor, best[-1]) if len(best) == k else floor
            if away[order[done]] > stop * max(0.0, 2 - 2 * reach):
                break
            spans = [slice(tree.bounds[leaf], tree.bounds[leaf + 1]) for leaf in order[done : done + width]]
            name = np.concatenate([names[s] for s in spans])
            cosine = (np.concatenate([rows[s] for s in spans]) * q).sum(axis=1) / (np.concatenate([lengths[s] for s in spans]) * length)
            other = (name != q_id) & (cosine >= floor)
            name, cosine = np.concatenate([best_id, name[other]]), np.concatenate([best, cosine[other]])
            top = np.lexsort((name, -cosine))
            name, cosine = name[top], cosine[top]
            first = np.sort(np.unique(name, return_index=True)[1])[:k]
            best_id, best = name[first], cosine[first]
            done, width = done + width, width * 2
        out += [(int(q_id), int(n), float(c)) for n, c in zip(best_id, best, strict=True)]
    return out


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)


def dealt(rows: DataFrame, cuts: dict[int, Cuts], degrees: int, seed: int, kind: np.dtype) -> DataFrame:
    """rows (id, vector, asks) with their size, cell and projection; vectors as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(bounds)
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                m = values[bounds[of][:, None] + np.arange(size)].astype(kind)
                unit = m.astype(np.float64)
                point = (unit / np.sqrt((unit * unit).sum(axis=1))[:, None]) @ projection(size, degrees, seed)
                cell = cuts[size].cells(point) if size in cuts else np.zeros(len(of), dtype=np.int64)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(np.full(len(of), size)), pa.array(cell), binaries(m, np.arange(len(of) + 1) * size), pa.FixedSizeListArray.from_arrays(pa.array(point.ravel()), degrees).cast(pa.list_(pa.float64()))], names=["id", "asks", "size", "cell", "vector", "point"])

    return rows.select("id", "vector", "asks").mapInArrow(run, "id long, asks boolean, size long, cell long, vector binary, point array<double>")


def met(index: DataFrame, asked: DataFrame, counts: dict[tuple[int, int], int], k: int, degrees: int, stop: float, seed: int, kind: np.dtype, shard: int, block: int) -> DataFrame:
    """What the queries asked (size, cell, id, vector, floor) find in their cells: query_id, id, score. counts has the rows of each cell."""
    spark = index.sparkSession
    plan = [(r["size"], r["cell"], -(-counts[r["size"], r["cell"]] // shard), -(-r["count"] // block)) for r in asked.groupBy("size", "cell").count().collect()]
    plan = F.broadcast(spark.createDataFrame(plan, "size long, cell long, shards long, blocks long"))  # a row a cell
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(plan, ["size", "cell"]).select("size", "cell", F.pmod(F.xxhash64("id"), "shards").alias("shard"), each("blocks").alias("block"), "id", "vector")
    right = asked.join(plan, ["size", "cell"]).select("size", "cell", each("shards").alias("shard"), F.pmod(F.xxhash64(F.lit(3), "id"), "blocks").alias("block"), "id", "vector", "floor")
    right = right.toDF(*[f"q_{c}" for c in right.columns])  # both sides may come from one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            vectors = matrix(a.column("vector"), kind)
            found = searched(a.column("id").to_numpy(), vectors, b.column("q_id").to_numpy(), matrix(b.column("q_vector"), kind), b.column("q_floor").to_numpy(), k, projection(vectors.shape[1], degrees, seed), stop)
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    by = ["size", "cell", "shard", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"q_{c}" for c in by])).applyInArrow(run, "query_id long, id long, score double")


def routed(asked: DataFrame, boxes: dict[int, Boxes], stop: float) -> DataFrame:
    """asked (size, cell, id, vector, point, floor) once for each other cell that may hold a vector above the floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cell, floor = (batch.column(c).to_numpy() for c in (0, 1, 5))
            points = batch.column(4).values.to_numpy().reshape(batch.num_rows, -1)
            for i in range(batch.num_rows):
                box = boxes[int(size[i])]
                to = box.cell[(box.distances(points[i]) <= stop * max(0.0, 2 - 2 * floor[i])) & (box.cell != cell[i])]
                if len(to):
                    same = pa.array(np.full(len(to), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), pa.array(to), batch.column(2).take(same), batch.column(3).take(same), batch.column(5).take(same)], names=["size", "cell", "id", "vector", "floor"])

    return asked.select("size", "cell", "id", "vector", "point", "floor").mapInArrow(run, "size long, cell long, id long, vector binary, floor double")


def nearest(vectors: DataFrame, queries: Column, k: int = 5, degrees: int = 8, certainty: float = 0.95, cell: int = 4096, sample: int = 1 << 16, shard: int = 20_000, block: int = 5_000, seed: int = 7) -> DataFrame:
    """vectors (id, vector): for each row where `queries` holds, its k nearest: query_id, rank, id, score."""
    kind = np.dtype(np.float32 if isinstance(vectors.schema["vector"].dataType.elementType, T.FloatType) else np.float64)
    stop = quantile(certainty, degrees)
    rows = vectors.select("id", "vector", F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null").where(usable(F.col("vector")))
    cuts = {}
    for r in rows.groupBy(F.size("vector").cast("long").alias("size")).count().collect():
        if r["count"] > cell:
            some = rows.where((F.size("vector") == r["size"]) & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(-(-r["count"] // sample))) == 0))
            points = dealt(some, {}, degrees, seed, kind).select("point").toArrow().column("point").combine_chunks().values.to_numpy().reshape(-1, degrees)
            cuts[r["size"]] = Cuts(points, min(math.ceil(math.log2(r["count"] / cell)), int(math.log2(max(1, len(points) // 16)))))
    rows = kept(dealt(rows, cuts, degrees, seed, kind), "ann_rows")
    ends = [f(F.get("point", F.lit(j))).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(degrees)]
    cells = sorted(rows.groupBy("size", "cell").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: (r["size"], r["cell"]))
    counts = {(r["size"], r["cell"]): r["n"] for r in cells}
    boxes = {}
    for size in {r["size"] for r in cells}:
        own = [r for r in cells if r["size"] == size]
        side = lambda name: np.array([[r[f"{name}{j}"] for j in range(degrees)] for r in own])  # noqa: B023, E731
        boxes[size] = Boxes(np.array([r["cell"] for r in own]), side("low"), side("high"))
    asked, index, options = rows.where("asks"), rows.select("size", "cell", "id", "vector"), (k, degrees, stop, seed, kind, shard, block)
    found = kept(met(index, asked.withColumn("floor", F.lit(-2.0)), counts, *options), "ann_own")
    if len(cells) > len(boxes):
        by = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floor = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        asked = asked.join(floor, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        found = found.unionByName(met(index, kept(routed(asked, boxes, stop), "ann_routed"), counts, *options))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
