"""Exact top-k search by inner product of whole-number vectors: ball-tree branch and bound, shard by shard.

The top of the ball tree is fitted on a bounded sample (`sample` rows of a vector size, fewer if they are long) and deals all rows to
shards of about `shard` rows; each shard's ball has the sample's centre and the exact radius over all its rows. A query visits its shards
by falling upper bound (inner product with the centre plus its length times the radius) in rounds: the best one, the next eight, the rest.
The k-th score after a round is shared with the next: shards that can't reach it are never visited, and in a shard's own ball tree nodes
that can't reach it are cut. There leaves are taken by falling bound for all queries of a block at once. Bounds are widened by more than
floating point can err, and equal bounds are visited, so results are exact and ties go to the smaller id.

Of rows with the same vector only the k + 1 smallest ids can be among any query's k: a rank limit before the shuffle keeps no others.
Shards of more rows than `slice_rows` are cut in slices and a shard's queries in blocks, so that no task's memory grows with the tables.
What comes to the driver are the balls of at most sample / 16 shards a vector size.

Components are longs; scores beyond a long count as its ends. Rows with null ids, null vectors or null components take no part, and
vectors of different sizes never meet. Rows with the query's id are its own; of a repeated id's vectors the best counts, and queries
of one id are one. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.store import kept

LEAF = 256
#: Shards that a round visits at most; the last takes all that are left.
ROUNDS = (1, 8, None)
LOW, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(v: Column, by: int = 256) -> Column:
    """Each component x as floor(by * x), as a long."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * by))


def reached(q: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For queries (rows) and balls (columns): more than any inner product of the query with a vector in the ball."""
    about = np.abs(q) @ np.abs(centre).T + lengths[:, None] * radius
    return q @ centre.T + lengths[:, None] * radius + 1e-9 * about + 1e-6


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; what a long can't hold becomes its end."""
    most = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, LOW, NONE).astype(np.int64)


class Balls:
    """A balanced ball tree over the rows of x: `order` lists them leaf by leaf; level l has 2^l nodes, given by bounds, centre and radius."""

    def __init__(self, x: np.ndarray) -> None:
        points, n = x.astype(np.float64), len(x)
        depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
        self.order, bounds = np.arange(n), np.array([0, n])
        self.levels = [self._level(points, bounds)]
        for _ in range(depth):
            cuts = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own, half = self.order[lo:hi], (hi - lo) // 2
                line = direction(points[own])
                self.order[lo:hi] = own[np.argpartition(points[own] @ line, half)] if 0 < half < hi - lo else own
                cuts += [lo, lo + half]
            bounds = np.append(cuts, n)
            self.levels.append(self._level(points[self.order], bounds))
        self.bounds = bounds

    @staticmethod
    def _level(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = np.add.reduceat(points, bounds[:-1]) / np.diff(bounds)[:, None]
        away = np.sqrt(((points - np.repeat(centre, np.diff(bounds), axis=0)) ** 2).sum(axis=1))
        return centre, np.maximum.reduceat(away, bounds[:-1])

    def leaf_bounds(self, q: np.ndarray, lengths: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Upper bounds by leaf, level by level; below a node that no query's floor lets in nothing is worked out."""
        upper = reached(q, lengths, *self.levels[0])
        for centre, radius in self.levels[1:]:
            upper = np.repeat(upper, 2, axis=1)
            open_ = np.flatnonzero((upper >= floors[:, None]).any(axis=0))
            upper[:, open_] = np.minimum(upper[:, open_], reached(q, lengths, centre[open_], radius[open_]))
        return upper


def direction(points: np.ndarray) -> np.ndarray:
    """From the point farthest from the mean to the one farthest from it."""
    one = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    return points[((points - one) ** 2).sum(axis=1).argmax()] - one


def once(score: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of scores by falling score, with each name's first only; the others go to the end without a name."""
    by = np.argsort(name, axis=1, kind="stable")
    own = np.take_along_axis(name, by, 1)
    again = np.zeros(name.shape, bool)
    np.put_along_axis(again, by[:, 1:], own[:, 1:] == own[:, :-1], 1)
    name = np.where(again, NONE, name)
    top = np.lexsort((name, np.where(name == NONE, NONE, ~score)), axis=1)
    return np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)


def searched(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of x for each query, as far as they reach its floor: queries' numbers, ids and scores."""
    tree = Balls(x)
    ids, x, q_float = ids[tree.order], x[tree.order], q.astype(np.float64)
    upper = tree.leaf_bounds(q_float, np.sqrt((q_float**2).sum(axis=1)), floors.astype(np.float64))
    turns, repeated = np.argsort(-upper, axis=1, kind="stable"), len(np.unique(ids)) < len(ids)
    best, best_id = np.full((len(q), k), LOW), np.full((len(q), k), NONE)
    kth, live = floors.copy(), np.arange(len(q))
    for turn in range(turns.shape[1]):
        leaf = turns[live, turn]
        going = upper[live, leaf] >= kth[live]  # bounds fall and floors rise: who stops here is done
        live, leaf = live[going], leaf[going]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        ends = np.append(np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1])), len(by))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            some, rows = live[by[lo:hi]], slice(tree.bounds[leaf[by[lo]]], tree.bounds[leaf[by[lo]] + 1])
            score = products(q[some], x[rows])
            name = np.broadcast_to(ids[rows], score.shape)
            out = (score < kth[some][:, None]) | (name == q_ids[some][:, None])
            some, score, name, out = (v[~out.all(axis=1)] for v in (some, score, name, out))
            score = np.concatenate([best[some], np.where(out, LOW, score)], axis=1)
            name = np.concatenate([best_id[some], np.where(out, NONE, name)], axis=1)
            top = np.lexsort((name, ~score), axis=1)
            score, name = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
            if repeated:
                score, name = once(score, name)
            best[some], best_id[some] = score[:, :k], name[:, :k]
            full = best_id[some, k - 1] != NONE
            kth[some[full]] = np.maximum(kth[some[full]], best[some[full], k - 1])
    found = best_id != NONE
    return np.nonzero(found)[0], best_id[found], best[found]


class Top:
    """The first levels of a tree, fitted on a sample: nodes in heap order with a direction and a value that part the points."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth, self.line, self.at = depth, np.zeros((2**depth - 1, points.shape[1])), np.zeros(2**depth - 1)
        self.centre = np.zeros((2**depth, points.shape[1]))
        todo = [(0, points)]
        while todo:
            node, some = todo.pop()
            if node >= 2**depth - 1:
                self.centre[node - (2**depth - 1)] = some.mean(axis=0) if len(some) else 0
            elif len(some):
                self.line[node] = direction(some)
                self.at[node] = np.median(some @ self.line[node])
                right = some @ self.line[node] >= self.at[node]
                todo += [(2 * node + 1, some[~right]), (2 * node + 2, some[right])]

    def shards(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((points * self.line[node]).sum(axis=1) >= self.at[node])
        return node - (2**self.depth - 1)


@dataclass
class Shards:
    """Of one vector size: the shards that have rows, and their balls."""

    shard: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    def turns(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shards by falling bound for one query, worked out in the same way each time."""
        length = math.sqrt(float((q * q).sum()))
        about = (np.abs(self.centre) * np.abs(q)).sum(axis=1) + length * self.radius
        upper = (self.centre * q).sum(axis=1) + length * self.radius + 1e-9 * about + 1e-6
        order = np.argsort(-upper, kind="stable")
        return self.shard[order], upper[order]


def by_size(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sizes of a list column's vectors, with the rows and the matrix of each."""
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(bounds)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        yield size, of, values[bounds[of][:, None] + np.arange(size)]


def dealt(rows: DataFrame, tops: dict[int, Top]) -> DataFrame:
    """rows (id, vector) with size, shard and the distance from the shard's centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, of, m in by_size(batch.column(1)):
                top, take = tops[size], pa.array(of)
                points = m.astype(np.float64)
                shard = top.shards(points)
                away = np.sqrt(((points - top.centre[shard]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(of), size)), pa.array(shard), pa.array(away)], names=["id", "vector", "size", "shard", "away"])

    return rows.select("id", "vector").mapInArrow(run, "id long, vector array<long>, size long, shard long, away double")


def routed(asked: DataFrame, shards: dict[int, Shards], begin: int, end: int | None) -> DataFrame:
    """asked (id, vector, floor) once for each of its shards from turn begin to end that may hold a score of its floor or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = batch.column(2).to_numpy()
            for size, of, m in by_size(batch.column(1)):
                for i, q in zip(of, m.astype(np.float64), strict=True):
                    to, upper = shards[size].turns(q) if size in shards else (np.zeros(0, np.int64), np.zeros(0))
                    to = to[begin:end][upper[begin:end] >= float(floor[i])]
                    if len(to):
                        same = pa.array(np.full(len(to), i))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), size)), pa.array(to), *[batch.column(c).take(same) for c in range(3)]], names=["size", "shard", "id", "vector", "floor"])

    return asked.select("id", "vector", "floor").mapInArrow(run, "size long, shard long, id long, vector array<long>, floor long")


def met(index: DataFrame, asked: DataFrame, counts: dict[tuple[int, int], int], k: int, slice_rows: int, block: int) -> DataFrame:
    """What queries asked (size, shard, id, vector, floor) find in their shards: query_id, id, score. counts has the rows of each shard."""
    plan = [(r["size"], r["shard"], -(-counts[r["size"], r["shard"]] // slice_rows), -(-r["count"] // block)) for r in asked.groupBy("size", "shard").count().collect()]
    plan = F.broadcast(index.sparkSession.createDataFrame(plan, "size long, shard long, slices long, blocks long"))  # a row a shard
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(plan, ["size", "shard"]).select("size", "shard", F.pmod(F.xxhash64("id"), "slices").alias("slice"), each("blocks").alias("block"), "id", "vector")
    right = asked.join(plan, ["size", "shard"]).select("size", "shard", each("slices").alias("slice"), F.pmod(F.xxhash64(F.lit(3), "id"), "blocks").alias("block"), "id", "vector", "floor")
    right = right.toDF(*[f"q_{c}" for c in right.columns])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([m for chunk in column.chunks for _, _, m in by_size(chunk)])  # a group has one size

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        at, name, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q_id = b.column("q_id").to_numpy()
        if a.num_rows and b.num_rows:
            at, name, score = searched(a.column("id").to_numpy(), matrix(a.column("vector")), q_id, matrix(b.column("q_vector")), b.column("q_floor").to_numpy(), k)
        return pa.table({"query_id": pa.array(q_id[at]), "id": pa.array(name), "score": pa.array(score)})

    by, parts = ["size", "shard", "slice", "block"], int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, for few bytes here are much work
    q_by = [f"q_{c}" for c in by]
    return left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *q_by).groupBy(*q_by)).applyInArrow(run, "query_id long, id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard: int = 16_384, sample: int = 16_384, slice_rows: int = 32_768, block: int = 8_192) -> DataFrame:
    """vectors (id, vector of longs): for each row where `queries` holds, the k of the highest inner product: query_id, rank, id, score."""
    rows = vectors.select("id", "vector", queries.alias("asks")).where("id is not null and vector is not null and forall(vector, x -> x is not null)")
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    index = kept(rows.select("id", "vector").distinct().withColumn("rank", first).where(F.col("rank") <= k + 1).select("id", "vector"), "topk_rows")
    asked = kept(rows.where("asks").select("id", "vector").distinct(), "topk_asked")
    tops = {}
    for r in index.groupBy(F.size("vector").cast("long").alias("size")).count().collect():
        most = max(64, min(sample, (1 << 21) // max(1, r["size"])))
        some = index.where((F.size("vector") == r["size"]) & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(-(-r["count"] // most))) == 0))
        points = some.select("vector").toArrow().column("vector").to_pylist()
        points = np.array(points, np.float64).reshape(len(points), r["size"])
        depth = max(0, min(math.ceil(math.log2(r["count"] / shard)), int(math.log2(max(1, len(points) // 16)))))
        tops[r["size"]] = Top(points, depth)
    placed = dealt(index, tops)
    found = sorted(placed.groupBy("size", "shard").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect(), key=lambda r: (r["size"], r["shard"]))
    counts, shards = {(r["size"], r["shard"]): r["n"] for r in found}, {}
    for size, top in tops.items():
        own = [r for r in found if r["size"] == size]
        shards[size] = Shards(np.array([r["shard"] for r in own]), top.centre[[r["shard"] for r in own]], np.array([r["radius"] for r in own]))
    asked, results, begin = asked.withColumn("floor", F.lit(LOW)), None, 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda df: df.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    for width in ROUNDS:
        end = None if width is None else begin + width
        new = kept(met(placed.select("size", "shard", "id", "vector"), kept(routed(asked, shards, begin, end), "topk_routed"), counts, k, slice_rows, block), "topk_found")
        results, begin = new if results is None else results.unionByName(new), end
        if end is None or end >= max((len(s.shard) for s in shards.values()), default=0):
            break
        floor = best(results).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
        asked = asked.join(floor, "id", "left").select("id", "vector", F.coalesce("reached", F.lit(LOW)).alias("floor"))
    return best(results).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
