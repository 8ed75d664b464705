"""Connected components of an edge table by repeated contraction; nothing is gathered on the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.store import kept

#: So many edges at most (1 MB) are joined in one task; the rounds of more edges shrink down to that.
FEW = 1 << 16


def joined_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of few edges (a, b), by union-find."""
    table = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, at = np.unique(np.concatenate([table.column(k).to_numpy() for k in ("a", "b")]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    roots = nodes[[find(i) for i in range(len(nodes))]] if len(nodes) else nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for the nodes of edges (a long, b long): equal roots mark one component.

    Each round every node joins the neighbour (or itself) of least rank; the edges between the joined groups make the next, smaller
    round. Ranks are drawn anew in every odd round, so the rounds shrink geometrically on any graph; in even rounds they are the ids,
    so that stars around their least id, as joins by a shared key make them, vanish at once and not by halves. A node with many
    neighbours only takes a minimum. At `few` edges one task joins what is left, since more rounds would cost more than it does. What
    each round joined is put together once, at the end.
    """
    rounds = []
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.count() > few:
        turn = len(rounds)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.xxhash64(F.lit(turn), F.col(c)) if turn % 2 else F.col(c)  # noqa: B023, E731
        rank = lambda c: F.struct(drawn(c).alias("rank"), F.col(c).alias("of"))  # noqa: B023, E731
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best"))
        joined = kept(joined.select("node", F.least(rank("node"), "best").getField("of").alias("root")), "joined")
        moved = edges.join(joined.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(joined.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = kept(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        rounds.append(joined)
    labels = kept(edges.coalesce(1).mapInArrow(joined_at_once, "node long, root long"), "joined")
    for joined in reversed(rounds):
        labels = joined.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return kept(labels, "labels") if rounds else labels
