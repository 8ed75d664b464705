"""N-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence matrix.

A document is the set of its distinct word n-grams (shorter texts: their one whole sequence); equal sets are one class. Two classes
link when den * |A & B| >= num * |A | B|. The product is never formed as a whole:

1. The incidence matrix is cut in blocks of n-grams. A block learns in how many classes each n-gram stands and keeps those in two
   or more. Hot n-grams, whose entries would be too many for the task of a block, are dealt by class and come last in the order of
   frequency. A class whose kept n-grams are fewer than the smallest overlap that its size allows has no link and leaves.
2. In the order of rising frequency, linked classes share an n-gram within the first size - overlap + 1. Sharing one there makes
   candidate groups.
3. Within a group (cut in blocks of bounded weight) the product of the block's rows with their transpose gives overlap counts;
   pairs below the bound of their sizes are discarded, and only the groups that the links make leave the task.
4. Where a group had several blocks, representatives of what the blocks found are multiplied. Of what is still apart, classes that
   share a rare prefix n-gram are paired by it. Around frequent ones, the classes outside the largest group so far are multiplied,
   in blocks of near sizes, with all. So no link is lost, and copies are not expanded.

Null, empty and wordless texts have an empty set and link with nothing; very long ones are cut over the blocks like others. Every row
has a result; rows of one id are told apart by their sets, so an id with two texts has two results. A null id is no document's least
id unless all of a component's are null. n-grams are compared by 64-bit hashes. Columns other than id and text are not read. An
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.components import components
from chatloom.llm.kernel import U, Lookup, binaries, chunks, lean, mix, segment_sum, shingle_sets
from chatloom.llm.store import kept

NUM, DEN = 75, 100
#: Bounds of a task: n-grams of a block of the incidence matrix, and entries of the rows multiplied at once.
BLOCK_GRAMS, BLOCK_ENTRIES = 3_000_000, 300_000
#: Buckets of classes for each block of n-grams, as a bucket takes several times its entries to sort; counts of a product at once; pairs that are compared at once, each with all n-grams of both.
BUCKETS, COUNTS, PAIRS = 6, 1 << 21, 128
#: A task sends the matrix on after so many entries or texts.
EMIT, EMIT_ROWS = 1_500_000, 30_000
#: An n-gram is hot if it has more entries than this and more than a HOTth of all; TOP is its frequency in the order of n-grams.
HOT_LEAST, HOT, TOP = 4096, 1 << 20, 65535
AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Classes across blocks are paired by an n-gram that so many of them have at most in their prefixes; more are multiplied in blocks.
RARE = 16


def class_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 63-bit key for each set, of its size and the sum of its mixed hashes."""
    return (mix(segment_sum(mix(grams ^ U(0xA5A5A5A5A5A5A5A5)), bounds) + np.diff(bounds).astype(U)) >> U(1)).astype(np.int64)


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, cls, size) of docs (id, text), and beside them (gram, classes): n-grams that are frequent among the classes that a task has at a time, with in how many."""
    def frequent(parts: list, classes: np.ndarray) -> pa.RecordBatch:
        _, first = np.unique(classes, return_index=True)
        once = np.isin(np.arange(len(classes)), first)  # equal sets count once
        grams, count = np.unique(np.concatenate([g[once[at]] for g, at in parts]), return_counts=True)
        some = count >= max(8, len(classes) // 512)
        none = pa.nulls(int(some.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams[some].view(np.int64)), pa.array(count[some])], names=["id", "cls", "size", "gram", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, total, rows = [], [], 0, 0
        for batch in batches:
            for lo, hi, w in chunks(batch.column(1)):
                grams, bounds = shingle_sets(w, n)
                keys.append(class_keys(grams, bounds))
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(keys[-1]), pa.array(np.diff(bounds)), none, none], names=["id", "cls", "size", "gram", "classes"])
                parts.append((grams, rows + np.repeat(np.arange(hi - lo), np.diff(bounds))))
                total, rows = total + len(grams), rows + hi - lo
                if total >= EMIT or rows >= EMIT_ROWS:
                    yield frequent(parts, np.concatenate(keys))
                    parts, keys, total, rows = [], [], 0, 0
        if total:
            yield frequent(parts, np.concatenate(keys))

    return docs.select("id", "text").mapInArrow(lean(run), "id long, cls long, size long, gram long, classes long")


def hot_grams(own: DataFrame, total: int) -> np.ndarray:
    """n-grams of so many classes that one task shouldn't take them all; HOT at most, as each has over 1 / HOT of all entries."""
    by_gram = own.where("gram is not null").groupBy("gram").agg(F.sum("classes").alias("n"))
    found = by_gram.where(F.col("n") > max(HOT_LEAST, total // HOT)).select("gram").toArrow()
    return np.sort(found.column("gram").to_numpy().view(U))


def incidence(docs: DataFrame, n: int, blocks: int, hot: np.ndarray) -> DataFrame:
    """The incidence matrix in blocks of n-grams: (block, n, classes, at, grams), where grams[i] of n stands in class classes[at[i]]. A row names
    only the classes that its entries are of. Entries of hot n-grams go by their class to blocks from `blocks` on."""
    lookup = Lookup(hot)

    def packed(parts: list, classes: np.ndarray) -> pa.RecordBatch:
        grams = np.concatenate([p[0] for p in parts])
        at = np.concatenate([p[1] for p in parts])
        parts.clear()
        keys, first, where = np.unique(classes, return_index=True, return_inverse=True)
        first, where = first.astype(np.int32), where.astype(np.int32)
        once = first[where[at]] == at  # a class that the batch has twice is written once
        grams, at = grams[once], where[at[once]]
        block = block_of(grams, blocks).astype(np.int32)
        if len(hot):
            block = np.where(lookup.find(grams) >= 0, (blocks + keys[at] % blocks).astype(np.int32), block)
        order = np.lexsort((grams, block)) if len(hot) else np.argsort(grams)
        grams, at, block = grams[order], at[order], block[order]
        begin = begins(block)
        ends, some = np.append(begin, len(block)), block[begin].astype(np.int64)
        named = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):  # the classes of each block
            its, at[lo:hi] = np.unique(at[lo:hi], return_inverse=True)
            named.append(its)
        sizes = np.array([len(its) for its in named])
        kind = np.uint16 if int(sizes.max(initial=0)) <= 1 << 16 else np.uint32
        short = pa.array([squeezed(grams[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.diff(ends)), binaries(keys[np.concatenate(named)], np.append(0, np.cumsum(sizes))), binaries(at.astype(kind), ends), short], names=["block", "n", "classes", "at", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, total, rows = [], [], 0, 0
        for batch in batches:
            for lo, hi, w in chunks(batch.column(0)):
                grams, bounds = shingle_sets(w, n)
                parts.append((grams, np.repeat(np.arange(rows, rows + hi - lo, dtype=np.int32), np.diff(bounds))))
                keys.append(class_keys(grams, bounds))
                total, rows = total + len(grams), rows + hi - lo
                if total >= EMIT or rows >= EMIT_ROWS:
                    yield packed(parts, np.concatenate(keys))
                    parts, keys, total, rows = [], [], 0, 0
        if total:
            yield packed(parts, np.concatenate(keys))

    return docs.select("text").mapInArrow(lean(run), "block long, n long, classes binary, at binary, grams binary")


def squeezed(grams: np.ndarray) -> bytes:
    """Sorted n-grams as the first and six bytes of each difference; as they are where a difference needs more."""
    steps = np.diff(grams)
    if len(steps) and int(steps.max()) >> 48:
        return grams.tobytes()
    return grams[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsqueezed(short: bytes | pa.Buffer, n: int) -> np.ndarray:
    if len(short) == 8 * n:
        return np.frombuffer(short, dtype=U)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[1:, :6] = np.frombuffer(short, dtype=np.uint8, offset=8).reshape(-1, 6)
    steps[0] = np.frombuffer(short, dtype=np.uint8, count=8)
    return np.cumsum(steps.view(U).ravel(), dtype=U)


def block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> U(40)) * U(blocks)) >> U(24)


def begins(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def shared(block: int, table: pa.Table, blocks: int, buckets: int | None = None) -> pa.Table:
    """Of one block, the n-grams that two or more classes have and in how many, packed by buckets of classes; all of a block of hot ones, as the most frequent."""
    buckets = buckets or blocks
    counts = table.column("n").to_numpy()
    ends = np.append(0, np.cumsum(counts))
    c, g = np.empty(ends[-1], dtype=np.int64), np.empty(ends[-1], dtype=U)
    for lo, n, *row in zip(ends[:-1].tolist(), counts.tolist(), *(table.column(k) for k in ("classes", "at", "grams")), strict=True):
        classes, at, grams = (x.as_buffer() for x in row)
        g[lo : lo + n] = unsqueezed(grams, n)
        c[lo : lo + n] = np.frombuffer(classes, dtype=np.int64)[np.frombuffer(at, dtype=f"u{at.size // n}")]
    hot = block >= blocks
    if not hot:  # first without what is there once; one array at a time, as each has an entry's length
        order = np.argsort(g)
        g = g[order]
        twice = np.zeros(len(g), dtype=bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        g = g[twice]
        c = c[order]
        del order, twice
    by = np.lexsort((c, g))
    c = c[by]
    g = g[by]
    by = begins(g, c)
    c = c[by]
    g = g[by]
    begin = begins(g)
    count = np.diff(np.append(begin, len(g)))
    df = np.repeat((np.full(len(count), TOP) if hot else np.where(count > 1, np.minimum(count, TOP - 1), 0)).astype(np.uint16), count)
    c = c[df > 0]
    g = g[df > 0]
    df = df[df > 0]
    by = np.lexsort((c, (c % buckets).astype(np.int32)))
    c = c[by]
    g = g[by]
    df = df[by]
    del by
    begin = begins(c)
    count = np.diff(np.append(begin, len(c))).astype(np.int32)
    first = begins((c % buckets).astype(np.int32))
    entries = np.append(first, len(c))
    classes = np.searchsorted(begin, entries)
    return pa.table({"bucket": c[first] % buckets, "classes": binaries(c[begin], classes), "counts": binaries(count, classes), "grams": binaries(g, entries), "dfs": binaries(df, entries)})


SURVIVORS = pa.schema([("cls", pa.int64()), ("size", pa.int64()), ("entries", pa.int64()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def survivors(table: pa.Table, sizes: pa.Table, num: int, den: int) -> pa.Table:
    """Of one bucket of classes, those that may have a link: cls, size, entries, grams (sorted), prefix (rarest first)."""
    if not table.num_rows:
        return SURVIVORS.empty_table()
    cat = lambda k, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(k).to_pylist()])
    count, g, df = cat("counts", np.int32), cat("grams", U), cat("dfs", np.uint16)
    cls = np.repeat(cat("classes", np.int64), count)
    order = np.lexsort((g, df, cls))
    cls, g = cls[order], g[order]
    begin = begins(cls)
    known = sizes.sort_by("cls")
    size = known.column("size").to_numpy()[np.searchsorted(known.column("cls").to_numpy(), cls[begin])]
    entries = np.diff(np.append(begin, len(cls)))
    need = -(-num * size // den)
    live = entries >= need
    kept_row = np.repeat(live, entries)
    spare = np.repeat(entries - need + 1, entries)  # n-grams of no other class come first in the order and are not here
    prefix = g[kept_row & (np.arange(len(g)) - np.repeat(begin, entries) < spare)].view(np.int64)
    by = np.lexsort((g, cls))
    grams = g[by][kept_row]
    begin, entries, need, size = begin[live], entries[live], need[live], size[live]
    ends = lambda n: np.append(0, np.cumsum(n))
    lists = pa.ListArray.from_arrays(pa.array(ends(entries - need + 1).astype(np.int32)), pa.array(prefix))
    return pa.Table.from_arrays([pa.array(cls[begin]), pa.array(size), pa.array(entries), binaries(grams, ends(entries)), lists], schema=SURVIVORS)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return (inter > 0) & (den * inter >= num * (a + b - inter))


def product_roots(size: np.ndarray, grams: list[np.ndarray], num: int, den: int, rows: int | None = None) -> np.ndarray:
    """For rows of the incidence matrix, the first row of each one's group under the links that the product shows.

    With `rows`, only so many first rows are multiplied with all.
    """
    n = len(size)
    root = np.arange(n)
    if n < 2:
        return root

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    row = np.repeat(np.arange(n), [len(g) for g in grams])
    _, col, df = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    live = df[col] > 1
    row = row[live]
    _, col, df = np.unique(col[live], return_inverse=True, return_counts=True)
    by_col = np.argsort(col, kind="stable")
    start = np.append(0, np.cumsum(df))
    bounds = np.searchsorted(row, np.arange(n + 1))
    wide = n * n * len(df) <= 40 * int((df.astype(float) ** 2).sum())
    if wide:
        whole = np.zeros((n, len(df)), dtype=np.float32)
        whole[row, col] = 1
    step = max(1, min(256, COUNTS // n))
    rows = n if rows is None else rows
    for lo in range(0, rows, step):
        hi = min(rows, lo + step)
        if wide:
            inter = (whole[lo:hi] @ whole.T).astype(np.int64)
        else:
            counts = np.zeros((hi - lo) * n, dtype=np.int64)
            mine, cols = row[bounds[lo] : bounds[hi]] - lo, col[bounds[lo] : bounds[hi]]
            ends = np.cumsum(df[cols])
            at = 0
            while at < len(cols):  # column by column, as many at a time as have so many entries
                part = slice(at, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTS, "right"))))
                at = part.stop
                many = df[cols[part]]
                base = ends[part] - many
                spot = np.arange(base[0], ends[part][-1]) - np.repeat(base, many) + np.repeat(start[cols[part]], many)
                counts += np.bincount(np.repeat(mine[part], many) * n + row[by_col[spot]], minlength=len(counts))
            inter = counts.reshape(hi - lo, n)
        a, b = np.nonzero(linked(inter, size[lo:hi, None], size[None, :], num, den))
        a += lo
        for i, j in zip(a[a < b].tolist(), b[a < b].tolist(), strict=True) if np.count_nonzero(a < b) < 4 * n else forest(a[a < b], b[a < b], n):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Few of many links that join the same rows: repeatedly the least row that each row links to."""
    while len(a):
        least = np.arange(n)
        np.minimum.at(least, b, a)
        moved = np.flatnonzero(least != np.arange(n))
        yield from zip(least[moved].tolist(), moved.tolist(), strict=True)
        while not np.array_equal(least, hop := least[least]):
            least = hop
        a, b = least[a], least[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def block_links(rows: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """Products within each (grp, part) of rows (cls, grp, part, size, grams): (cls, root). With a column `mine`, of rows that have it true with all."""
    some = "mine" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        first = [("mine", "descending")] if some else []
        table = table.sort_by([("grp", "ascending"), ("part", "ascending"), *first, ("size", "ascending"), ("cls", "ascending")])
        grp, part, cls, size = (table.column(k).to_numpy() for k in ("grp", "part", "cls", "size"))
        mine = table.column("mine").to_numpy() if some else np.ones(len(cls), dtype=bool)
        grams = table.column("grams").combine_chunks() if table.num_rows else table.column("grams")
        new = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (part[1:] != part[:-1])]))
        out = np.empty(len(cls), dtype=np.int64)
        for lo, hi in zip(new, np.append(new[1:], len(cls)), strict=True):
            block = [np.frombuffer(g.as_buffer(), dtype=U) for g in grams[int(lo) : int(hi)]]
            out[lo:hi] = cls[lo + product_roots(size[lo:hi], block, num, den, int(mine[lo:hi].sum()))]
        return pa.table({"cls": cls, "root": out})

    keyed = rows.withColumn("task", F.pmod(F.xxhash64("grp", "part"), F.lit(tasks)))
    return keyed.groupBy("task").applyInArrow(lean(run), "cls long, root long")


def rare_links(alive: DataFrame, post: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes of different parts and roots that share a gram of post (cls, part, size, left, gram, root, main)."""
    x = post.where("root <> main").select("gram", *[F.col(c).alias(f"x_{c}") for c in ("cls", "part", "size", "left", "root")])
    y = post.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("cls", "part", "size", "left", "root", "main")])
    # linked classes have their first shared n-gram in both prefixes, and from there on all that they share
    reach = F.lit(num + den) * F.least("x_left", "y_left") >= F.lit(num) * (F.col("x_size") + F.col("y_size"))
    fits = reach & (F.lit(den) * F.least("x_size", "y_size") >= F.lit(num) * F.greatest("x_size", "y_size")) & (F.col("x_part") != F.col("y_part")) & (F.col("x_root") != F.col("y_root"))
    pairs = x.join(y, "gram").where(fits & ((F.col("y_root") == F.col("y_main")) | (F.col("x_cls") < F.col("y_cls")))).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()
    side = lambda k: alive.select(F.col("cls").alias(k), F.col("size").alias(f"{k}_size"), F.col("grams").alias(f"{k}_grams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ga, gb = (batch.column(k).to_pylist() for k in ("a", "b", "a_size", "b_size", "a_grams", "b_grams"))
            inter = np.array([len(np.intersect1d(np.frombuffer(p, dtype=U), np.frombuffer(q, dtype=U), assume_unique=True)) for p, q in zip(ga, gb, strict=True)], dtype=np.int64)
            yes = np.flatnonzero(linked(inter, np.array(na, dtype=np.int64), np.array(nb, dtype=np.int64), num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(yes)), batch.column("b").take(pa.array(yes))], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_grams", "b_grams")
    spark = alive.sparkSession
    before = spark.conf.get(AT_ONCE)
    spark.conf.set(AT_ONCE, PAIRS)
    try:
        return kept(both.mapInArrow(lean(run), "a long, b long"), "rare")
    finally:
        spark.conf.set(AT_ONCE, before)


def frequent_links(alive: DataFrame, post: DataFrame, labels: DataFrame, num: int, den: int, block_entries: int) -> DataFrame:
    """Links (a, b) between classes of different roots that share a gram of post (cls, gram), by products of blocks.

    Classes whose sizes may link are one step of den / num apart at most, so steps are blocked apart.
    """
    least = post.groupBy("gram").agg(F.min("cls").alias("least"))
    groups = components(post.join(least, "gram").where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")))
    step = F.col("size") if num >= den else F.floor(F.log("size") / float(np.log(den / num)) + 1e-9)
    rows = groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(labels, "cls").join(alive.select("cls", "size", "entries"), "cls")
    rows = kept(rows.withColumn("step", step.cast("long")), "frequent")
    main = rows.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max(F.struct("n", "root")).getField("root").alias("main"))
    x = rows.join(main, "grp").where("root <> main").select("cls", "grp", "size", "entries", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    parts = lambda side, name: side.groupBy("grp", "step").agg(F.sum("entries").alias(f"{name}_entries"), F.ceil(F.sum("entries") / block_entries).alias(name))
    blocks = kept(parts(x, "xs").join(parts(rows, "ys"), ["grp", "step"]), "blocks")
    tasks = max(1, int((blocks.agg(F.sum(F.expr("xs_entries * ys + ys_entries * xs"))).head()[0] or 0) // (4 * block_entries)) + 1)
    spread = lambda side, own, other, mine: (
        side.join(blocks, ["grp", "step"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .select("cls", "grp", F.xxhash64("step", *(("own", "other") if mine else ("other", "own"))).alias("part"), F.lit(mine).alias("mine"))
    )
    dealt = spread(x, "xs", "ys", True).unionByName(spread(rows, "ys", "xs", False))
    found = block_links(dealt.join(alive.select("cls", "size", "grams"), "cls"), num, den, tasks)
    return found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))


def cross_links(alive: DataFrame, labels: DataFrame, num: int, den: int, block_entries: int) -> DataFrame:
    """Links (a, b) between classes of different parts and roots, exactly: candidates share a prefix n-gram and fit in size."""
    post = alive.select("cls", "part", "size", (F.col("size") - F.col("entries")).alias("before"), F.posexplode("prefix").alias("pos", "gram"))
    post = kept(post.select("cls", "part", "size", (F.col("size") - F.col("before") - F.col("pos")).alias("left"), "gram").join(labels, "cls"), "postings")
    by_gram = post.groupBy("gram", "root").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "root")).getField("root").alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    by_gram = kept(by_gram.where("roots > 1").drop("roots"), "by_gram")
    rare = rare_links(alive, post.join(by_gram.where(F.col("n") <= RARE), "gram"), num, den)
    return rare.unionByName(frequent_links(alive, post.join(by_gram.where(F.col("n") > RARE), "gram").select("cls", "gram"), labels, num, den, block_entries))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = NUM, den: int = DEN, block_grams: int = BLOCK_GRAMS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """docs (id, text) as id, n_shingles, class_id (least id of those with the same set), component_id (least id that links reach). One row for each of docs' rows."""
    found = kept(sets(docs, n), "sets")
    own = found.where("cls is not null").select("id", "cls", "size")
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    blocks = max(1, min(1 << 20, -(-total // block_grams)))
    buckets = BUCKETS * blocks
    parts = incidence(docs, n, blocks, hot_grams(found, total)).groupBy("block").applyInArrow(lean(lambda key, t: shared(key[0].as_py(), t, blocks, buckets)), "bucket long, classes binary, counts binary, grams binary, dfs binary")
    sizes = own.where("size > 0").groupBy("cls").agg(F.max("size").alias("size")).withColumn("bucket", F.pmod("cls", F.lit(buckets)))
    alive = parts.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(lean(lambda t, u: survivors(t, u, num, den)), "cls long, size long, entries long, grams binary, prefix array<long>")
    alive = kept(alive, "survivors")
    post = alive.select("cls", F.explode("prefix").alias("gram"))
    least = post.groupBy("gram").agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = components(post.join(least, "gram").where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")))
    weights = alive.select("cls", "entries").join(groups, F.col("cls") == F.col("node")).groupBy(F.col("root").alias("grp")).agg(F.sum("entries").alias("weight"))
    weights = kept(weights.withColumn("parts", F.ceil(F.col("weight") / block_entries)), "weights")
    tasks = max(1, int((weights.agg(F.sum("weight")).head()[0] or 0) // (4 * block_entries)) + 1)
    alive = alive.join(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls").join(weights, "grp")
    alive = kept(alive.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts"))), "grouped")
    found = kept(block_links(alive.select("cls", "grp", "part", "size", "grams"), num, den, tasks), "links")
    if weights.where("parts > 1").head(1):
        several = alive.where("parts > 1")
        heads = several.join(found.where("cls = root").select("cls"), "cls")
        heads = heads.join(heads.groupBy("grp").agg(F.ceil(F.sum("entries") / block_entries).alias("own")), "grp")  # where little was linked, most are heads
        merged = kept(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(
            block_links(heads.select("cls", "grp", F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("own")).alias("part"), "size", "grams"), num, den, tasks).select(F.col("cls").alias("a"), F.col("root").alias("b"))), "merged")
        so_far = components(merged)
        labels = several.select("cls").join(so_far, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"))
        merged = merged.unionByName(cross_links(several, kept(labels, "labels"), num, den, block_entries))
    else:
        merged = found.select(F.col("cls").alias("a"), F.col("root").alias("b"))
    roots = components(merged)
    own = own.withColumn("cls", F.when(F.col("size") == 0, F.xxhash64("id")).otherwise(F.col("cls")))
    label = own.groupBy("cls").agg(F.min("id").alias("class_id")).join(roots, F.col("cls") == F.col("node"), "left").select("cls", "class_id", F.coalesce("root", "cls").alias("root"))
    label = kept(label, "classes")
    ends = label.groupBy("root").agg(F.min("class_id").alias("component_id"))
    label = label.join(ends, "root").select("cls", "class_id", "component_id")
    out = own.join(label, "cls").select("id", F.col("size").alias("n_shingles"), "class_id", "component_id")
    empty = F.col("n_shingles") == 0
    return out.select("id", "n_shingles", F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
