"""Language-model scores of whole texts: a gated recurrent network in numpy with a class-factored softmax.

Words come in vocabulary order of their counts over all training texts. The network reads and predicts symbols: the end of the text,
the `vocabulary` most frequent words, a group for each of the other `frequent` words, and one symbol for all words beyond. `groups` groups
hold words that stand in like company, as the counts of all training texts tell it; in its group a word's share comes from its count
plus one. The softmax first predicts a symbol's class, then the symbol in its class. Training runs truncated backpropagation through windows of `steps` words. The
driver starts the network on a bounded sample of texts (`sample`, lowest by a hash of their id); then it is trained on all training
texts: each falls, by a hash of id and words (without an id: by its place in the written table, as those may all be equal), to one
part of about `part` words; in each of `rounds` rounds a share of the parts
trains from the same weights, each part in one task as `wide` streams, and the parts' weights are averaged by their words. Scoring carries the state
through all windows of a text to its end, so every score is the log-likelihood of the whole text.

The unigram base needs the count of every word. Counts are gathered over all training texts; the `frequent` most common ones go to
every task (a fixed bound), the words beyond them meet their counts in a join.

Tokens are the words of a text and one end. Null and empty texts have the end alone; very long ones are trained on in pieces and scored
whole. Rows are scored one by one, so repeated rows get repeated scores. Other columns are not read. An empty table gives an empty
one, and without training rows every word is as likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.kernel import Lookup, binaries, chunks, memory_at_hand, one_thread, segment_sum
from chatloom.llm.store import kept

END, OTHER = 0, 1
#: Tokens whose probabilities are worked out together.
AT_ONCE = 1 << 14
#: Texts of about a length that are scored side by side: the states of more don't fit in a cache.
TEXTS = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], dtype=x.dtype)


def within(total: np.ndarray) -> bool:
    """Whether sums of exponentials are far from what float32 can't hold."""
    return bool(total.min() > 1e-25 and total.max() < 1e25)


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    """Over each row. Without a maximum it is cheaper; where exponentials grow or shrink too much for that, each row takes its own."""
    with np.errstate(over="ignore"):
        total = row_sums(np.exp(x))
    if within(total):
        return np.log(total)
    top = x.max(axis=1, keepdims=True)
    return np.log(row_sums(np.exp(x - top))) + top[:, 0]


def word_classes(counts: np.ndarray) -> np.ndarray:
    """About two thirds of sqrt(n) classes of equal mass in the square roots of the counts, frequent words first: then a word's class and the word in it take about as long."""
    mass = np.sqrt(counts + 1.0)
    order = np.argsort(-counts, kind="stable")
    n = max(1, int(0.65 * np.sqrt(len(counts))))
    before = np.cumsum(mass[order]) - mass[order]
    out = np.empty(len(counts), dtype=np.int64)
    out[order] = np.minimum(before / mass.sum() * n, n - 1).astype(np.int64)
    return np.unique(out, return_inverse=True)[1]


class Network:
    """Embedding, gated recurrent cell (reset, update, candidate) and factored output. The words' output rows stand class by class:
    class c has rows edge[c]:edge[c + 1], and a word stands in row `row`."""

    def __init__(self, counts: np.ndarray, width: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of = word_classes(counts)
        order = np.argsort(self.of, kind="stable")
        self.row = np.empty(len(counts), dtype=np.int64)
        self.row[order] = np.arange(len(counts))
        self.edge = np.searchsorted(self.of[order], np.arange(self.of.max() + 2))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        prior = np.log((counts + 1) / (counts.sum() + len(counts)))[order]
        mass = np.logaddexp.reduceat(prior, self.edge[:-1])
        self.p = {"emb": draw(len(counts), width) * np.float32(np.sqrt(len(counts))) * np.float32(0.1), "wx": draw(width, 3 * width), "wh": draw(width, 3 * width), "b": np.zeros(3 * width, np.float32),
                  "wc": draw(width, len(mass)) * np.float32(0.1), "bc": mass.astype(np.float32), "ww": np.ascontiguousarray(draw(width, len(counts)).T) * np.float32(0.1), "bw": prior.astype(np.float32)}
        self.width = width

    def cell(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after h and what it is made of; a is the input's part. Columns are streams."""
        w = self.width
        g = self.p["wh"].T @ h
        rz = sigmoid(a[: 2 * w] + g[: 2 * w])
        r, z, g = rz[:w], rz[w:], g[2 * w :]
        c = r * g
        c += a[2 * w :]
        np.tanh(c, out=c)
        h = h - c
        h *= z
        h += c
        return h, r, z, c, g

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice, slice]]]:
        """The order of targets by class, and for each class of several words that occurs its number, its part of that order and its rows."""
        cls = self.of[target].astype(np.uint16)  # of 16 bits, so they are sorted by counting
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(len(self.edge))).tolist()
        edge = self.edge.tolist()
        return order, [(c, slice(ends[c], ends[c + 1]), slice(edge[c], edge[c + 1])) for c in range(len(edge) - 1) if ends[c + 1] > ends[c] and edge[c + 1] > edge[c] + 1]

    def log_likelihood(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after its state; some at a time, as what fits in a cache is faster."""
        if not len(target):
            return np.zeros(0)
        if len(target) > AT_ONCE:
            return np.concatenate([self.log_likelihood(states[lo : lo + AT_ONCE], target[lo : lo + AT_ONCE]) for lo in range(0, len(target), AT_ONCE)])
        order, classes = self.by_class(target)
        states, target = states[order], target[order]
        logits = states @ self.p["wc"] + self.p["bc"]
        got = logits[np.arange(len(target)), self.of[target]] - log_sum_exp(logits)
        place = self.row[target]
        for _, at, rows in classes:
            inner = states[at] @ self.p["ww"][rows].T + self.p["bw"][rows]
            got[at] += inner[np.arange(len(inner)), place[at] - rows.start] - log_sum_exp(inner)
        out = np.empty(len(target), dtype=got.dtype)
        out[order] = got
        return out

    def output_grads(self, states: np.ndarray, target: np.ndarray, weight: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        def soft(states: np.ndarray, w: np.ndarray, b: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> np.ndarray:
            x = states @ w
            x += b
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
            total = row_sums(x)
            if not within(total):
                x = states @ w + b
                x -= x.max(axis=1, keepdims=True)
                np.exp(np.maximum(x, -80, out=x), out=x)
                total = row_sums(x)
            x *= (weight / total)[:, None]
            x[np.arange(len(x)), hit] -= weight
            return x

        order, classes = self.by_class(target)
        target, weight = target[order], weight[order]
        one = np.ones((len(states), self.width + 1), dtype=states.dtype)  # a last column of ones, so one product gives the biases' gradients too
        one[:, :-1] = states[order]
        states = one[:, :-1]
        d = soft(states, self.p["wc"], self.p["bc"], self.of[target], weight)
        both = one.T @ d
        grads["wc"] += both[:-1]
        grads["bc"] += both[-1]
        back = d @ self.p["wc"].T
        place = self.row[target]
        for _, at, rows in classes:
            w = self.p["ww"][rows]
            d = soft(states[at], w.T, self.p["bw"][rows], place[at] - rows.start, weight[at])
            both = d.T @ one[at]
            grads["ww"][rows] += both[:, :-1]
            grads["bw"][rows] += both[:, -1]
            back[at] += d @ w
        out = np.empty_like(back)
        out[order] = back
        return out

    def window(self, inputs: np.ndarray, target: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of one window (arrays of steps by streams) that starts from state h, and the state after it."""
        w, p, n, m = self.width, self.p, len(inputs), inputs.shape[1]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        x = np.ascontiguousarray(p["emb"][inputs].transpose(0, 2, 1))  # step by step, so what a step works on stands together and stays in the cache
        a = p["wx"].T @ x
        a += p["b"][:, None]
        h = np.ascontiguousarray(h.T)
        before, states, steps = np.empty_like(x), np.empty_like(x), []
        stays, some = (~fresh).astype(h.dtype), fresh.any(axis=1)
        for t in range(n):
            before[t] = h = h * stays[t] if some[t] else h
            h, *rest = self.cell(a[t], h)
            steps.append(rest)
            states[t] = h
        weight = (live.ravel() / max(1, int(live.sum()))).astype(h.dtype)
        back = self.output_grads(states.transpose(0, 2, 1).reshape(-1, w), target.ravel(), weight, grads)
        back = np.ascontiguousarray(back.reshape(n, m, w).transpose(0, 2, 1))
        da, dg, dh, spare = np.empty_like(a), np.empty_like(a), np.zeros_like(h), np.empty_like(h)
        for t in range(n - 1, -1, -1):
            r, z, c, g = steps[t]
            dh += back[t]
            dr, dz, dc = da[t, :w], da[t, w : 2 * w], da[t, 2 * w :]
            np.subtract(1, z, out=dc)
            dc *= dh
            np.subtract(before[t], c, out=dz)
            dz *= dc
            dz *= z
            c *= c
            np.subtract(1, c, out=c)
            dc *= c
            np.multiply(r, r, out=spare)
            np.subtract(r, spare, out=dr)
            dr *= g
            dr *= dc
            dg[t, : 2 * w] = da[t, : 2 * w]
            np.multiply(dc, r, out=dg[t, 2 * w :])
            dh *= z
            dh += np.matmul(p["wh"], dg[t], out=spare)
            if some[t]:
                dh *= stays[t]
        grads["wh"] += (before @ dg.transpose(0, 2, 1)).sum(axis=0)
        grads["wx"] += (x @ da.transpose(0, 2, 1)).sum(axis=0)
        grads["b"] += da.sum(axis=0).sum(axis=1)
        word = inputs.ravel()
        for k, row in enumerate((p["wx"] @ da).transpose(1, 0, 2).reshape(w, -1)):
            grads["emb"][:, k] = np.bincount(word, row, len(grads["emb"]))
        return grads, np.ascontiguousarray(h.T)

    @one_thread()
    @memory_at_hand()
    def train(self, texts: list[np.ndarray], steps: int, streams: int, epochs: int, rate: float, seed: int) -> None:
        """Truncated backpropagation over texts (word numbers that end with END), dealt to streams; Adam steps. Texts above a stream's fair share are cut."""
        most = max(64 * steps, -(-sum(map(len, texts)) // streams))
        texts = [x[lo : lo + most] for x in texts for lo in range(0, len(x), most)]
        rng = np.random.default_rng(seed)
        first, second, turn = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        for epoch in range(epochs):
            lanes: list[list[np.ndarray]] = [[] for _ in range(streams)]
            size = np.zeros(streams, dtype=np.int64)
            for k in rng.permutation(len(texts)):
                lane = int(size.argmin())
                lanes[lane].append(texts[k])
                size[lane] += len(texts[k])
            n = int(size.max()) if len(texts) else 0
            target = np.full((n, streams), END, dtype=np.int64)
            live, fresh = np.zeros((n, streams), dtype=bool), np.zeros((n, streams), dtype=bool)
            for lane, parts in enumerate(lanes):
                if parts:
                    row = np.concatenate(parts)
                    target[: len(row), lane], live[: len(row), lane] = row, True
                    fresh[np.cumsum([0, *map(len, parts[:-1])]), lane] = True
            inputs = np.full_like(target, END)
            inputs[1:] = target[:-1]
            h = np.zeros((streams, self.width), dtype=np.float32)
            for lo in range(0, n, steps):
                part = slice(lo, lo + steps)
                if not live[part].any():
                    break
                grads, h = self.window(inputs[part], target[part], fresh[part], live[part], h)
                turn += 1
                norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                scale = min(1.0, 1.0 / (norm + 1e-9))
                step = rate * (1 - 0.9 * epoch / max(1, epochs)) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for k, g in grads.items():
                    g *= np.float32(scale)
                    square = g * g
                    for mean, x, share in ((first[k], g, 0.1), (second[k], square, 0.001)):
                        x -= mean
                        x *= np.float32(share)
                        mean += x
                    down = np.sqrt(second[k], out=square)
                    down += np.float32(1e-8)
                    np.divide(first[k], down, out=down)
                    down *= np.float32(step)
                    self.p[k] -= down

    @one_thread()
    @memory_at_hand()
    def score(self, ids: np.ndarray, bounds: np.ndarray, steps: int = 16) -> np.ndarray:
        """Natural log-likelihood of each text ids[bounds[i]:bounds[i+1]], state carried from window to window."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        if len(order) > TEXTS:
            out = np.empty(len(order))
            for lo in range(0, len(order), TEXTS):
                own = order[lo : lo + TEXTS]
                ends = np.append(0, np.cumsum(size[own]))
                out[own] = self.side_by_side(ids[np.repeat(bounds[own] - ends[:-1], size[own]) + np.arange(ends[-1])], ends, steps)
            return out
        return self.side_by_side(ids, bounds, steps)

    def side_by_side(self, ids: np.ndarray, bounds: np.ndarray, steps: int) -> np.ndarray:
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, size = bounds[:-1][order], size[order]
        table = self.p["emb"] @ self.p["wx"] + self.p["b"]
        total, h = np.zeros(len(size)), np.zeros((self.width, len(size)), dtype=np.float32)
        last = np.full(len(size), END, dtype=np.int64)
        for lo in range(0, int(size[0]) if len(size) else 0, steps):
            live = int(np.searchsorted(-size, -lo, side="left"))
            span = min(steps, int(size[0]) - lo)
            there = lo + np.arange(span)[:, None] < size[None, :live]
            target = ids[np.where(there, begin[None, :live] + lo + np.arange(span)[:, None], 0)]
            h, last = h[:, :live], last[:live]
            states = np.empty((span, live, self.width), dtype=np.float32)
            for t in range(span):
                h = self.cell(np.ascontiguousarray(table[last].T), h)[0]
                states[t], last = h.T, target[t]
            got = self.log_likelihood(states[there], target[there])
            total[:live] += np.bincount(np.nonzero(there)[1], got.astype(np.float64), live)
        out = np.empty(len(size))
        out[order] = total
        return out


@dataclass
class Model:
    """words: the frequent words' hashes by falling count, with their counts; symbol: a frequent word's symbol; mass: log10 of all
    counts plus one of a symbol's words, or of what `symbol` lacks; of a symbol with one word it is nothing."""

    words: Lookup
    counts: np.ndarray
    symbol: np.ndarray
    mass: np.ndarray
    network: Network
    n: int
    v: int
    ends: int


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): every word of docs (text) with its count. Tasks count before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for _, _, w in chunks(batch.column(0)):
                held.append(np.unique(w.hashes(), return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held, size = [merged(held)], 0
            if held:
                h, c = merged(held)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The first n rows of counts (h, c) by falling c, then h. Few more than n are sorted: histograms of c, and of h where c is that of the last row, exclude the rest."""
    bin_ = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64)).cast("long")
    above, last = 0, -1
    for r in sorted(counts.groupBy(bin_.alias("bin")).count().collect(), reverse=True):
        last = r["bin"]
        if above + r["count"] >= n:
            break
        above += r["count"]
    rows = counts.where(bin_ > last)
    ties, part = counts.where(bin_ == last), F.shiftright("h", 52)
    if last < 4096:
        upto = 0
        for r in sorted(ties.groupBy(part.alias("part")).count().collect()):
            upto += r["count"]
            if above + upto >= n:
                ties = ties.where(part <= r["part"])
                break
    return rows.unionByName(ties).orderBy(F.desc("c"), "h").limit(n)


def learn(docs: DataFrame, train: Column, vocabulary: int = 2048, groups: int = 256, frequent: int = 1 << 18, sample: int = 512, width: int = 16, steps: int = 16, streams: int = 64, epochs: int = 2, rate: float = 8e-3, seed: int = 11, part: int = 1 << 19, rounds: int = 4, wide: int = 256) -> tuple[Model, DataFrame]:
    """docs (id, text). The model and the table of all counts. What comes to the driver: `frequent` counts and sums of contexts, the counts
    of pairs of CONTEXTS words, `sample` texts and, each round, one set of weights."""
    own = docs.where(train)
    counts = kept(count_words(own), "word_counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    ends = own.select("id").count()
    top = most_frequent(counts, frequent).toArrow()
    words, c = Lookup(top.column("h").to_numpy().view(np.uint64)), top.column("c").to_numpy().astype(np.int64)
    rows = kept(numbers(own, words), "lm_numbers")
    single = max(0, vocabulary - 2)
    group = word_groups(rows, c, single, groups) if len(c) > single else np.zeros(0, np.int64)
    symbol = np.append(np.arange(2, 2 + min(single, len(c))), 2 + single + group)
    total = np.bincount(symbol, c, max(2, int(symbol.max(initial=0)) + 1))
    total[[END, OTHER]] = ends, n - c.sum()
    mass = np.log10(np.bincount(symbol, c + 1.0, len(total)) + (np.arange(len(total)) == OTHER) * (n - c.sum() + v - len(c) + 1.0) + (np.arange(len(total)) == END))
    mass[2 : 2 + single] = np.log10(c[:single] + 1.0)
    model = Model(words, c, symbol, mass, Network(total.astype(np.float64), width, seed), n + ends, v + (ends > 0), ends)
    rows = symbols(rows, model)
    some = own.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = rows.join(F.broadcast(some), "id", "left_semi").orderBy("id", F.xxhash64("numbers")).select("numbers").toArrow().column("numbers")
    kind = np.min_scalar_type(len(total))
    model.network.train([np.frombuffer(x, dtype=kind).astype(np.int64) for x in texts.to_pylist()], steps, streams, epochs, rate, seed)
    shards = max(1, -(-model.n // (part * rounds)))
    key = F.when(F.col("id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("id", "numbers"))
    rows = kept(rows.withColumn("part", F.pmod(key, F.lit(shards * rounds))), "lm_symbols")
    for k in range(rounds):
        model.network.p = averaged(rows.where(F.col("part") % rounds == k), model.network, steps, wide, rate * (1 - 0.9 * k / rounds), seed)
    return model, counts


#: Words whose company tells other words' groups, how far it reaches, how many axes it is seen along, and units of an axis.
CONTEXTS, REACH, AXES, UNITS = 512, 4, 12, 64


def numbers(docs: DataFrame, words: Lookup) -> DataFrame:
    """docs (id, text) as id and numbers (int32): each word's place among `words`, -1 beyond them, and -2 for the end."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most `frequent`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in chunks(batch.column(1)):
                ids = np.insert(shared.value.find(w.hashes()), w.bounds[1:], -2)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], binaries(ids.astype(np.int32), w.bounds + np.arange(hi - lo + 1))], names=["id", "numbers"])

    return docs.select("id", "text").mapInArrow(run, "id long, numbers binary")


def symbols(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of `numbers` with symbols in their place."""
    kind = np.min_scalar_type(len(model.network.of))
    table = rows.sparkSession.sparkContext.broadcast(np.append(model.symbol, [END, OTHER]).astype(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(table.value[ids], bounds)], names=["id", "numbers"])

    return rows.mapInArrow(run, "id long, numbers binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 numbers of a binary column in one array, and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.int32) if offsets[-1] > offsets[0] else np.zeros(0, np.int32), (offsets - offsets[0]) // 4


def pieces(batches: Iterator[pa.RecordBatch], size: int = 1 << 17) -> Iterator[tuple[np.ndarray, slice]]:
    """The numbers of all batches in pieces with REACH more on both sides, and where the piece itself lies in it."""
    for batch in batches:
        ids, _ = flat(batch.column(1))
        for lo in range(0, len(ids), size):
            begin = max(0, lo - REACH)
            yield ids[begin : lo + size + REACH], slice(lo - begin, min(len(ids), lo + size) - begin)


def word_groups(rows: DataFrame, counts: np.ndarray, single: int, groups: int) -> np.ndarray:
    """A group for every word from `single` on. Pairs of the CONTEXTS most frequent words, near each other in a text, give these words
    coordinates (correspondence analysis); a word stands at the mean of those near it; a tree that halves the counts along the widest
    axis makes the groups. Coordinates are integers, so sums don't depend on any order."""
    k = min(CONTEXTS, len(counts))
    shared = rows.sparkSession.sparkContext.broadcast(coordinates(rows, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((k + 1, AXES + 1))
        table[:k] = shared.value
        total = np.zeros((len(counts), AXES + 1))
        for ids, own in pieces(batches):
            value = table[np.where((ids >= 0) & (ids < k), ids, k)]
            upto = np.zeros((len(ids) + 1, AXES + 1))
            np.cumsum(value, axis=0, out=upto[1:])
            at = own.start + np.flatnonzero(ids[own] >= single)
            ends = np.flatnonzero(ids == -2)
            text = np.searchsorted(ends, at)
            lo = np.maximum(at - REACH, np.append(0, ends + 1)[text])
            hi = np.minimum(at + REACH + 1, np.append(ends, len(ids))[text])
            near = upto[hi] - upto[lo] - value[at]
            word, where = np.unique(ids[at], return_inverse=True)
            for axis in range(AXES + 1):
                total[word, axis] += np.bincount(where, near[:, axis], len(word))
        seen = np.flatnonzero(total[:, AXES])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(x) for x in total[seen].astype(np.int64).T)], names=["word", *names])

    names = [f"s{i}" for i in range(AXES + 1)]
    sums = rows.mapInArrow(run, ", ".join(f"{x} long" for x in ["word", *names])).groupBy("word").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    place = np.zeros((len(counts), AXES))
    near = np.stack([sums.column(x).to_numpy() for x in names], axis=1).astype(np.float64)
    place[sums.column("word").to_numpy()] = near[:, :AXES] / (near[:, AXES:] + 2.0)  # words with few neighbours stay near the middle
    return halved(place[single:], counts[single:].astype(np.float64), groups)


def coordinates(rows: DataFrame, k: int) -> np.ndarray:
    """For each of the k most frequent words AXES coordinates and a one. At most k * k counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for ids, own in pieces(batches):
            text = np.cumsum(ids == -2)
            at = own.start + np.flatnonzero((ids[own] >= 0) & (ids[own] < k))
            for d in range(1, REACH + 1):
                one = at[at < len(ids) - d]
                one = one[text[one] == text[one + d]]
                other = ids[one + d]
                few = (other >= 0) & (other < k)
                total += np.bincount(ids[one[few]].astype(np.int64) * k + other[few], minlength=k * k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    pairs = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[pairs.column("cell").to_numpy()] = pairs.column("n").to_numpy()
    table = table.reshape(k, k)
    table += table.T
    mass = table.sum(axis=1) + 1.0
    share = np.sqrt(mass / mass.sum())
    values, axes = np.linalg.eigh(table / mass.sum() / np.outer(share, share) - np.outer(share, share))
    order = np.argsort(-np.abs(values), kind="stable")[:AXES]
    out = np.zeros((k, AXES + 1))
    out[:, : len(order)] = np.clip(np.rint(axes[:, order] / share[:, None] * np.abs(values[order]) * UNITS), -64 * UNITS, 64 * UNITS)
    out[:, AXES] = 1
    return out


def halved(place: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each place: the heaviest group is cut, at its middle weight along its widest axis, until there are `groups` or none can be cut."""
    group, held, done = np.zeros(len(place), np.int64), [np.arange(len(place))], []
    while held and len(held) + len(done) < groups:
        at = held.pop(int(np.argmax([weight[x].sum() for x in held])))
        mean = np.average(place[at], axis=0, weights=weight[at])
        away = place[at] - mean
        along = away @ np.linalg.eigh((away * weight[at, None]).T @ away)[1][:, -1]
        order = np.argsort(along, kind="stable")
        run = np.cumsum(weight[at][order])
        cut = int(np.searchsorted(run, run[-1] / 2)) + 1
        if cut >= len(at) or along[order[0]] == along[order[-1]]:
            done.append(at)
        else:
            held += [at[order[:cut]], at[order[cut:]]]
    for k, at in enumerate(held + done):
        group[at] = k
    return group


def averaged(rows: DataFrame, network: Network, steps: int, streams: int, rate: float, seed: int, piece: int = 4096) -> dict[str, np.ndarray]:
    """Weights after every part of rows (id, numbers, part) trained from the network's, averaged by words. Averages are taken in tasks, by pieces of the weights."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(network), np.min_scalar_type(len(network.of))
    sizes = {k: v.size for k, v in network.p.items()}
    starts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))

    def trained(key: tuple, table: pa.Table) -> pa.Table:
        start = shared.value
        own = Network.__new__(Network)
        own.__dict__.update(start.__dict__, p={k: v.copy() for k, v in start.p.items()})
        held = sorted(zip(table.column("id").to_pylist(), table.column("numbers").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        texts = [np.frombuffer(x, dtype=kind).astype(np.int64) for _, x in held]
        own.train(texts, steps, streams, 1, rate, seed + key[0].as_py())
        flat = np.concatenate([own.p[k].ravel() for k in sizes]).astype(np.float32)
        cuts = range(0, len(flat), piece)
        return pa.table({"piece": pa.array([lo // piece for lo in cuts], pa.int64()), "n": pa.array([sum(map(len, texts))] * len(cuts), pa.int64()), "part": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "value": pa.array([flat[lo : lo + piece].tobytes() for lo in cuts], pa.binary())})

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        total, weight = 0.0, 0
        for _, n, value in sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "value")), strict=True)):
            total = total + n * np.frombuffer(value, dtype=np.float32).astype(np.float64)
            weight += n
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    parts = rows.select("part", "id", "numbers").groupBy("part").applyInArrow(trained, "piece long, n long, part long, value binary")
    got = sorted(parts.groupBy("piece").applyInArrow(mean, "piece long, value binary").collect())
    if not got:
        return network.p
    flat = np.frombuffer(b"".join(bytes(r.value) for r in got), dtype=np.float32)
    return {k: flat[starts[k] : starts[k] + sizes[k]].reshape(v.shape).copy() for k, v in network.p.items()}


def parts(docs: DataFrame, model: Model) -> DataFrame:
    """docs (id, held, text), by row: tokens; of frequent words and the end their number and sum of log10(c + 1); the network's log10; and words beyond."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # `frequent` words and the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs, table = np.append(np.log10(m.counts + 1.0), 0.0), np.append(m.symbol, OTHER)  # -1, beyond the frequent words, takes the last
        end = np.log10(m.ends + 1.0)
        for batch in batches:
            size, known, base, other, rare, rare_n, ids = [], [], [], [], [], [], []
            for lo, hi, w in chunks(batch.column(2)):
                h = w.hashes()
                found = m.words.find(h)
                hit = found >= 0
                value = logs[found]
                number = table[found]
                size.append(w.counts() + 1)
                known.append(segment_sum(hit.astype(np.int64), w.bounds) + (m.ends > 0))
                base.append(segment_sum(value, w.bounds) + end)
                other.append(segment_sum(value - m.mass[number], w.bounds))
                rare.append(h[~hit])
                rare_n.append(segment_sum((~hit).astype(np.int64), w.bounds))
                ids.append(np.insert(number, w.bounds[1:], END))
            if not size:
                continue
            size = np.concatenate(size)
            bounds = np.append(0, np.cumsum(size))
            natural = m.network.score(np.concatenate(ids), bounds)
            offsets = np.append(0, np.cumsum(np.concatenate(rare_n))).astype(np.int32)
            beyond = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rare).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(np.concatenate(known)), pa.array(np.concatenate(base)), pa.array(natural / np.log(10) + np.concatenate(other)), beyond], names=["id", "held", "n_tokens", "known", "logs", "score", "beyond"])

    return docs.select("id", "held", "text").mapInArrow(run, "id long, held boolean, n_tokens long, known long, logs double, score double, beyond array<long>")


def scored(docs: DataFrame, train: Column, **options) -> DataFrame:
    """docs (id, held, text): id, held, n_tokens, n_known, train_tokens, base_score, score. Learns from rows where `train` holds."""
    model, counts = learn(docs, train, **options)
    own = kept(parts(docs, model).withColumn("row", F.monotonically_increasing_id()), "lm_rows")
    rare = own.select("row", F.explode("beyond").alias("h")).join(counts, "h")  # each of these words is rare: no key is hot
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    out = own.select("row", "id", "held", "n_tokens", "known", "logs", "score").join(rare, "row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    lowest = float(np.log10(model.n + model.v + 1))
    return out.select("id", "held", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("logs") + more - F.col("n_tokens") * lowest).alias("base_score"), (F.col("score") + more).alias("score"))
