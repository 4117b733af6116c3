"""Language-model scoring with a gated recurrent network, in numpy.

Spark counts all training tokens. The most frequent are dealt, by frequency,
into classes of equal numbers of words, and one more class holds all other
words, known or not. Output is factored: a softmax over classes, then one over
the words of the class, both from the recurrent state; in the last class words
have fixed probabilities from their counts, so that the model gives every
text, of any vocabulary, a proper probability.

Training is by truncated backpropagation over every training token. In each
round every partition continues from the same parameters over its own texts,
and the results are averaged, weighted by tokens, in a tree of bounded fan-in.

Scoring carries the state across windows from the first token of a document
to its end. Frequent counts, of a bounded number, are broadcast; counts of all
other words are met by a shuffled join on (word, document) rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import durable, raw, ship, slices

HIDDEN, CLASSES, PER_CLASS, BUCKETS = 16, 48, 48, 1024
HEAD = CLASSES * PER_CLASS
#: How many of the most frequent tokens are broadcast with their counts.
KNOWN = 1 << 17
#: How many tokens' texts are scored together.
SIDE_BY_SIDE = 4_000_000
#: Stands for the end of a text; no word has a space.
END = b" "


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def token_counts(docs: DataFrame, is_held_out: Callable, id_col: str, text_col: str) -> DataFrame:
    """(h, c): each training token's hash and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 32 << 20):
            counts: Counter = Counter()
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not is_held_out(doc):
                    counts.update((text or b"").lower().split())
                    counts[END] += 1
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["h", "c"])

    return docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The tokens whose count is at least the least for which no more than
    ``most`` tokens have it, found from a histogram of counts: exact below
    4096, in narrow bins above."""
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2(F.col("c") / 4096) * 256)).cast("int")
    found, total, least = sorted(counts.groupBy(step.alias("bin")).count().collect(), reverse=True), 0, None
    for bin_, n in found:
        if total + n > most:
            break
        total, least = total + n, bin_
    return counts.where(F.lit(False) if least is None else step >= least)


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


class Words:
    """Codes of words: the rank of one of the broadcast tokens, or minus the
    hash, less one, of any other. Hashes lie in an open table of four slots
    or more each, and are looked up a batch at a time."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(hashes)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, probe = np.arange(len(hashes)), 0
        while len(left):
            slot = self._slot(hashes[left], probe)
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.keys[at], self.ranks[at] = hashes[left[mine]], left[mine]
            left, probe = np.delete(left, mine), probe + 1

    def _slot(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return (hashes >> np.int64(8)) + probe & np.int64((1 << self.bits) - 1)

    def codes(self, words: list[bytes]) -> np.ndarray:
        h = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).view(np.int64)
        out, left, probe = -h - 1, np.arange(len(h)), 0
        while len(left):
            own = h[left]
            slot = self._slot(own, probe)
            key = self.keys[slot]
            found = key == own
            out[left[found]] = self.ranks[slot[found]]
            left, probe = left[~found & (key != -1)], probe + 1
        return out


def inputs(codes: np.ndarray) -> np.ndarray:
    """Input rows: one for each frequent word, others share buckets."""
    return np.where((codes >= 0) & (codes < HEAD), codes, HEAD + np.abs(codes) % BUCKETS)


def _exp(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e to the scores, and the sum of each row. Scores begin
    at most at zero, from the bias; what states add to them is cut off far from
    where it could overflow."""
    np.minimum(scores, 60, out=scores)
    np.maximum(scores, -80, out=scores)
    e = np.exp(scores)
    return e, e @ np.ones(e.shape[1], e.dtype)


class Network:
    """Parameters, forward and backward pass. Arrays run [step, lane, unit]."""

    names = ("E", "U", "b", "Wc", "bc", "Wo", "bo")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.p = arrays

    @classmethod
    def fresh(cls, counts: np.ndarray, rest: float, seed: int = 0) -> Network:
        """``counts`` of the frequent words, at most HEAD; ``rest`` the mass of
        all others. It begins as the unigram model."""
        rng, mass = np.random.default_rng(seed), np.zeros(HEAD)
        mass[: len(counts)] = counts
        with np.errstate(divide="ignore"):
            by_class = np.maximum(np.log(np.append(mass.reshape(CLASSES, PER_CLASS).sum(1), rest)), -30)
            words = np.maximum(np.log(mass), -30)
        scale = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        b = np.zeros(3 * HIDDEN, np.float32)
        b[:HIDDEN] = -1.0  # update gates begin mostly shut: the state remembers
        zero = lambda *s: np.zeros(s, np.float32)
        return cls({"E": scale(HEAD + BUCKETS, 3 * HIDDEN), "U": scale(HIDDEN, 3 * HIDDEN), "b": b, "Wc": zero(CLASSES + 1, HIDDEN), "bc": by_class.astype(np.float32), "Wo": zero(HEAD, HIDDEN), "bo": words.astype(np.float32)})

    def pack(self) -> bytes:
        return b"".join(self.p[n].tobytes() for n in self.names)

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        shapes = {"E": (HEAD + BUCKETS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "Wc": (CLASSES + 1, HIDDEN), "bc": (CLASSES + 1,), "Wo": (HEAD, HIDDEN), "bo": (HEAD,)}
        out, at = {}, 0
        for n, shape in shapes.items():
            size = int(np.prod(shape))
            out[n] = np.frombuffer(data, np.float32, size, at).reshape(shape).copy()
            at += 4 * size
        return cls(out)

    def states(self, ids: np.ndarray, begins: np.ndarray, h: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state before each token, and the state after the last. ``ids``:
        inputs [T, lanes]; ``begins``: tokens that start a text."""
        x = self.p["E"][ids]
        x += self.p["b"]
        # an update gate and a reset gate are (1 + tanh(x / 2)) / 2
        x[..., : 2 * HIDDEN] *= 0.5
        U = self.p["U"].copy()
        U[:, : 2 * HIDDEN] *= 0.5
        keep = ~begins
        fresh = begins.any(1).tolist()
        out = np.empty((*ids.shape, HIDDEN), x.dtype)
        for t in range(len(ids)):
            if fresh[t]:
                h = h * keep[t][:, None]
            out[t] = h
            u = h @ U
            gates = x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r, own = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN :]
            n = r * own
            n += x[t, :, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((h, own, z, r, n))
            h = h + z * (n - h)
        return out, h

    def log_probs(self, h: np.ndarray, codes: np.ndarray, grads: dict | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Natural log of class and, for frequent words, word in class. With
        ``grads``, also the gradient for the states, and those of the output."""
        head = (codes >= 0) & (codes < HEAD)
        kinds = np.where(head, codes // PER_CLASS, CLASSES).astype(np.int16)
        every = np.arange(len(codes))
        scores = h @ self.p["Wc"].T
        scores += self.p["bc"] - self.p["bc"].max()
        e, total = _exp(scores)
        out = scores[every, kinds] - np.log(total)
        dh = np.zeros_like(h) if grads is not None else None
        if grads is not None:
            e /= total[:, None]
            d = e
            d[every, kinds] -= 1
            grads["Wc"], grads["bc"], dh = d.T @ h, d.sum(0), d @ self.p["Wc"]
            grads["Wo"], grads["bo"] = np.zeros_like(self.p["Wo"]), np.zeros_like(self.p["bo"])
        order = np.argsort(kinds, kind="stable")
        edges = np.searchsorted(kinds[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[edges[c] : edges[c + 1]]
            if not len(rows):
                continue
            part, mine = slice(c * PER_CLASS, (c + 1) * PER_CLASS), h[rows]
            scores = mine @ self.p["Wo"][part].T
            scores += self.p["bo"][part] - self.p["bo"][part].max()
            (e, total), at, own = _exp(scores), codes[rows] - c * PER_CLASS, every[: len(rows)]
            out[rows] += scores[own, at] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                d = e
                d[own, at] -= 1
                grads["Wo"][part], grads["bo"][part] = d.T @ mine, d.sum(0)
                dh[rows] += d @ self.p["Wo"][part]
        return out if grads is None else (out, dh)

    def gradient(self, ids: np.ndarray, codes: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Summed gradients over one window, and the state after it."""
        trace: list = []
        out, after = self.states(ids, begins, h, trace)
        grads: dict = {}
        _, dh = self.log_probs(out.reshape(-1, HIDDEN), codes.ravel(), grads)
        dh = dh.reshape(out.shape)
        dx, U, carry = np.empty((*ids.shape, 3 * HIDDEN), np.float32), self.p["U"], np.zeros_like(h)
        grads["U"] = np.zeros_like(U)
        for t in range(len(ids) - 1, -1, -1):
            h0, own, z, r, n = trace[t]
            dn = carry * z * (1 - n * n)
            dz = carry * (n - h0) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            grads["U"] += h0.T @ du
            carry = (carry * (1 - z) + du @ U.T + dh[t]) * ~begins[t][:, None]
        flat, dx = ids.ravel(), dx.reshape(-1, 3 * HIDDEN)
        order = np.argsort(flat.astype(np.int16), kind="stable")  # few enough for sixteen bits
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        grads["b"] = dx.sum(0)
        grads["E"] = (flat[order][first], np.add.reduceat(dx[order], first, axis=0))
        return grads, after


class Trainer:
    """Adagrad over windows of ``steps`` tokens of many lanes."""

    def __init__(self, net: Network, rate: float, steps: int = 16) -> None:
        self.net, self.rate, self.steps = net, rate, steps
        self.sums = {n: np.full_like(a, 1e-6) for n, a in net.p.items()}

    def learn(self, ids: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> None:
        """Segments [lane, token], each with the state carried across its
        windows."""
        h = np.zeros((len(ids), HIDDEN), np.float32)
        for a in range(0, ids.shape[1], self.steps):
            part = [np.ascontiguousarray(x[:, a : a + self.steps].T) for x in (ids, codes, begins)]
            grads, h = self.net.gradient(*part, h)
            scale = np.float32(1 / part[0].size)
            for n, g in grads.items():
                rows, g = g if n == "E" else (slice(None), g)
                g = g * scale
                self.sums[n][rows] += g * g
                self.net.p[n][rows] -= self.rate * g / np.sqrt(self.sums[n][rows])


def train(docs: DataFrame, words: Broadcast, is_held_out: Callable, net: Network, id_col: str, text_col: str, rounds: int = 3, segment: int = 128, lanes: int = 512, rate: float = 0.1) -> Network:
    """Rounds of local training and averaging. Each training text belongs to
    one round, in which the network learns from all its tokens once: texts
    follow one another in a stream that is cut into segments, as many side by
    side as ``lanes``. ``words``: a broadcast of the frequent tokens' hashes."""
    spark = docs.sparkSession

    def local(batches: Iterator[pa.RecordBatch], start: Broadcast, rate: float) -> Iterator[pa.RecordBatch]:
        table, net = Words(words.value), Network.unpack(start.value)
        trainer, seen = Trainer(net, rate), 0
        left = [np.zeros(0, np.int64), np.zeros(0, bool)]

        def learn(codes: np.ndarray, begins: np.ndarray, width: int) -> None:
            shape = (-1, width)
            trainer.learn(inputs(codes).reshape(shape), codes.reshape(shape), begins.reshape(shape))

        for batch in slices(batches, "text", 8 << 20):
            streams = [tokens(t) for d, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if not is_held_out(d)]
            if not streams:
                continue
            codes = table.codes(list(chain.from_iterable(streams)))
            begins = np.zeros(len(codes), bool)
            begins[np.cumsum([0, *map(len, streams[:-1])])] = True
            seen += len(codes)
            codes, begins = np.concatenate([left[0], codes]), np.concatenate([left[1], begins])
            whole = len(codes) // (segment * lanes) * segment * lanes
            for at in range(0, whole, segment * lanes):
                learn(codes[at : at + segment * lanes], begins[at : at + segment * lanes], segment)
            left = [codes[whole:].copy(), begins[whole:].copy()]
        if n := len(left[0]):
            # what is left is cut evenly; a few tokens may be in two segments
            width = -(-n // max(1, n // segment))
            places = np.linspace(0, n - width, -(-n // width)).astype(np.int64)[:, None] + np.arange(width)
            learn(left[0][places.ravel()], left[1][places.ravel()], width)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.pack()], pa.binary())], names=["n", "net"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("net").to_pylist()):
                part = np.frombuffer(data, np.float32) * np.float64(n)
                total, weight = part if total is None else total + part, weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["n", "net"])

    schema = "n bigint, net binary"
    source = docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text"))
    for r in range(rounds):
        start, step = spark.sparkContext.broadcast(net.pack()), rate / (1 + r)
        mine = source.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
        parts = durable(mine.mapInArrow(lambda b, start=start, step=step: local(b, start, step), schema))
        left = parts.count()
        while left > 1:
            # sixteen at a time, so that no task holds many
            groups = -(-left // 16)
            parts = durable(parts.repartition(groups).mapInArrow(mean, schema))
            now = parts.count()
            if now >= left:
                parts = durable(parts.coalesce(1).mapInArrow(mean, schema))
                now = 1
            left = now
        row = parts.first()
        if row is not None:
            net = Network.unpack(bytes(row["net"]))
    return net


def score_texts(net: Network, codes: list[np.ndarray], window: int = 64) -> np.ndarray:
    """Summed natural log probability of class, and of word in class for
    frequent words, of each whole text."""
    lengths = np.array([len(c) for c in codes])
    lanes = int(np.clip(lengths.sum() // max(lengths.max(), 1), 8, 512))
    loads, queues = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        lane = int(loads.argmin())
        queues[lane].append(i)
        loads[lane] += lengths[i]
    order = np.argsort(-loads, kind="stable")
    loads, queues = loads[order], [queues[i] for i in order.tolist()]
    steps = int(loads[0])
    grid, begins, owner = np.zeros((steps, lanes), np.int64), np.zeros((steps, lanes), bool), np.full((steps, lanes), -1, np.int32)
    for lane, queue in enumerate(queues):
        at = 0
        for i in queue:
            grid[at : at + lengths[i], lane], owner[at : at + lengths[i], lane], begins[at, lane] = codes[i], i, True
            at += lengths[i]
    out, h = np.zeros(len(codes)), np.zeros((lanes, HIDDEN), np.float32)
    for a in range(0, steps, window):
        b = min(a + window, steps)
        live = int(np.searchsorted(-loads, -a))
        before, h = net.states(inputs(grid[a:b, :live]), begins[a:b, :live], h[:live])
        mine = owner[a:b, :live].ravel()
        real = mine >= 0
        found = net.log_probs(before.reshape(-1, HIDDEN)[real], grid[a:b, :live].ravel()[real])
        out += np.bincount(mine[real], found, len(codes))
    return out


@dataclass
class Model:
    """A trained network, with the hashes and counts of the frequent tokens in
    its order of them, and what all training tokens come to."""

    net: Network
    hashes: np.ndarray
    known: np.ndarray
    total: int
    distinct: int

    @property
    def rest(self) -> float:
        """The mass of all tokens outside the head, unknown ones too."""
        head = self.known[:HEAD]
        return float(self.total - head.sum() + 0.5 * (self.distinct - len(head) + 1))


def fit(docs: DataFrame, counts: DataFrame, is_held_out: Callable = held_out, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``counts``: what ``token_counts`` gives for ``docs``, durable."""
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = most_frequent(counts, KNOWN).toPandas().sort_values(["c", "h"], ascending=[False, True])
    model = Model(None, top["h"].to_numpy(np.int64), top["c"].to_numpy(np.float64), int(total), int(distinct))
    model.net = Network.fresh(model.known[:HEAD], model.rest)
    if total:
        words = docs.sparkSession.sparkContext.broadcast(model.hashes)
        model.net = train(docs, words, is_held_out, model.net, id_col, text_col, rounds)
    return model


def score(docs: DataFrame, is_held_out: Callable = held_out, rounds: int = 3, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    Tokens are the lower-cased (A-Z) words of the whole text, then one end; a
    null or empty text has the end alone. Documents for which ``is_held_out``
    of the doc_id is true teach nothing; a null doc_id counts as an empty one.
    base_score: log10 probability by token counts, half a count added to each
    of the distinct training tokens and to one for all unknown. score: the
    network's log10 probability, of ``model`` or of one fitted here. Without
    training documents both are 0. Rows that repeat a doc_id are scored each.
    An empty table gives no rows."""
    spark = ship(docs.sparkSession)
    counts = durable(token_counts(docs, is_held_out, id_col, text_col))
    fitted = model or fit(docs, counts, is_held_out, rounds, id_col, text_col)
    total, distinct, hashes, rest = fitted.total, fitted.distinct, fitted.hashes, fitted.rest
    words = spark.sparkContext.broadcast(hashes)
    model, logs = spark.sparkContext.broadcast(fitted.net.pack()), spark.sparkContext.broadcast(np.log10(fitted.known + 0.5))
    per_token, per_rest = log10(total + 0.5 * (distinct + 1)), log10(rest)
    everything = len(hashes) == distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = Words(words.value), Network.unpack(model.value)

        def scored(ids: list[pa.Array], codes: list[np.ndarray]) -> pa.RecordBatch:
            ids, scores = pa.concat_arrays(ids), score_texts(net, codes) / np.log(10) if total else np.zeros(len(codes))
            rows = []
            for doc, code, s in zip(ids.to_pylist(), codes, scores.tolist()):
                seen = code[code >= 0]
                tail, often = np.unique(-code[code < 0] - 1, return_counts=True)
                own = logs.value[seen]
                late = seen >= HEAD
                n_rest = len(code) - len(seen) + int(late.sum())
                base = own.sum() - per_token * len(code)
                rows.append((bool(is_held_out(doc)), len(code), len(seen), float(base), s + float(own[late].sum()) - per_rest * n_rest, tail, often))
            first = list(zip(*rows))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first[5]])])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int64())) for x in first[5:]]
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(first, types)), *lists], names=["id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "often"])

        # many texts are scored side by side, as codes
        ids, codes, waiting = [], [], 0
        for batch in slices(batches, "text", 4 << 20):
            streams = [tokens(t) for t in batch.column("text").to_pylist()]
            every = table.codes(list(chain.from_iterable(streams)))
            ids.append(batch.column("id"))
            codes += np.split(every, np.cumsum([len(x) for x in streams])[:-1])
            waiting += len(every)
            del streams
            if waiting >= SIDE_BY_SIDE:
                yield scored(ids, codes)
                ids, codes, waiting = [], [], 0
        if codes:
            yield scored(ids, codes)

    source = docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, tail array<bigint>, often array<bigint>"
    scored = source.mapInArrow(run, schema)
    unknown = log10(0.5)
    if everything:
        extra = F.coalesce(F.aggregate("often", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) * unknown
        out = scored.select("*", F.lit(0).cast("long").alias("more"), extra.alias("extra"))
    else:
        scored = durable(scored.withColumn("row", F.monotonically_increasing_id()))
        pairs = scored.select("row", F.explode(F.arrays_zip("tail", "often")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.often").alias("n"))
        met = pairs.join(counts, "h", "left")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("extra"))
        out = scored.join(sums, "row", "left")
    more, extra = F.coalesce("more", F.lit(0)), F.coalesce("extra", F.lit(0.0))
    both = [(F.col(c) + extra) if total else F.lit(0.0) for c in ("base", "score")]
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), both[0].alias("base_score"), both[1].alias("score")
    )
