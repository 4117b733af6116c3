"""Line dedup with a sharded minimal perfect hash.

Distinct line keys that occur in enough documents are counted by Spark and
dealt into shards by hash. For each shard a minimal perfect hash gives every
key a slot in three compact arrays: fingerprint, document count and winning
document. Documents look their lines up in those arrays: no line is joined.

Where the whole index is at most ``broadcast_limit`` bytes it goes to every
task and texts never move. A larger one stays where its shards are: packed
line hashes travel to them, one entry for each distinct line of a batch of
documents, and only the lines to drop travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import durable, raw, ship, slices

BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of a code point after its first.
_CONTINUATION = bytes(range(0x80, 0xC0))
_M = np.uint64(0xFF51AFD7ED558CCD)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and len(key.translate(None, _CONTINUATION)) >= least


def line_hash(key: bytes) -> tuple[int, int]:
    """128 bits of a line key, as two unsigned longs."""
    both = xxhash.xxh3_128_intdigest(key)
    return both >> 64, both & 0xFFFFFFFFFFFFFFFF


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h1 + np.uint64(level) * h2 ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * _M
        return (x ^ (x >> np.uint64(33))) * _M >> np.uint64(11)


class MinimalPerfectHash:
    """Slots 0 to n-1 for n distinct keys of two uint64, in about three bits a
    key: at each level keys that meet no other in a bitmap twice their number
    are settled, the others go on to the next."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> None:
        self.sizes, bits = [], []
        while len(h1):
            size = max(64, int(gamma * len(h1)) + 1)
            at = (_mix(h1, h2, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            met = ~alone[at]
            h1, h2 = h1[met], h2[met]
            if len(self.sizes) > 200:
                raise ValueError("keys are not distinct")
        self._index(np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8))

    def _index(self, packed: np.ndarray) -> None:
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A slot for each key; any slot, or -1, for a key not of the set."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[word[hit]] + below
            left, base = left[~hit], base + size
        return out

    def pack(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], np.int64).tobytes() + self.words.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> MinimalPerfectHash:
        out = cls.__new__(cls)
        levels = int(np.frombuffer(data, np.int64, 1)[0])
        out.sizes = np.frombuffer(data, np.int64, levels, 8).tolist()
        out._index(np.frombuffer(data, np.uint8, -1, 8 * (levels + 1)))
        return out


class ShardIndex:
    """One shard: minimal perfect hash and its arrays."""

    def __init__(self, hasher: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray, winners: np.ndarray) -> None:
        self.hasher, self.prints, self.counts, self.winners = hasher, prints, counts, winners

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, winners: np.ndarray) -> ShardIndex:
        hasher = MinimalPerfectHash(h1, h2)
        at = hasher.slots(h1, h2)
        out = cls(hasher, np.empty(len(h1), np.uint64), np.empty(len(h1), np.int64), np.empty(len(h1), np.int64))
        out.prints[at], out.counts[at], out.winners[at] = h2, counts, winners
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count, 0 for an unknown line, and winner of each line."""
        if not len(self.prints) or not len(h1):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.hasher.slots(h1, h2)
        known = (at >= 0) & (self.prints[at] == h2)
        return np.where(known, self.counts[at], 0), np.where(known, self.winners[at], 0)


def line_counts(docs: DataFrame, least_chars: int, least_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, n, winner) of the line keys of at least ``least_chars`` code
    points in at least ``least_docs`` rows; winner: the largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            seen: dict[bytes, list[int]] = {}
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for key in {line_key(x) for x in text.split(b"\n")} if text else ():
                    if _long_enough(key, least_chars):
                        had = seen.get(key)
                        if had is None:
                            seen[key] = [1, doc]
                        else:
                            had[0] += 1
                            if doc > had[1]:
                                had[1] = doc
            both = np.array([line_hash(k) for k in seen], np.uint64).reshape(-1, 2).view(np.int64)
            values = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0], both[:, 1], values[:, 0], values[:, 1])], names=["h1", "h2", "n", "winner"])

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), raw(text_col).alias("text"))
    found = source.mapInArrow(run, "h1 bigint, h2 bigint, n bigint, winner bigint")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("winner").alias("winner")).where(F.col("n") >= least_docs)


def build_index(counts: DataFrame, keys_per_shard: int = 1 << 20) -> tuple[DataFrame, int]:
    """The index as rows (shard, keys, hasher, prints, counts, winners), and
    the number of shards."""
    counts = durable(counts)
    shards = max(1, -(-counts.count() // keys_per_shard))

    def build(rows: pa.Table) -> pa.Table:
        h1, h2, n, winner = (rows.column(c).to_numpy() for c in ("h1", "h2", "n", "winner"))
        index = ShardIndex.build(h1.view(np.uint64), h2.view(np.uint64), n, winner)
        packed = {"hasher": index.hasher.pack(), "prints": index.prints.tobytes(), "counts": index.counts.tobytes(), "winners": index.winners.tobytes()}
        return pa.table({"shard": rows.column("shard").slice(0, 1), "keys": pa.array([len(n)], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in packed.items()}})

    dealt = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 7), F.lit(shards)).cast("long"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard long, keys long, hasher binary, prints binary, counts binary, winners binary")
    return durable(built), shards


def _load(row: dict) -> ShardIndex:
    return ShardIndex(MinimalPerfectHash.unpack(row["hasher"]), np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["winners"], np.int64))


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 >> np.uint64(7)).astype(np.int64) % shards


def _lines(text: bytes | None, least_chars: int) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Lines, the places of those that may be dropped, and their hashes."""
    lines = (text or b"").split(b"\n")
    keys = [line_key(x) for x in lines]
    places = [i for i, k in enumerate(keys) if _long_enough(k, least_chars)]
    return lines, places, [line_hash(keys[i]) for i in places]


def _drops(doc: int, places: np.ndarray, winners: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return places[(counts > 0) & (winners != doc)]


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, keys_per_shard: int = 1 << 20, broadcast_limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the kept text in place of the text, then
    n_lines and n_dropped (long); columns of ``docs`` with those names go.

    A line's key is the line without white space at its ends and in lower
    case (A-Z). Keys of at least ``least_chars`` code points in at least
    ``least_docs`` documents lose all their lines except those in the largest
    doc_id that has them. A null or empty text is one empty line and stays as
    it is. Rows that repeat a doc_id count as documents of their own, and all
    rows with the winning doc_id keep the line; a null doc_id is smallest."""
    ship(docs.sparkSession)
    counts = line_counts(docs, least_chars, least_docs, id_col, text_col)
    index, shards = build_index(counts, keys_per_shard)
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("hasher", "prints", "counts", "winners")))).first()[0] or 0
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    if size <= broadcast_limit:
        return _probe_here(docs.select(*names), index, shards, least_chars, id_col, text_col)
    return _probe_there(docs.select(*names), index, shards, least_chars, id_col, text_col)


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents with the text that ``dedup_lines`` leaves, all columns,
    also those named as what it counts."""
    held = {c: f"__held_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(held), **how).drop("n_lines", "n_dropped")
    return out.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def _rebuilt(batch: pa.RecordBatch, names: list[str], texts: list, n_lines: list[int], n_dropped: list[int]) -> pa.RecordBatch:
    columns = [pa.array(texts, pa.binary()) if c == "__text" else batch.column(c) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """Columns with places for names, so that none can clash: the text as
    bytes and the doc_id as a long beside them."""
    columns = [raw(c).alias("__text") if c == text_col else F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*columns, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id")), ["__text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]


def _schema(source: DataFrame, names: list[str], rest: str) -> str:
    return ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names) + rest


def _named(df: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(a).cast("string").alias(b) if a == "__text" else F.col(a).alias(b) for a, b in zip(names, docs.columns)], "n_lines", "n_dropped")


def _probe_here(docs: DataFrame, index: DataFrame, shards: int, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])
    source, names = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {r["shard"]: _load(r) for r in held.value}
        for batch in slices(batches, "__text", 8 << 20):
            texts = batch.column("__text").to_pylist()
            split = [_lines(t, least_chars) for t in texts]
            sizes = np.array([len(x[1]) for x in split])
            hashes = np.array([h for x in split for h in x[2]], np.uint64).reshape(-1, 2)
            counts, winners = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
            shard = _shard_of(hashes[:, 0], shards)
            for s, part in parts.items():
                mine = shard == s
                counts[mine], winners[mine] = part.probe(hashes[mine, 0], hashes[mine, 1])
            lost = (counts > 0) & (winners != np.repeat(np.array(batch.column("__id").to_pylist(), np.int64), sizes))
            at, kept, n_lines, n_dropped = 0, [], [], []
            for text, (lines, places, _), n in zip(texts, split, sizes.tolist()):
                gone = {p for p, x in zip(places, lost[at : at + n].tolist()) if x}
                at += n
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            yield _rebuilt(batch, names, kept, n_lines, n_dropped)

    return _named(source.mapInArrow(run, _schema(source, names, ", n_lines bigint, n_dropped bigint")), names, docs)


def _probe_there(docs: DataFrame, index: DataFrame, shards: int, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    source, names = _source(docs, id_col, text_col)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and shard: the distinct lines, and who has them."""
        for batch in slices(batches, "text", 8 << 20):
            who: dict[tuple[int, int], set[int]] = {}
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for h in _lines(text, least_chars)[2] if text else ():
                    who.setdefault(h, set()).add(doc)
            hashes = np.array(list(who), np.uint64).reshape(-1, 2)
            shard, docs_of = _shard_of(hashes[:, 0], shards), list(who.values())
            rows = []
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                sizes = np.array([len(docs_of[i]) for i in mine.tolist()], np.int64)
                rows.append((s, hashes[mine].tobytes(), sizes.tobytes(), np.array([d for i in mine.tolist() for d in docs_of[i]], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "a", "b", "c"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's index comes first, then all that is asked of it."""
        part, shard = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    shard = row["shard"]
                    part = _load({"hasher": row["a"], "prints": row["b"], "counts": row["c"], "winners": row["d"]})
                elif row["shard"] == shard:
                    hashes, sizes, who = np.frombuffer(row["a"], np.uint64).reshape(-1, 2), np.frombuffer(row["b"], np.int64), np.frombuffer(row["c"], np.int64)
                    counts, winners = part.probe(hashes[:, 0], hashes[:, 1])
                    line = np.repeat(np.arange(len(sizes)), sizes)
                    lost = (counts[line] > 0) & (winners[line] != who)
                    out.append((who[lost], hashes[line[lost]]))
            if out:
                who, hashes = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["id", "h1", "h2"])

    asked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), raw(text_col).alias("text")).mapInArrow(ask, "shard bigint, a binary, b binary, c binary")
    rows = index.select("shard", F.lit(0).alias("kind"), F.col("hasher").alias("a"), F.col("prints").alias("b"), F.col("counts").alias("c"), F.col("winners").alias("d"))
    rows = rows.unionByName(asked.select("shard", F.lit(1).alias("kind"), "a", "b", "c", F.lit(None).cast("binary").alias("d")))
    lost = rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "id bigint, h1 bigint, h2 bigint")
    gone = lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone")).withColumnRenamed("id", "__id")
    both = source.join(gone, "__id", "left").select(*names, "__gone.h1", "__gone.h2")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 8 << 20):
            kept, n_lines, n_dropped = [], [], []
            for text, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("__text", "h1", "h2"))):
                lines, places, hashes = _lines(text, least_chars)
                gone_here = {(a & 0xFFFFFFFFFFFFFFFF, b & 0xFFFFFFFFFFFFFFFF) for a, b in zip(h1 or (), h2 or ())}
                drop = {p for p, h in zip(places, hashes) if h in gone_here}
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
            yield _rebuilt(batch, names, kept, n_lines, n_dropped)

    return _named(both.mapInArrow(rebuild, _schema(source, names, ", n_lines bigint, n_dropped bigint")), names, docs)
