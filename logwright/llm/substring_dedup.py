"""Repeated passages, by level-wise doubling of word windows.

Level one looks at windows of half the length. Of every run of them that makes
up one full window, the one with the smallest hash stands for it: equal full
windows have the same one. Only those are counted, across all documents, and
only full windows whose half is held by two documents go on to the next level,
where their own hashes are counted. From there on windows that are repeated
are extended: two that follow one another make a candidate of twice the length,
and the candidates held by two documents go on, until none survive.

What is repeated at the full length is removed from all documents but the one
with the smallest doc_id. Longer levels cannot change which words that covers;
they tell how long the repeated passages are.

Documents with the same word sequence take part once, through the smallest
doc_id; the others go whole. Tables that grow with the input are broadcast
only behind a check of their size; beyond it joins are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, discard, durable, raw, shared_dir, ship, slices, stored

_B = 0x9E3779B97F4A7C15
_NULL_ID = -(1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words: windows are doubled, and the
    last step overlaps two."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = hashes, 1
    with np.errstate(over="ignore"):
        while have < length:
            step = min(have, length - have)
            left, right = out[: len(out) - step], out[step:]
            x = (left * np.uint64(_B) ^ (left >> np.uint64(31))) + right * np.uint64(0xC2B2AE3D27D4EB4F)
            out, have = x ^ (x >> np.uint64(29)), have + step
    return out


def _least(halves: np.ndarray, span: int, step: int = 1 << 16) -> np.ndarray:
    """Place of the smallest of every ``span`` consecutive hashes."""
    views = np.lib.stride_tricks.sliding_window_view(halves, span)
    return np.concatenate([views[a : a + step].argmin(1) + np.arange(a, min(a + step, len(views))) for a in range(0, len(views), step)])


def _windows(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-window hashes, for each full window the place of its smallest
    half, and full-window hashes."""
    half = -(-length // 2)
    hashes = word_hashes(words)
    halves = window_hashes(hashes, half)
    with np.errstate(over="ignore"):
        first, last = halves[: len(words) - length + 1], halves[length - half :]
        full = (first ^ (first >> np.uint64(32))) * np.uint64(_B) + last * np.uint64(0xD6E8FEB86659FD93)
    return halves, _least(halves, length - half + 1), full ^ (full >> np.uint64(32))


def _keys(id_col: str, text_col: str) -> list[Column]:
    """id, t and text: t tells apart texts of rows that share a doc_id."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("t"),
        raw(text_col).alias("text"),
    ]


def _halves(keyed: DataFrame, length: int) -> DataFrame:
    """One row for each text with a full window: its sequence hash, and the
    hashes and places of the halves that stand for its full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            rows = []
            for i, t, text in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text"))):
                words = text.split() if text else []
                if len(words) < length:
                    continue
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                halves, least, _ = _windows(words, length)
                at = np.unique(least)
                rows.append((i, t, digest, halves[at].tobytes(), at.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 5, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["id", "t", "seq", "hashes", "places"]
            )

    return keyed.mapInArrow(run, "id bigint, t int, seq binary, hashes binary, places binary")


def _unpacked(packed: DataFrame) -> DataFrame:
    """(h, id, t, place), a row for each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes", 4 << 20):
            hashes = [np.frombuffer(x, np.int64) for x in batch.column("hashes").to_pylist()]
            places = [np.frombuffer(x, np.int32) for x in batch.column("places").to_pylist()]
            sizes = [len(x) for x in hashes]
            ids, ts = (np.repeat(np.asarray(batch.column(c)), sizes) for c in ("id", "t"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(hashes), ids, ts, np.concatenate(places))], names=["h", "id", "t", "place"])

    return packed.select("id", "t", "hashes", "places").mapInArrow(run, "h bigint, id bigint, t int, place int")


def _candidates(texts: DataFrame, length: int, counted: bool) -> DataFrame:
    """Full windows whose half is repeated: (g, lo, hi), the smallest and the
    largest doc_id of a batch, or with each place (g, id, t, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            found, ids, ts, starts = [], [], [], []
            for i, t, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "text", "places"))):
                _, least, full = _windows(text.split(), length)
                at = np.flatnonzero(np.isin(least, np.array(places)))
                found.append(full[at])
                ids.append(np.full(len(at), i, np.int64))
                ts.append(np.full(len(at), t, np.int32))
                starts.append(at.astype(np.int32))
            g, ids = np.concatenate(found).view(np.int64), np.concatenate(ids)
            if counted:
                order = np.argsort(g, kind="stable")
                g, ids = g[order], ids[order]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                lo, hi = (f.reduceat(ids, first) if len(g) else ids for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[first], lo, hi)], names=["g", "lo", "hi"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, ids, np.concatenate(ts), np.concatenate(starts))], names=["g", "id", "t", "start"])

    return texts.mapInArrow(run, "g bigint, lo bigint, hi bigint" if counted else "g bigint, id bigint, t int, start int")


def _repeated(windows: DataFrame, twice: DataFrame) -> DataFrame:
    """Of ``windows`` (g, id, t, start), those whose g is in ``twice`` (g, lo);
    later: if their doc_id is not the smallest that has them."""
    # dealt anew, so that the join's two sides are shuffles that can be split where a passage is frequent
    return windows.join(twice.repartition("g", "lo"), "g").select("id", "t", "start", "g", (F.col("id") > F.col("lo")).alias("later"))


def _packed(windows: DataFrame) -> DataFrame:
    """(id, t, w): the windows of each text, by start."""
    return windows.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("start", "g", "later"))).alias("w"))


def _extended(alive: DataFrame, length: int) -> DataFrame:
    """(g, id, t, start): windows of twice the length, of which both halves
    are alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("w")
            start, g = (windows.flatten().field(c).to_numpy() for c in ("start", "g"))
            sizes = np.asarray(windows.value_lengths())
            text = np.repeat(np.arange(len(sizes)), sizes)
            # places of a text are far from those of another
            place = text.astype(np.int64) << 32 | start
            later = np.searchsorted(place, place + length)
            first = np.flatnonzero(np.append(place, -1)[later] == place + length)
            with np.errstate(over="ignore"):
                left, right = g[first].view(np.uint64), g[later[first]].view(np.uint64)
                x = (left ^ (left >> np.uint64(32))) * np.uint64(_B) + right * np.uint64(0xD6E8FEB86659FD93)
            both = (x ^ (x >> np.uint64(32))).view(np.int64)
            columns = [pa.array(both), *(batch.column(c).take(pa.array(text[first])) for c in ("id", "t")), pa.array(start[first])]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "id", "t", "start"])

    return alive.select("id", "t", "w").mapInArrow(run, "g bigint, id bigint, t int, start int")


def repeated_windows(docs: DataFrame, min_words: int = 50, broadcast_limit: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, begins, ends, longest): for each text the stretches of words
    that are covered by windows which also start in a document with a smaller
    doc_id, and the longest of ``min_words`` times 1, 2, 4 ... words that such
    a window has; stretches are null for a text that is a whole copy."""
    spark = ship(docs.sparkSession)
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    keyed = docs.select(*_keys(id_col, text_col))
    packed = stored(_halves(keyed, min_words), f"{folder}/packed")
    firsts = packed.groupBy("seq").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = stored(packed.select("id", "t", "seq").join(firsts, "seq").where("id > first").select("id", "t").distinct(), f"{folder}/copies")
    own = packed.join(checked_broadcast(copies, 16, broadcast_limit), ["id", "t"], "left_anti")
    halves = _unpacked(own)
    shared = stored(halves.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h"), f"{folder}/shared")
    places = stored(halves.join(shared, "h", "left_semi").groupBy("id", "t").agg(F.collect_set("place").alias("places")), f"{folder}/places")
    del packed, firsts, own, halves, shared
    discard(spark, f"{folder}/packed", f"{folder}/shared")
    size = places.agg(F.sum(F.size("places") * 4 + 24)).first()[0] or 0
    texts = keyed.join(F.broadcast(places) if size <= broadcast_limit else places, ["id", "t"]).select("id", "t", "text", "places")
    # one plan has both readings of the texts, so that a shuffle of them is used twice
    twice = _candidates(texts, min_words, True).groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("g", "lo")
    repeated = stored(_packed(_repeated(_candidates(texts, min_words, False), twice)), f"{folder}/{min_words}")
    del places, texts, twice
    discard(spark, f"{folder}/places")
    # a level's windows go when the next has them; which texts had any of them stays
    levels, length, alive = [], min_words, repeated
    while not alive.isEmpty():
        levels.append(stored(alive.where(F.exists("w", lambda x: x["later"])).select("id", "t", F.lit(length).alias("longest")), f"{folder}/longest-{length}"))
        longer = _extended(alive, length)
        twice = longer.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g", "lo")
        alive = stored(_packed(_repeated(longer, twice)), f"{folder}/{2 * length}")
        del longer, twice
        discard(spark, *[f"{folder}/{length}"] * (length > min_words))
        length *= 2
    starts = repeated.select("id", "t", F.transform(F.filter("w", lambda x: x["later"]), lambda x: x["start"]).alias("s")).where(F.size("s") > 0)
    far = lambda x, y: x > y + min_words
    begins = F.filter("s", lambda x, i: (i == 0) | far(x, F.get("s", i - 1)))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | far(F.get("s", i + 1), x))
    stretches = starts.select("id", "t", begins.alias("begins"), F.transform(ends, lambda x: x + min_words).alias("ends"))
    if levels:
        longest = reduce(DataFrame.unionAll, levels).groupBy("id", "t").agg(F.max("longest").alias("longest"))
        stretches = stretches.join(longest, ["id", "t"])
    else:
        stretches = stretches.withColumn("longest", F.lit(0))
    none = F.lit(None).cast("array<int>")
    found = durable(stretches.unionByName(copies.withColumns({"begins": none, "ends": none, "longest": F.lit(0)})).withColumn("hit", F.lit(True)))
    del alive, repeated, copies, levels, starts, stretches
    discard(spark, folder)
    return found


def dedup_substrings(docs: DataFrame, min_words: int = 50, broadcast_limit: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then kept_text, n_words, n_removed
    and longest (long); columns of ``docs`` with those names go.

    Each word is removed that a window of ``min_words`` words covers whose
    word sequence also starts in a document with a smaller doc_id. Words are
    runs of characters other than ASCII white space. kept_text is the text's
    kept words joined by one space, empty for a null or blank text. Rows that
    share a doc_id never remove from each other; a null doc_id is smallest.
    longest: the longest window found of ``min_words`` times 1, 2, 4 ... words
    that also starts in a smaller doc_id, 0 if there is none. An empty table gives no rows."""
    found = repeated_windows(docs, min_words, broadcast_limit, id_col, text_col)
    size = found.agg(F.sum(F.coalesce(F.size("begins"), F.lit(0)) * 8 + 24)).first()[0] or 0
    rest = [c for c in docs.columns if c not in (text_col, "kept_text", "n_words", "n_removed", "longest")]
    source = docs.select(F.struct(*rest).alias("doc"), *_keys(id_col, text_col))
    both = source.join(F.broadcast(found) if size <= broadcast_limit else found, ["id", "t"], "left").select("doc", "text", "begins", "ends", "longest", "hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            kept, total, removed, longest = [], [], [], []
            for text, begins, ends, level, hit in zip(*(batch.column(c).to_pylist() for c in ("text", "begins", "ends", "longest", "hit"))):
                words = text.split() if text else []
                total.append(len(words))
                longest.append(level or 0)
                if hit and begins is None:
                    longest[-1] = min_words << (len(words) // min_words).bit_length() - 1
                    words = []
                elif hit:
                    words = list(chain.from_iterable(words[a:b] for a, b in zip([0, *ends], [*begins, len(words)])))
                kept.append(b" ".join(words))
                removed.append(total[-1] - len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(longest, pa.int64())], names=["doc", "kept", "n_words", "n_removed", "longest"])

    out = both.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, kept binary, n_words bigint, n_removed bigint, longest bigint")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in rest], F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed", "longest")
