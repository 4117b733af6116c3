"""Near duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it set. To find all fingerprints within ``radius`` bits of each other,
every bit position i gets a vector m(i) of radius + 1 bits, and every nonzero
vector v gives a table whose key keeps the bits with an odd inner product
<m(i), v>. The at most ``radius`` bits in which two near fingerprints differ
span fewer than radius + 1 dimensions, so some v is orthogonal to all of them
and that table's keys are equal: no near pair is missed.

Work is on distinct fingerprints. Within a bucket only links that connect it
are written, never all its pairs; buckets beyond ``bucket_limit`` take another
exact way, by the midpoints of near pairs, that is linear in their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, components, durable, give_back, raw, slices

BITS = 64


def covering_masks(radius: int, seed: int = 0, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks of ``bits`` bits. The vectors m(i) run through whole
    permutations of the space, so that all masks keep about half the bits."""
    space, rng, vectors = 1 << (radius + 1), np.random.default_rng(seed), []
    while len(vectors) < bits:
        vectors += rng.permutation(space).tolist()
    return [sum(1 << i for i, m in enumerate(vectors[:bits]) if (m & v).bit_count() & 1) for v in range(1, space)]


def fold(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive runs of uint64 hashes; runs are not empty."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > lengths[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _shingle_hashes(text: bytes | None, shingle: int, seed: int, step: int = 1 << 18) -> Iterator[list[int]]:
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    for at in range(0, len(first), step):
        yield [digest(joined[a:b], seed) for a, b in zip(first[at : at + step].tolist(), last[at : at + step].tolist())]


def mixed_hashes(hashes: np.ndarray, view: int) -> np.ndarray:
    """Hashes of the same things as another hash function would give them
    (the finalizer of SplitMix64)."""
    x = hashes + np.uint64(view * 0x9E3779B97F4A7C15 & (1 << BITS) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; without words it is zero."""
    ones, total = np.zeros(BITS, np.int64), 0
    for part in _shingle_hashes(text, shingle, seed):
        hashes = np.array(part, np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed
    long. A null, empty or blank text has fingerprint zero; a text of fewer
    words than ``shingle`` has one shingle, its whole word sequence."""
    id_type = docs.select(id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts, out = batch.column("text").to_pylist(), np.zeros(batch.num_rows, np.uint64)
            hashes, where, lengths = [], [], []
            for i, text in enumerate(texts):
                if text and len(text) > 4 << 20:
                    out[i] = fingerprint(text, shingle, seed)
                    continue
                for part in _shingle_hashes(text, shingle, seed, 1 << 62):
                    hashes += part
                    where.append(i)
                    lengths.append(len(part))
                if len(hashes) >= 1 << 18 or i + 1 == len(texts):
                    if where:
                        out[where] = fold(np.array(hashes, np.uint64), np.array(lengths))
                    hashes, where, lengths = [], [], []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), raw(text_col).alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, fp bigint").withColumnRenamed("id", id_col)


def _tree_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a bucket's members that near pairs connect, at
    most one less than there are members."""
    members = members.view(np.uint64)  # bits of a signed number are counted without its sign
    signed = lambda x: x.view(np.int64).tolist()
    left, links = members, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                links += [(int(at.view(np.int64)), x) for x in signed(found)]
                front += list(found)
                left = left[~near]
    return links


def _ball(values: np.ndarray, free: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every value with up to ``reach`` of its free bits changed, beside it."""
    for n in range(reach + 1):
        for flips in combinations(range(BITS), n):
            flip = np.uint64(sum(1 << i for i in flips))
            may = (free & flip) == flip
            if may.any():
                yield values[may] ^ flip, values[may]


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """All columns of ``fps``, one of them fp, and the key of each table."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in covering_masks(radius)])
    # few small rows make many: spread them before they grow
    spread = fps.repartition(2 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.select(*fps.columns, F.posexplode(keys).alias("v", "bits")).select(*fps.columns, F.xxhash64("v", "bits").alias("key"))


def near_links(fps: DataFrame, radius: int = 4, bucket_limit: int = 8192) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``radius`` bits
    apart, enough of them that connected components equal those of all such
    pairs. ``fps`` has one column fp of distinct longs. ``radius`` is even."""
    if radius % 2:
        raise ValueError("radius must be even")
    keyed = _keyed(fps, radius)
    sizes = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    links = sizes.where("n = 2").where(near("lo", "hi")).select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for members in batch.column("fps") for x in _tree_links(np.array(members.as_py(), np.int64), radius)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        give_back()

    listed = keyed.join(checked_broadcast(sizes.where(F.col("n").between(3, bucket_limit)).select("key"), 16), "key")
    lists = listed.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    links = links.unionAll(lists.select("fps").mapInArrow(tree, "a bigint, b bigint"))
    hot = sizes.where(F.col("n") > bucket_limit).select("key")
    if not hot.isEmpty():
        links = links.unionAll(_midpoint_links(keyed.join(hot, "key"), radius))
    return links.distinct()


def _midpoint_links(members: DataFrame, radius: int) -> DataFrame:
    """Links for buckets of any size: two members are near exactly if some
    value is within half the radius of both, so members are grouped by all
    such values among the bits that vary in their bucket, and each is linked
    to the smallest of its group. Rows grow in proportion to the members."""
    members = durable(members)
    free = members.groupBy("key").agg(F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, free = (np.asarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in ("fp", "free"))
            for z, x in _ball(fp, free, radius // 2):
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(x.view(np.int64))], names=["z", "fp"])

    spots = members.join(free, "key").select("fp", F.col("any").bitwiseXOR(F.col("all")).alias("free")).distinct().mapInArrow(spread, "z bigint, fp bigint")
    spots = durable(spots)
    least = spots.groupBy("z").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("z", "lo")
    return spots.join(least, "z").where("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, bucket_limit: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, component_id), the latter the
    smallest doc_id that links of at most ``radius`` differing bits reach.

    Null and empty texts share fingerprint zero and so one component. Rows
    that repeat a doc_id each get a row. A null doc_id never names a component
    unless all of its component are null. An empty table gives no rows."""
    fps = durable(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = durable(fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")))
    joined = components(near_links(classes.select("fp"), radius, bucket_limit))
    member = classes.join(joined.withColumnRenamed("node", "fp"), "fp")
    heads = member.groupBy("component").agg(F.min("rep").alias("head"))
    linked = member.join(heads, "component").select("fp", "head")
    alone = classes.where("n > 1").join(joined.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("rep").alias("head"))
    named = linked.unionAll(alone)
    return fps.join(named, "fp", "left").select(id_col, "fp", F.coalesce("head", id_col).alias("component_id"))


def hex16(column: str | Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
