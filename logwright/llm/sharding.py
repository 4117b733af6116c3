"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 63-bit hash of their text, then by doc_id, then by a
number of their own, so equal texts follow one another. The driver holds a small histogram: exact bytes and
rows between candidate boundaries, counted across all partitions. Each round
splits the intervals that still hide a splitter outside the tolerance, or more
rows than one task should order, into 256 by new probes between the smallest
and the largest key seen there; an interval of one hash alone is probed by
doc_id, one of equal rows by their numbers. When every splitter lies on a boundary within the tolerance, rows go
through one exchange, by interval, and get shard and slot from the interval's
place in the order.

Splitters fall inside a group of equal texts only if no boundary between
groups is within the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.llm.common import durable

TOP_BITS, FAN = 12, 256
#: Doc_ids further from zero share a place in the order.
_FAR = 1 << 61


@dataclass
class Interval:
    """Rows of one path of probes, between the least and the largest hash,
    doc_id and number in it."""

    path: int
    lo: int
    hi: int
    id_lo: int
    id_hi: int
    row_lo: int
    row_hi: int
    size: int
    rows: int

    @property
    def place(self) -> tuple[int, int, int]:
        return self.lo, self.id_lo, self.row_lo

    @property
    def probes(self) -> tuple[int, int, int]:
        """Level, first key and step of the probes that split this interval."""
        level = 0 if self.lo < self.hi else 1 if self.id_lo < self.id_hi else 2
        lo, hi = ((self.lo, self.hi), (self.id_lo, self.id_hi), (self.row_lo, self.row_hi))[level]
        return level, lo, (hi - lo) // FAN + 1


def _histogram(rows: DataFrame, path: Column) -> list[Interval]:
    found = rows.groupBy(path.alias("path")).agg(F.min("h"), F.max("h"), F.min("k"), F.max("k"), F.min("r"), F.max("r"), F.sum("size"), F.count(F.lit(1)))
    return sorted((Interval(*r) for r in found.collect()), key=lambda x: x.place)


def _splitters(order: list[Interval], shards: int, law: str) -> list[int]:
    """For each inner splitter, how many of the intervals lie below it."""
    weights = [x.size if law == "bytes" else x.rows for x in order]
    total, below, at, out = sum(weights), 0, 0, []
    for s in range(1, shards):
        target = total * s / shards
        while at < len(order) and below + weights[at] / 2 < target:
            below += weights[at]
            at += 1
        out.append(at)
    return out


def _open(order: list[Interval], shards: int, tolerance: float, most_rows: float) -> list[Interval]:
    """Intervals that need more probes."""
    total = sum(x.size for x in order)
    slack, below, target, out = tolerance * total / shards, 0, 1, []
    for x in order:
        above, crossed = below + x.size, False
        while target < shards and total * target / shards <= above:
            t = total * target / shards
            crossed |= min(t - below, above - t) > slack
            target += 1
        if x.rows > 1 and (crossed or x.rows > most_rows):
            out.append(x)
        below = above
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, extra_bytes: int = 16, task_share: float = 1 / 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per
    document. size: UTF-8 bytes of the text, null none, plus ``extra_bytes``.
    Shards are consecutive runs of the order whose sizes differ from the mean
    by at most twice ``tolerance``, or by one row where rows are larger; slot
    counts from 0 in each. Rows with equal doc_id and text follow one another
    and may be split like any others; a null doc_id comes first among equal
    texts. The hash of a null text is that of an empty one. An empty table gives no
    rows, and shards without rows are possible only with fewer rows than
    shards or rows larger than a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
        F.coalesce(F.greatest(F.least(F.col(id_col).cast("long"), F.lit(_FAR)), F.lit(-_FAR)), F.lit(-_FAR - 1)).alias("k"),
        (F.octet_length(text).cast("long") + extra_bytes).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # numbers are drawn once, for what is kept
    rows = durable(rows.withColumns({"path": F.shiftrightunsigned("h", 63 - TOP_BITS), "r": F.monotonically_increasing_id()}))
    spark = rows.sparkSession
    order = _histogram(rows, F.col("path"))
    most_rows = max(1.0, task_share * sum(x.rows for x in order))
    # a child's path may not meet a top-level one
    fresh = 1 << TOP_BITS
    todo = _open(order, shards, tolerance, most_rows)
    while todo:
        numbered = {x.path: fresh + i * FAN for i, x in enumerate(todo)}
        fresh += len(todo) * FAN
        table = [(x.path, numbered[x.path], *x.probes) for x in todo]
        probes = spark.createDataFrame(table, "path long, number long, level int, lo long, step long")
        hit = rows.join(F.broadcast(probes), "path", "left")
        path = F.when(F.col("number").isNull(), F.col("path")).otherwise(F.expr("number + (element_at(array(h, k, r), level + 1) - lo) div step"))
        parts = _histogram(hit.where("number is not null"), path)
        rows = hit.select("doc_id", "h", "k", "r", "size", "text_crc32", path.alias("path"))
        order = sorted([x for x in order if x.path not in numbered] + parts, key=lambda x: x.place)
        todo = _open(order, shards, tolerance, most_rows)
    cuts, places, first = _splitters(order, shards, "bytes"), [], {}
    for i, x in enumerate(order):
        shard = sum(c <= i for c in cuts)
        places.append((x.path, shard, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + x.rows
    place = F.broadcast(spark.createDataFrame(places, "path long, shard int, base long"))
    within = Window.partitionBy("path", "shard", "base").orderBy("h", "k", "r")
    return rows.join(place, "path").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
