"""Helpers shared by the operators: durable intermediate results, graph
components, prefix sums and byte-bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwright.session import durable, shared_dir, ship

__all__ = ["durable", "shared_dir", "ship"]

#: Characters that separate words in every contract of this package.
WORD_SPACE = b"\t\n\x0b\x0c\r "
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes: Arrow then hands Python the bytes
    without decoding them."""
    return F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers stay
    for later tasks, beside a JVM that may need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let go now of the shuffle files and kept results that no plan names any
    more: executors delete them when the driver collects its garbage, which may
    be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` computed now and written as Parquet to a folder that all
    executors share, where ``discard`` can delete it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete what ``stored`` wrote, and the shuffle files behind it."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    release(spark)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``most_bytes`` in each,
    or a single row."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - 1).clip(0) // most_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
            yield batch.slice(a, b - a)
    give_back()


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; empty runs sum to zero."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as (node, component)
    where component is the smallest node reachable. Only nodes with an edge
    to another node appear.

    Alternating large-star and small-star steps: each replaces edges by edges
    to a smaller neighbour, so a round costs two shuffles of the edge list and
    the rounds grow with the logarithm of the longest chain. Minima are
    aggregated map-side and joins are plain equi-joins, which adaptive
    execution can split, so a node with very many edges is no hot spot.
    """
    spark = edges.sparkSession
    links = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())

    state = digest(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        links = durable(small.where("u <> v").distinct())
        after = digest(links)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """``df``, a durable result, marked for broadcast if its rows times
    ``row_bytes`` stay within ``limit``; else left to shuffled joins."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
