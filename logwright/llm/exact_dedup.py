"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``freqItems``, whose counters merge across
partitions) names every digest held by at least ``support`` of the rows, and
perhaps others. A second pass counts the named digests exactly and keeps those
that are frequent: at most 1/support rows, which is the proven bound of what is
broadcast. Rows of a frequent digest get their group's figures from that
broadcast, map-side, and never enter a shuffle; all others meet in an ordinary
one, where no group can hold more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, durable


def normalised(text: str | Column, strip: bool = False, lower: bool = False) -> Column:
    """The text that is compared; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if strip:
        out = F.regexp_replace(out, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else out


def heavy_digests(digests: DataFrame, support: float) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that at least ``support``
    of the rows hold; 1/support rows at most. ``digests``: (doc_id, digest)."""
    named = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    total = digests.count()
    counted = digests.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return durable(counted.where(F.col("group_size") >= max(2.0, support * total)))


def exact_duplicates(docs: DataFrame, support: float = 0.0005, strip: bool = False, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).
    The row with the largest doc_id of equal texts stays; rows that repeat
    that doc_id and text are all kept. A null doc_id is kept only in a group
    without any other. Null and empty texts are equal. An empty table gives no
    rows."""
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col, strip, lower), 256).alias("digest"))
    digests = durable(digests)
    heavy = heavy_digests(digests, support)
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    cold = rest.select("digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return hot.unionByName(cold).select(
        F.col("doc_id").alias(id_col), "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, strip: bool = False, lower: bool = False, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, all columns: of equal texts all rows with the
    largest doc_id, or with a null one where there is no other."""
    gone = exact_duplicates(docs, strip=strip, lower=lower, id_col=id_col, text_col=text_col, **how).where("not kept")
    gone = durable(gone.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.sha2(normalised(text_col, strip, lower), 256) == F.col("__sha"))
    return docs.join(checked_broadcast(gone, 112), same, "left_anti").select(*docs.columns)
