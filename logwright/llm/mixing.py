"""Mixing sources to target weights by temperature.

Source s with token share p(s) gets weight p(s)^a / sum of p^a. Exponent a is
found by bisection: entropy falls as a rises from 0 (all sources alike) to 1
(shares as they are), and so does the highest number of times that a source
must be repeated to fill its part of the budget. The exponent is the largest
that reaches the target entropy, raised as far as the repetition limit asks.

The weights are then realised as a sequence of blocks of equal budget. A
source's documents come in a new random permutation each time through, and
follow one another in the source's own stream of tokens; the part of that
stream that lies in a block's budget for the source goes into the block, where
all are permuted. So every block has the target weights, to within one
document of each source.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, durable


def weights_at(shares: dict, a: float) -> dict:
    powers = {s: p**a for s, p in shares.items() if p > 0}
    total = sum(powers.values())
    return {s: x / total for s, x in powers.items()}


def entropy(weights: dict) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def find_exponent(tokens: dict, budget: float, target_entropy: float | None = None, max_repeats: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1]; entropy in nats. 1 if neither target asks for less."""
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n > 0}

    def bisect(holds) -> float:  # noqa: ANN001
        """The smallest exponent from which on ``holds`` is false."""
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return hi

    a = 1.0
    if target_entropy is not None and entropy(shares) < target_entropy:
        a = bisect(lambda x: entropy(weights_at(shares, x)) >= target_entropy)
    if max_repeats is not None:

        def over(x: float) -> bool:
            return max(w * budget / tokens[s] for s, w in weights_at(shares, x).items()) > max_repeats

        if over(a) and max_repeats * total >= budget:
            a = max(a, bisect(over))
    return a


def mixture(tokens: dict, budget: float | None = None, entropy_share: float = 0.98, max_repeats: float = 4.0) -> tuple[dict, float, float]:
    """Weights, exponent and budget in tokens. The target entropy is
    ``entropy_share`` of the highest possible. Without a budget, it is the
    least that takes every document at least once; the repetition limit then
    bounds the weight of a source against that of any other."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return {}, 1.0, 0.0
    total = sum(tokens.values())
    target = entropy_share * log(len(tokens)) if len(tokens) > 1 else None
    if budget is not None:
        a = find_exponent(tokens, budget, target, max_repeats)
        return weights_at({s: n / total for s, n in tokens.items()}, a), a, float(budget)
    a = find_exponent(tokens, total, target)
    least = lambda x: max(tokens[s] / w for s, w in weights_at({s: n / total for s, n in tokens.items()}, x).items())
    lo, hi = a, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        w = weights_at({s: n / total for s, n in tokens.items()}, mid)
        lo, hi = (mid, hi) if max(w[s] * least(mid) / tokens[s] for s in tokens) > max_repeats else (lo, mid)
    first = weights_at({s: n / total for s, n in tokens.items()}, a)
    a = hi if max(first[s] * least(a) / tokens[s] for s in tokens) > max_repeats else a
    return weights_at({s: n / total for s, n in tokens.items()}, a), a, least(a)


def token_count(text_col: str) -> Column:
    """Words of a text, and one for its end."""
    return (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def mix(
    docs: DataFrame,
    budget: float | None = None,
    entropy_share: float = 0.98,
    max_repeats: float = 4.0,
    blocks: int = 100,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is taken: (doc_id, source, n_tokens,
    epoch, weight, block, slot). Blocks and slots count from 0 and order the
    mixture; epoch is how often the document came before.

    A document's tokens are its words and an end, so that null and empty texts
    have one. A null source is a source of its own. Where the budget ends
    inside a document it is taken still. Rows that repeat a doc_id are taken
    alike. An empty table gives no rows. At most ``max_repeats`` passes, in
    part or whole, are made over a source as long as the budget allows it."""
    placed, _ = _started(docs, budget, entropy_share, max_repeats, seed, id_col, text_col, source_col)
    placed = placed.where("start < part")
    placed = placed.withColumn("block", F.least(F.floor(F.col("start") / F.col("part") * blocks), F.lit(blocks - 1)).cast("int"))
    # slots in a block: again slices of a random order, and ranks within
    placed = placed.withColumn("place", F.xxhash64("doc_id", "t", "epoch", F.lit(seed + 1))).withColumn("part_of", F.shiftrightunsigned("place", 56))
    placed = durable(placed.select("doc_id", "source", "t", "n_tokens", "epoch", "weight", "block", "place", "part_of"))
    counts = placed.groupBy("block", "part_of").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("block").orderBy("part_of")) - F.col("n"))
    base = checked_broadcast(durable(base.select("block", "part_of", "base")), 24)
    rank = F.row_number().over(Window.partitionBy("block", "part_of").orderBy("place", "doc_id", "t", "epoch"))
    out = placed.withColumn("rank", rank).join(base, ["block", "part_of"])
    return out.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", "weight", "block", (F.col("base") + F.col("rank") - 1).alias("slot"))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _started(docs: DataFrame, budget: float | None, entropy_share: float, max_repeats: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """For each row and pass over its source, the place start in the source's
    stream of tokens, of which the first part tokens are taken; and a row
    (s, epoch, weight, part, pass_tokens) for each source and pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(text_col).alias("n_tokens"), text_key(text_col).alias("t"))
    rows = durable(rows)
    tokens = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("n_tokens")).collect()}
    weights, _, budget = mixture(tokens, budget, entropy_share, max_repeats)
    spark = docs.sparkSession
    # one entry for each source and pass; sources are as few as the driver can plan for
    plan = [(s, e, float(w), w * budget, float(tokens[s])) for s, w in weights.items() for e in range(max(1, -int(-w * budget // tokens[s])))]
    passes = spark.createDataFrame(plan, "s string, epoch int, weight double, part double, pass_tokens double")
    taken = rows.join(F.broadcast(passes) if len(plan) <= 1 << 16 else passes, F.col("source").cast("string").eqNullSafe(F.col("s")))
    taken = taken.withColumn("order", F.xxhash64("doc_id", "t", "epoch", F.lit(seed))).withColumn("cut", F.shiftrightunsigned("order", 54))
    # running tokens of each pass: sums of slices of the random order, then within a slice
    sums = taken.groupBy("s", "epoch", "cut").agg(F.sum("n_tokens").alias("cut_tokens"))
    before = sums.withColumn("before", F.sum("cut_tokens").over(Window.partitionBy("s", "epoch").orderBy("cut")) - F.col("cut_tokens"))
    before = checked_broadcast(durable(before.select(F.col("s").alias("bs"), F.col("epoch").alias("be"), F.col("cut").alias("bc"), "before")), 48)
    inside = Window.partitionBy("s", "epoch", "cut").orderBy("order", "doc_id", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = taken.withColumn("upto", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    placed = placed.join(before, F.col("s").eqNullSafe(F.col("bs")) & (F.col("epoch") == F.col("be")) & (F.col("cut") == F.col("bc")))
    start = F.col("epoch") * F.col("pass_tokens") + F.col("before") + F.col("upto")
    return placed.withColumn("start", start), passes


def mixed(
    docs: DataFrame,
    budget: float | None = None,
    entropy_share: float = 0.98,
    max_repeats: float = 4.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents as often as the mixture takes them, all columns; ``mix``
    has their order. A pass takes the rows before a place in its random order;
    rows alike in doc_id, source and text, nulls equal, share a place, and come
    where the mixture takes them all. Without a budget every row comes at least
    once. Texts are not shuffled: only the places where passes end are sought."""
    placed, passes = _started(docs, budget, entropy_share, max_repeats, seed, id_col, text_col, source_col)
    signed = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    ends = durable(placed.where("start >= part").groupBy(F.col("s").alias("es"), F.col("epoch").alias("ee")).agg(F.min(signed(F.col("order"))).alias("__end")))
    limits = passes.join(ends, F.col("s").eqNullSafe(F.col("es")) & (F.col("epoch") == F.col("ee")), "left").select(F.col("s").alias("__source"), F.col("epoch").alias("__epoch"), "__end")
    rows = docs.join(checked_broadcast(durable(limits), 200), F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    place = signed(F.xxhash64(F.col(id_col), text_key(text_col), F.col("__epoch"), F.lit(seed)))
    return rows.where(F.col("__end").isNull() | (place < F.col("__end"))).select(*docs.columns)
