"""Context of violations, gathered in one plan for all of them: peers,
candidates, neighbours. Anchors come as DataFrames; joins start from them, so
that hub objects are only ever expanded for anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.functions.values import blank, id_prefix, sample_order, seed_of
from logwright.log import Log

#: The positions of the pseudo-random order are taken modulo this.
_ROUND = 2147483647


def systematic_sample(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """``n`` rows, evenly spaced in the order: places floor(i * rows / n)."""
    total = df.count()
    places = sorted({i * total // n for i in range(n)}) if total else []
    # ranks by blocks of the order, so that no task ranks all rows
    low, high = df.agg(F.min(order), F.max(order)).first() if total else (0, 0)
    width = ((high - low) // 1024 + 1) if total else 1
    blocks = df.withColumn("__b", F.expr(f"({order} - {low}L) div {width}L")) if total else df.withColumn("__b", F.lit(0).cast("long"))
    sizes = blocks.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).drop("__n")
    ranked = blocks.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(order))).join(F.broadcast(base), "__b")
    return ranked.where((F.col("__base") + F.col("__k") - 1).isin(places)).drop("__b", "__k", "__base") if places else df.limit(0)


def _next_in_rotation(anchors: DataFrame, pool: DataFrame, take: int) -> DataFrame:
    """(anchor, peer_id, nth): the ``take`` rows of ``pool`` (peer_id, pos)
    that follow each anchor's start among all positions, round and round. A
    sort by blocks of positions and an equi-join on ranks: no pairs are made
    but those returned."""
    width = _ROUND // 1024 + 1
    rows = pool.select(F.lit(1).alias("own"), "pos", "peer_id", F.lit(None).cast("string").alias("anchor"))
    rows = rows.unionByName(anchors.select(F.lit(0).alias("own"), F.col("start").alias("pos"), F.lit(None).cast("string").alias("peer_id"), "anchor"))
    rows = rows.withColumn("block", F.expr(f"pos div {width}"))
    sizes = rows.groupBy("block").agg(F.sum("own").alias("n"))
    w = Window.orderBy("block")
    base = sizes.select("block", (F.sum("n").over(w) - F.col("n")).alias("base"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    before = F.sum("own").over(Window.partitionBy("block").orderBy("pos", "own", "peer_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    ranked = rows.withColumn("rank", before).join(F.broadcast(base), "block").withColumn("rank", F.col("rank") + F.col("base"))
    places = ranked.where("own = 1").select("rank", "peer_id")
    wanted = ranked.where("own = 0 and total > 0").select("anchor", F.col("rank").alias("from"), "total", F.explode(F.sequence(F.lit(0), F.least(F.lit(take), F.col("total").cast("int")) - 1)).alias("nth"))
    return wanted.select("anchor", "nth", ((F.col("from") + F.col("nth")) % F.col("total")).alias("rank")).join(places, "rank").select("anchor", "peer_id", "nth")


def sample_peers(anchors: DataFrame, pool: DataFrame, target: Column | None = None, k: int = 5) -> DataFrame:
    """(anchor, peer_id, place): ``k`` ids of ``pool`` (row_id, ocel_id and
    attributes, initial rows only) for each anchor id, other than itself, in
    a pseudo-random order that the anchor's id rotates. The first, half of
    them and one at least, have the ``target`` as far as there are such."""
    seeded = anchors.select(F.col("ocel_id").alias("anchor")).distinct().withColumn("start", (F.lit(_ROUND) - seed_of(F.col("anchor"))) % _ROUND)
    has = F.lit(False) if target is None else ~blank(target.cast("string"))
    rows = pool.select("row_id", F.col("ocel_id").alias("peer_id"), has.alias("has")).groupBy("peer_id").agg(F.min("row_id").alias("row_id"), F.max("has").alias("has"))
    rows = rows.withColumn("pos", sample_order(F.col("row_id"), 0))
    half = max(1, k // 2)
    other = _next_in_rotation(seeded, rows.select("peer_id", "pos"), k + half + 1).withColumn("strand", F.lit(1))
    if target is not None:
        with_target = _next_in_rotation(seeded, rows.where("has").select("peer_id", "pos"), half + 1).where("peer_id <> anchor")
        nth = F.row_number().over(Window.partitionBy("anchor").orderBy("nth"))
        other = with_target.withColumn("nth", nth).where(F.col("nth") <= half).withColumn("strand", F.lit(0)).unionByName(other)
    once = other.where("peer_id <> anchor").groupBy("anchor", "peer_id").agg(F.min(F.struct("strand", "nth")).alias("at"))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("at"))
    return once.withColumn("place", place).where(F.col("place") <= k).select("anchor", "peer_id", "place")


def candidate_pool(ids: DataFrame, wanted: str | None, expected_type: str | None = None, k: int = 50, most: int = 200) -> DataFrame:
    """(ocel_id, strand, place): ids that may stand in for a wrong one. With a
    type, up to ``k`` of that type; else ids with the same prefix, then any,
    ``most`` in all."""
    rows = ids.where("ocel_id is not null").groupBy("ocel_id").agg(F.min("row_id").alias("row_id"), F.min("ocel_type").alias("ocel_type"))
    if expected_type is not None:
        names = {expected_type, expected_type.removesuffix("s"), expected_type + "s"}
        rows = rows.where(F.lower("ocel_type").isin([n.lower() for n in names]))
        strand = F.lit(0)
    else:
        prefix = F.lit(None) if wanted is None else id_prefix(F.lit(wanted))
        strand = F.when(F.coalesce((prefix != "") & F.col("ocel_id").startswith(prefix), F.lit(False)), 0).otherwise(1) if wanted else F.lit(1)
    seed = 0
    for ch in wanted or "":
        seed = (seed * 131 + ord(ch)) & 2147483647
    ordered = rows.withColumns({"strand": strand, "order": sample_order(F.col("row_id"), seed)}).orderBy("strand", "order", "row_id").limit(max(k, most) if expected_type is None else k)
    return ordered.select("ocel_id", "strand", F.row_number().over(Window.orderBy("strand", "order", "row_id")).alias("place"))


def event_objects(log: Log, anchors: DataFrame, most: int = 8) -> DataFrame:
    """(ocel_event_id, ocel_object_id, ocel_qualifier, ocel_type, place): the
    first objects of each anchor event, dangling ones without a type."""
    own = log.e2o.join(anchors.select(F.col("ocel_id").alias("ocel_event_id")).distinct(), "ocel_event_id")
    first = F.row_number().over(Window.partitionBy("ocel_event_id").orderBy("row_id", "ocel_object_id", "ocel_qualifier"))
    own = own.withColumn("place", first).where(F.col("place") <= most)
    types = log.object.where("ocel_id is not null").groupBy(F.col("ocel_id").alias("ocel_object_id")).agg(F.min("ocel_type").alias("ocel_type"))
    return own.join(types, "ocel_object_id", "left").select("ocel_event_id", "ocel_object_id", "ocel_qualifier", "ocel_type", "place")


def object_events(log: Log, anchors: DataFrame, most: int = 8) -> DataFrame:
    """(ocel_object_id, ocel_event_id, ocel_type, place): first events of each anchor object."""
    own = log.e2o.join(anchors.select(F.col("ocel_id").alias("ocel_object_id")).distinct(), "ocel_object_id")
    known = log.event.where("ocel_id is not null").groupBy(F.col("ocel_id").alias("ocel_event_id")).agg(F.min("ocel_type").alias("ocel_type"))
    joined = own.join(known, "ocel_event_id")
    first = F.row_number().over(Window.partitionBy("ocel_object_id").orderBy("row_id", "ocel_event_id"))
    return joined.withColumn("place", first).where(F.col("place") <= most).select("ocel_object_id", "ocel_event_id", "ocel_type", "place")


def neighbours(log: Log, anchors: DataFrame) -> DataFrame:
    """(anchor, neighbour, ocel_type): distinct events that share an object
    with an anchor event."""
    ids = anchors.select(F.col("ocel_id").alias("anchor")).distinct()
    own = log.e2o.select(F.col("ocel_event_id").alias("anchor"), "ocel_object_id").join(ids, "anchor").distinct()
    near = own.join(log.e2o.select("ocel_object_id", F.col("ocel_event_id").alias("neighbour")), "ocel_object_id").where("anchor <> neighbour").select("anchor", "neighbour").distinct()
    return near.join(log.event.select(F.col("ocel_id").alias("neighbour"), "ocel_type"), "neighbour").select("anchor", "neighbour", "ocel_type").distinct()


def event_time(log: Log, skip_blank: bool = True) -> DataFrame:
    """(ocel_id, ocel_time): of the first table, in the order of the map, that
    has the event, or with ``skip_blank`` that has a time for it; of several
    rows in a table the last."""
    rows = log.event_times()
    rows = rows.where(~blank(F.col("ocel_time"))) if skip_blank else rows
    return rows.groupBy("ocel_id").agg(F.min_by("ocel_time", F.struct("ordinal", -F.col("row_id"), "ocel_time")).alias("ocel_time"))


def neighbour_window(log: Log, anchors: DataFrame, most: int = 10) -> DataFrame:
    """(anchor, neighbour, ocel_time): neighbours by time, times compared as
    text. Of more than ``most``, half are the last up to the anchor's time and
    half the first after it, filled up from the rest in order."""
    times = event_time(log)
    timed = neighbours(log, anchors).select("anchor", "neighbour").distinct().join(times.withColumnRenamed("ocel_id", "neighbour"), "neighbour", "left")
    timed = timed.join(times.select(F.col("ocel_id").alias("anchor"), F.col("ocel_time").alias("at")), "anchor", "left")
    w, order = Window.partitionBy("anchor"), [F.asc_nulls_last("ocel_time"), F.col("neighbour")]
    side = F.when(F.col("at").isNull() | F.col("ocel_time").isNull(), 2).when(F.col("ocel_time") <= F.col("at"), 0).otherwise(1)
    ranked = timed.withColumn("side", side).withColumns({"k": F.row_number().over(w.orderBy(*order)), "all": F.count(F.lit(1)).over(w)})
    sided = Window.partitionBy("anchor", "side")
    ranked = ranked.withColumn("near", F.when(F.col("side") == 0, F.row_number().over(sided.orderBy(F.desc("ocel_time"), F.desc("neighbour")))).when(F.col("side") == 1, F.row_number().over(sided.orderBy(*order))))
    chosen = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.when(F.col("near") <= most // 2, 0).otherwise(1), "k")))
    return chosen.where((F.col("all") <= most) | (F.col("rank") <= most)).select("anchor", "neighbour", "ocel_time")


def events_with_neighbour(log: Log) -> DataFrame:
    """(ocel_event_id): events that share an object with another event; told
    from counts of distinct events by object, without pairing any."""
    pairs = log.e2o.where("ocel_event_id is not null and ocel_object_id is not null").select("ocel_event_id", "ocel_object_id").distinct()
    shared = pairs.groupBy("ocel_object_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(shared, "ocel_object_id", "left_semi").select("ocel_event_id").distinct()


def type_candidates(log: Log, kind: str, ocel_type: str) -> DataFrame:
    """Rows of a type, whose type or times are to be judged."""
    return getattr(log, kind).where(F.col("ocel_type") == ocel_type).select("ocel_id", "ocel_type")


def time_candidates(log: Log, ocel_type: str) -> DataFrame:
    return log.event_times().where(F.col("ocel_type") == ocel_type).select("ocel_id", "ocel_time", F.col("table").alias("target_table"))


def schema_candidates(log: Log, kind: str) -> DataFrame:
    """(ocel_type, table, columns): one row for each type, to be judged for
    attributes that it lacks."""
    rows = [(t.ocel_type, t.table, ", ".join(f"{a} {t.declared.get(a, '')}".strip() for a in t.attributes)) for t in log.tables(kind)]
    return log.spark.createDataFrame(rows, "ocel_type string, table string, columns string")
