"""The context of all violations of an issue in one plan: a row for each, for
a resolver to judge. What is gathered around an anchor is bounded by counts
that apply to each anchor, before it meets the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.functions.replies import row_hash
from logwright.functions.values import blank, id_prefix, sample_order
from logwright.log import Log
from logwright.operators import detectors, repair, sampling


def lifecycle_window(log: Log, pairs: DataFrame, most: int = 8) -> DataFrame:
    """(ocel_object_id, excluded, ocel_event_id, ocel_type, ocel_time,
    ocel_qualifier, place): for each of ``pairs`` (ocel_object_id, excluded)
    the first events of the object other than the excluded one, by row_id,
    with the time that their type's table has. Each object's first events are
    found once, however many pairs it is in."""
    wanted = pairs.select("ocel_object_id", "excluded").where("ocel_object_id is not null").distinct()
    known = log.event.where("ocel_id is not null").groupBy(F.col("ocel_id").alias("ocel_event_id")).agg(F.min("ocel_type").alias("ocel_type"))
    own = log.e2o.join(wanted.select("ocel_object_id").distinct(), "ocel_object_id", "left_semi").join(known, "ocel_event_id")
    once = own.groupBy("ocel_object_id", "ocel_event_id").agg(F.min("row_id").alias("row_id"), F.min_by("ocel_qualifier", F.struct("row_id", "ocel_qualifier")).alias("ocel_qualifier"), F.first("ocel_type").alias("ocel_type"))
    order = F.row_number().over(Window.partitionBy("ocel_object_id").orderBy("row_id", "ocel_event_id"))
    first = once.withColumn("nth", order).where(F.col("nth") <= most + 1)
    met = first.join(wanted, "ocel_object_id").where(~F.col("ocel_event_id").eqNullSafe(F.col("excluded")))
    place = F.row_number().over(Window.partitionBy("ocel_object_id", "excluded").orderBy("nth"))
    placed = met.withColumn("place", place).where(F.col("place") <= most)
    times = sampling.event_time(log, skip_blank=False).withColumnRenamed("ocel_id", "ocel_event_id")
    return placed.join(times, "ocel_event_id", "left").select("ocel_object_id", "excluded", "ocel_event_id", "ocel_type", "ocel_time", "ocel_qualifier", "place")


def events_in_sequence(log: Log, first_type: str, second_type: str, qualifier: str) -> DataFrame:
    """(first_id, second_id, first_time, second_time): events of two types that
    share an object, which the second has by ``qualifier``; one row for each
    two relations, with the times of the types' own tables."""
    times = {t.ocel_type: t.df.select("ocel_id", "ocel_time") for t in log.event_tables}
    one = times[first_type].select(F.col("ocel_id").alias("first_id"), F.col("ocel_time").alias("first_time"))
    two = times[second_type].select(F.col("ocel_id").alias("second_id"), F.col("ocel_time").alias("second_time"))
    starts = log.e2o.select(F.col("ocel_event_id").alias("first_id"), "ocel_object_id").join(one, "first_id")
    ends = log.e2o.where(F.col("ocel_qualifier") == qualifier).select(F.col("ocel_event_id").alias("second_id"), "ocel_object_id").join(two, "second_id")
    return starts.join(ends, "ocel_object_id").select("first_id", "second_id", "first_time", "second_time")


def prefix_pools(ids: DataFrame, wanted: DataFrame, most: int = 50) -> DataFrame:
    """(prefix, pool): up to ``most`` ids for each prefix that some wanted id
    has, in a pseudo-random order of rows."""
    prefixes = wanted.select(id_prefix(F.col("wanted")).alias("prefix")).where("prefix <> ''").distinct()
    rows = ids.where("ocel_id is not null").groupBy("ocel_id").agg(F.min("row_id").alias("row_id"))
    rows = rows.withColumn("prefix", id_prefix(F.col("ocel_id"))).join(prefixes, "prefix", "left_semi")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(sample_order(F.col("row_id"), 0), "row_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ocel_id"))), lambda x: x["ocel_id"]).alias("pool"))


def _listed(df: DataFrame, by: list[str], name: str, *columns: str) -> DataFrame:
    """One row for each key, with its rows in order as a list of structs."""
    rows = F.array_sort(F.collect_list(F.struct("place", *[c for c in columns if c != "place"])))
    return df.groupBy(*by).agg(rows.alias(name))


def _peers(log: Log, side: str, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor, peers): other ids of the anchor's type; one plan for each type
    of the schema."""
    parts = []
    for t in log.tables(side):
        pool = t.df.where("ocel_changed_field is null") if "ocel_changed_field" in t.df.columns else t.df
        mine = anchors.where(F.col("anchor_type") == t.ocel_type).select(F.col("anchor").alias("ocel_id"))
        parts.append(sampling.sample_peers(mine, pool, None, k))
    empty = log.spark.createDataFrame([], "anchor string, peer_id string, place int")
    return reduce(DataFrame.unionByName, parts, empty).groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "peer_id"))), lambda x: x["peer_id"]).alias("peers"))


def _own(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def contexts(log: Log, issue: str, violations: DataFrame, k: int = 5, most: int = 8) -> DataFrame:
    """One row for each distinct violation: (violation_id, issue, violation,
    anchor, anchor_type, candidate_types, events, objects, peers, candidates,
    neighbours, columns). violation is its row as JSON; lists that the task of
    the issue does not use are null.

    events: of an object, those that come first, without the one that the
    violation names; objects: of an event; peers: other rows of the type, for
    cells, times and types; candidates: ids with the prefix of the one that
    dangles; neighbours: of an event whose time is missing or doubted, around
    it; columns: of a type, for attributes that its schema may lack."""
    if issue not in repair.TASKS:
        raise repair.Refused(f"no task for {issue}")
    side = "event" if "event" in issue and not issue.startswith(("dangling", "duplicate_e2o")) else "object"
    ids = ("ocel_id", "ocel_event_id") if side == "event" else ("ocel_id", "ocel_object_id", "ocel_source_id")
    kind = _own(violations, f"{side}_type", "source_type", "ocel_type", "inferred_type_from_prefix")
    rows = violations.dropDuplicates().withColumns({"violation_id": row_hash(issue, violations), "__anchor": _own(violations, *ids), "__type": kind})
    plain = [c for c in violations.columns if c != "issue"]
    out = rows.select(
        "violation_id",
        F.lit(issue).alias("issue"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in plain])).alias("violation"),
        F.col("__anchor").alias("anchor"),
        F.col("__type").alias("__said"),
        _own(rows, "ocel_object_id", "ocel_source_id").alias("__object"),
        _own(rows, "ocel_event_id").alias("__event"),
        (F.when(F.col("missing_side").isin("event", "source"), _own(rows, "ocel_event_id", "ocel_source_id")).otherwise(_own(rows, "ocel_object_id" if "ocel_object_id" in rows.columns else "ocel_target_id")) if "missing_side" in rows.columns else F.lit(None).cast("string")).alias("__wanted"),
        F.array(*[F.lit(t.ocel_type) for t in log.tables(side)]).cast("array<string>").alias("candidate_types"),
    )
    spine = detectors.known(getattr(log, side), "k").select(F.col("k_id").alias("anchor"), F.col("k_type").alias("__known"))
    out = out.join(spine, "anchor", "left").withColumn("anchor_type", F.coalesce("__said", "__known"))
    if side == "object" or issue == "missing_event":
        out = out.withColumn("__object", F.coalesce("__object", "anchor"))
        window = lifecycle_window(log, out.select(F.col("__object").alias("ocel_object_id"), F.col("__event").alias("excluded")), most)
        events = _listed(window, ["ocel_object_id", "excluded"], "events", "ocel_event_id", "ocel_type", "ocel_time", "ocel_qualifier")
        events = events.select(F.col("ocel_object_id").alias("__o"), F.col("excluded").alias("__x"), "events")
        out = out.join(events, (F.col("__object") == F.col("__o")) & F.col("__event").eqNullSafe(F.col("__x")), "left")
    if side == "event":
        anchors = out.select(F.col("anchor").alias("ocel_id"))
        objects = _listed(sampling.event_objects(log, anchors, most), ["ocel_event_id"], "objects", "ocel_object_id", "ocel_qualifier", "ocel_type")
        out = out.join(objects.withColumnRenamed("ocel_event_id", "anchor"), "anchor", "left")
    if issue.endswith(("_value", "_datatype", "_type", "_on_attributes")):
        out = out.join(_peers(log, side, out.select("anchor", "anchor_type").distinct(), k), "anchor", "left")
    if issue.startswith("dangling"):
        pool = (log.object if "o2o" in issue else log.object.unionByName(log.event)).select("row_id", "ocel_id")
        pools = prefix_pools(pool, out.select(F.col("__wanted").alias("wanted")))
        out = out.withColumn("__prefix", id_prefix(F.col("__wanted"))).join(pools.select(F.col("prefix").alias("__prefix"), F.col("pool").alias("candidates")), "__prefix", "left")
    if issue in ("missing_event_timestamp", "incorrect_event_time"):
        near = sampling.neighbour_window(log, out.select(F.col("anchor").alias("ocel_id")))
        near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("ocel_time", "neighbour"))).alias("neighbours"))
        out = out.join(near, "anchor", "left")
    if issue in ("missing_object_attribute", "missing_event_attribute"):
        columns = sampling.schema_candidates(log, side).select(F.col("ocel_type").alias("anchor_type"), F.col("columns").alias("__columns"))
        out = out.join(F.broadcast(columns), "anchor_type", "left").withColumn("columns", F.col("__columns"))
    empty = {"events": "array<string>", "objects": "array<string>", "peers": "array<string>", "candidates": "array<string>", "neighbours": "array<string>", "columns": "string"}
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in out.columns})
    return out.select("violation_id", "issue", "violation", "anchor", "anchor_type", "candidate_types", *empty)


def without_time(log: Log) -> DataFrame:
    """(ocel_id): events of which some table lacks the time."""
    return log.event_times().where(blank(F.col("ocel_time"))).select("ocel_id").distinct()
