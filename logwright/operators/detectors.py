"""The eighteen rule detectors, and the cells that pass them.

Each takes a log and returns violations, all columns as strings, tagged with
the issue. Equi-joins only meet deduplicated sides; whether a side is
broadcast is left to adaptive execution, which sees sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.functions.values import as_text, blank, is_missing, matches_declared, python_repr, python_type
from logwright.log import Log, TypeTable


def _out(df: DataFrame, issue: str, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in columns.items()], F.lit(issue).alias("issue"))


def _no_type(df: DataFrame, issue: str) -> DataFrame:
    return _out(df.where(blank(F.col("ocel_type"))), issue, ocel_id="ocel_id", ocel_type="ocel_type")


def missing_object_type(log: Log) -> DataFrame:
    return _no_type(log.object, "missing_object_type")


def missing_event_type(log: Log) -> DataFrame:
    return _no_type(log.event, "missing_event_type")


def _missing_cells(log: Log, kind: str, issue: str) -> DataFrame:
    found = log.cells(kind).where("is_initial").where(is_missing(F.col("cell")))
    return _out(found, issue, **{f"{kind}_type": "ocel_type"}, ocel_id="ocel_id", attribute="attribute", actual_value=as_text(F.col("cell")))


def missing_attribute_value(log: Log) -> DataFrame:
    """Missing cells of initial rows; later rows record one change each."""
    return _missing_cells(log, "object", "missing_attribute_value")


def missing_event_attribute_value(log: Log) -> DataFrame:
    return _missing_cells(log, "event", "missing_event_attribute_value")


def _repeated_ids(df: DataFrame, issue: str) -> DataFrame:
    groups = df.groupBy("ocel_id").agg(F.array_join(F.array_sort(F.collect_set("ocel_type")), ", ").alias("types"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _out(groups, issue, ocel_id="ocel_id", ocel_types="types", count="n")


def duplicate_objects_on_ids(log: Log) -> DataFrame:
    """Ids of several rows; null ids are one group, null types are left out."""
    return _repeated_ids(log.object, "duplicate_objects_on_ids")


def duplicate_events_on_ids(log: Log) -> DataFrame:
    return _repeated_ids(log.event, "duplicate_events_on_ids")


def _number(c: Column) -> Column:
    """A cell's number as text, alike for an integer and a whole real."""
    whole = (c["d"] == F.floor(c["d"])) & (F.abs(c["d"]) < 2.0**63)
    return F.coalesce(c["i"].cast("string"), F.when(whole, c["d"].cast("long").cast("string")).otherwise(c["d"].cast("string")))


def _attribute_keys(t: TypeTable) -> list[Column]:
    """What rows of a type are compared by; a cell's numbers compare by value,
    whatever their storage."""
    kinds, out = dict(t.df.dtypes), []
    for i, a in enumerate(t.attributes):
        c = F.col(f"`{a}`")
        out += [_number(c).alias(f"k{i}n"), c["s"].alias(f"k{i}s"), c["b"].alias(f"k{i}b")] if kinds[a].startswith("struct") else [c.alias(f"k{i}")]
    return out


def _same_attributes(log: Log, kind: str, issue: str, distinct_ids: bool) -> DataFrame:
    parts = []
    for t in log.tables(kind):
        if not t.attributes:
            continue
        flat = _attribute_keys(t)
        members = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "ocel_id"))), lambda x: F.coalesce(x["ocel_id"], F.lit("None")))
        if distinct_ids:
            members = F.array_distinct(members)
        groups = t.df.select("row_id", "ocel_id", *flat, F.to_json(F.struct(*[F.col(f"`{a}`") for a in t.attributes])).alias("values"))
        names = [c for c in groups.columns if c not in ("row_id", "ocel_id", "values")]
        repeated = groups.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # only rows of repeated groups are listed
        same = reduce(lambda x, y: x & y, [F.col(f"g.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names])
        listed = groups.alias("g").join(repeated.alias("r"), same).select("g.*").groupBy(*names).agg(members.alias("ids"), F.first("values").alias("values"))
        parts.append(_out(listed.where(F.size("ids") > 1), issue, **{f"{kind}_type": F.lit(t.ocel_type)}, ocel_ids=F.array_join("ids", ", "), duplicate_count=F.size("ids"), attribute_values="values"))
    empty = log.spark.createDataFrame([], f"{kind}_type string, ocel_ids string, duplicate_count string, attribute_values string, issue string")
    return reduce(DataFrame.unionByName, parts, empty)


def duplicate_objects_on_attributes(log: Log, distinct_ids: bool = False) -> DataFrame:
    """Rows of a type with equal attributes, ids in row order; rows of changes
    count, and an id may repeat unless ``distinct_ids``."""
    return _same_attributes(log, "object", "duplicate_objects_on_attributes", distinct_ids)


def duplicate_events_on_attributes(log: Log, distinct_ids: bool = False) -> DataFrame:
    """The same for events; their time is no attribute."""
    return _same_attributes(log, "event", "duplicate_events_on_attributes", distinct_ids)


def _repeated_triples(df: DataFrame, names: list[str], issue: str) -> DataFrame:
    return _out(df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), issue, **{n: n for n in names}, count="n")


def duplicate_o2o_relations(log: Log) -> DataFrame:
    """Triples of several rows; nulls are equal."""
    return _repeated_triples(log.o2o, ["ocel_source_id", "ocel_target_id", "ocel_qualifier"], "duplicate_o2o_relations")


def duplicate_e2o_relations(log: Log) -> DataFrame:
    return _repeated_triples(log.e2o, ["ocel_event_id", "ocel_object_id", "ocel_qualifier"], "duplicate_e2o_relations")


def o2o_self_loop(log: Log) -> DataFrame:
    return _out(log.o2o.where("ocel_source_id = ocel_target_id"), "o2o_self_loop", ocel_source_id="ocel_source_id", ocel_target_id="ocel_target_id", ocel_qualifier="ocel_qualifier")


def _incorrect_types(log: Log, kind: str, issue: str) -> DataFrame:
    c = F.col("cell")
    found = log.cells(kind).where(~is_missing(c) & ~matches_declared(c["storage"], F.col("declared")))
    return _out(found, issue, **{f"{kind}_type": "ocel_type"}, ocel_id="ocel_id", attribute="attribute", expected_type="declared", actual_value=python_repr(c), actual_python_type=python_type(c["storage"]))


def incorrect_attribute_datatype(log: Log) -> DataFrame:
    """Cells, of changes too, whose storage the declared type does not allow."""
    return _incorrect_types(log, "object", "incorrect_attribute_datatype")


def incorrect_event_attribute_datatype(log: Log) -> DataFrame:
    return _incorrect_types(log, "event", "incorrect_event_attribute_datatype")


def known(df: DataFrame, prefix: str) -> DataFrame:
    """One row per id, with the least type of several and a mark that tells an
    absent row from one without a type."""
    return df.where("ocel_id is not null").groupBy(F.col("ocel_id").alias(f"{prefix}_id")).agg(F.min("ocel_type").alias(f"{prefix}_type"), F.lit(True).alias(f"{prefix}_known"))


def _dangling(relations: DataFrame, a: DataFrame, b: DataFrame, left: tuple[str, str], right: tuple[str, str], issue: str) -> DataFrame:
    (side_a, col_a), (side_b, col_b) = left, right
    joined = relations.join(known(a, "a"), F.col(col_a) == F.col("a_id"), "left").join(known(b, "b"), F.col(col_b) == F.col("b_id"), "left")
    gone_a, gone_b = F.col("a_known").isNull(), F.col("b_known").isNull()
    side = F.when(gone_a & gone_b, "both").when(gone_a, side_a).when(gone_b, side_b)
    return _out(joined.where(gone_a | gone_b), issue, **{col_a: col_a, f"{side_a}_type": "a_type", col_b: col_b, f"{side_b}_type": "b_type"}, ocel_qualifier="ocel_qualifier", missing_side=side)


def dangling_o2o_relationship(log: Log) -> DataFrame:
    """Relations with an end, also a null one, that is no object."""
    return _dangling(log.o2o, log.object, log.object, ("source", "ocel_source_id"), ("target", "ocel_target_id"), "dangling_o2o_relationship")


def dangling_e2o_relationship(log: Log) -> DataFrame:
    return _dangling(log.e2o, log.event, log.object, ("event", "ocel_event_id"), ("object", "ocel_object_id"), "dangling_e2o_relationship")


def missing_event_timestamp(log: Log) -> DataFrame:
    found = log.event_times().where(blank(F.col("ocel_time")))
    return _out(found, "missing_event_timestamp", ocel_id="ocel_id", event_type="ocel_type", target_table="table", actual_value="ocel_time")


def missing_event(log: Log) -> DataFrame:
    """Relations of an event, not null, that is no event; a row for each."""
    there = log.event.select(F.col("ocel_id").alias("ocel_event_id")).where("ocel_event_id is not null").distinct()
    found = log.e2o.where("ocel_event_id is not null").join(there, "ocel_event_id", "left_anti")
    return _out(found, "missing_event", ocel_event_id="ocel_event_id", ocel_object_id="ocel_object_id", ocel_qualifier="ocel_qualifier")


def qualifier_types(log: Log) -> DataFrame:
    """(qualifier, q_type): singular and plural forms of type names; where
    forms meet, the later type of the map wins."""
    forms: dict[str, str] = {}
    for t in log.object_tables:
        single = t.ocel_type[:-1] if t.ocel_type.endswith("s") else t.ocel_type
        forms[single] = t.ocel_type
        forms[t.ocel_type] = t.ocel_type
    return log.spark.createDataFrame(list(forms.items()), "qualifier string, q_type string")


def _prefix_type(log: Log) -> Column:
    """The first type of the map that the object's id has as a prefix."""
    prefix = F.lit(None).cast("string")
    for t in reversed(log.object_tables):
        prefix = F.when(F.col("ocel_object_id").startswith(f"{t.ocel_type}:"), t.ocel_type).otherwise(prefix)
    return prefix


def missing_object(log: Log) -> DataFrame:
    """Relations of an unknown object whose type can be told: by the first
    type of the map that the id has as a prefix, else by the qualifier."""
    there = log.object.select(F.col("ocel_id").alias("ocel_object_id")).where("ocel_object_id is not null").distinct()
    gone = log.e2o.where("ocel_object_id is not null").join(there, "ocel_object_id", "left_anti")
    told = gone.withColumn("p_type", _prefix_type(log)).join(F.broadcast(qualifier_types(log)), F.col("ocel_qualifier") == F.col("qualifier"), "left")
    told = told.withColumn("inferred", F.coalesce("p_type", "q_type")).where("inferred is not null")
    return _out(told, "missing_object", ocel_object_id="ocel_object_id", inferred_type_from_prefix="inferred", ocel_event_id="ocel_event_id", ocel_qualifier="ocel_qualifier")


DETECTORS: dict[str, Callable[[Log], DataFrame]] = {
    f.__name__: f
    for f in (
        missing_object_type,
        missing_attribute_value,
        missing_event_attribute_value,
        duplicate_objects_on_ids,
        duplicate_objects_on_attributes,
        duplicate_events_on_ids,
        duplicate_events_on_attributes,
        duplicate_o2o_relations,
        o2o_self_loop,
        duplicate_e2o_relations,
        incorrect_attribute_datatype,
        incorrect_event_attribute_datatype,
        dangling_o2o_relationship,
        dangling_e2o_relationship,
        missing_event_timestamp,
        missing_event,
        missing_event_type,
        missing_object,
    )
}


def detect_all(log: Log) -> dict[str, DataFrame]:
    return {name: detector(log) for name, detector in DETECTORS.items()}


def _sums(df: DataFrame, **issues: Column) -> DataFrame:
    """(issue, n): how many rows hold each condition, in one pass."""
    return _rows(df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in issues.items()]))


def _rows(one: DataFrame) -> DataFrame:
    """(issue, n): a row for each column of the only row."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n in one.columns])))


def issue_counts(log: Log) -> DataFrame:
    """(issue, n) for all detectors, in one job. Detectors that read the same
    table share one pass over it, one grouping, or one join."""
    parts, cell, n = [], F.col("cell"), F.col("n")
    for kind, prefix in (("object", ""), ("event", "event_")):
        ids = getattr(log, kind).groupBy("ocel_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank(F.col("ocel_type"))).alias("untyped"))
        parts.append(_rows(ids.agg(F.count_if(n > 1).alias(f"duplicate_{kind}s_on_ids"), F.coalesce(F.sum("untyped"), F.lit(0)).alias(f"missing_{kind}_type"))))
        wrong = ~is_missing(cell) & ~matches_declared(cell["storage"], F.col("declared"))
        parts.append(_sums(log.cells(kind), **{f"missing_{prefix}attribute_value": F.col("is_initial") & is_missing(cell), f"incorrect_{prefix}attribute_datatype": wrong}))
        same = [t.df.groupBy(*_attribute_keys(t)).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(n > 1).alias("n")) for t in log.tables(kind) if t.attributes]
        none = log.spark.createDataFrame([(0,)], "n long")
        parts.append(reduce(DataFrame.unionAll, same, none).agg(F.sum("n").alias("n")).select(F.lit(f"duplicate_{kind}s_on_attributes").alias("issue"), "n"))
    triples = log.o2o.groupBy("ocel_source_id", "ocel_target_id", "ocel_qualifier").agg(F.count(F.lit(1)).alias("n"))
    loops = F.coalesce(F.sum(F.when(F.col("ocel_source_id") == F.col("ocel_target_id"), n)), F.lit(0))
    parts.append(_rows(triples.agg(F.count_if(n > 1).alias("duplicate_o2o_relations"), loops.alias("o2o_self_loop"))))
    parts.append(_sums(log.e2o.groupBy("ocel_event_id", "ocel_object_id", "ocel_qualifier").agg(F.count(F.lit(1)).alias("n")), duplicate_e2o_relations=n > 1))
    objects = known(log.object, "b").select("b_id", "b_known")
    ends = log.o2o.join(objects.select(F.col("b_id").alias("a_id"), F.col("b_known").alias("a_known")), F.col("ocel_source_id") == F.col("a_id"), "left").join(objects, F.col("ocel_target_id") == F.col("b_id"), "left")
    gone_a, gone_b = F.col("a_known").isNull(), F.col("b_known").isNull()
    parts.append(_sums(ends, dangling_o2o_relationship=gone_a | gone_b))
    ends = log.e2o.join(known(log.event, "a").select("a_id", "a_known"), F.col("ocel_event_id") == F.col("a_id"), "left").join(objects, F.col("ocel_object_id") == F.col("b_id"), "left")
    told = ends.join(F.broadcast(qualifier_types(log)), F.col("ocel_qualifier") == F.col("qualifier"), "left")
    typed = F.coalesce(_prefix_type(log), F.col("q_type")).isNotNull()
    parts.append(_sums(told, dangling_e2o_relationship=gone_a | gone_b, missing_event=gone_a & F.col("ocel_event_id").isNotNull(), missing_object=gone_b & F.col("ocel_object_id").isNotNull() & typed))
    parts.append(_sums(log.event_times(), missing_event_timestamp=blank(F.col("ocel_time"))))
    return reduce(DataFrame.unionAll, parts)


def type_correct_cells(log: Log, kind: str, ocel_type: str | None = None) -> DataFrame:
    """Cells that are neither missing nor of a wrong type; candidates for a
    check of their values."""
    c = F.col("cell")
    found = log.cells(kind, ocel_type).where(~is_missing(c) & matches_declared(c["storage"], F.col("declared")))
    return _out(found, f"incorrect_{'event_' if kind == 'event' else ''}attribute_value", **{f"{kind}_type": "ocel_type"}, ocel_id="ocel_id", attribute="attribute", expected_type="declared", actual_value=as_text(c))


#: The overview's rows and columns and the detectors in each cell.
GRID = [
    ("object", "type", ["missing_object_type"]),
    ("object", "attribute value", ["missing_attribute_value"]),
    ("object", "attribute datatype", ["incorrect_attribute_datatype"]),
    ("object", "duplicates", ["duplicate_objects_on_ids", "duplicate_objects_on_attributes"]),
    ("object", "missing entity", ["missing_object"]),
    ("event", "type", ["missing_event_type"]),
    ("event", "timestamp", ["missing_event_timestamp"]),
    ("event", "attribute value", ["missing_event_attribute_value"]),
    ("event", "attribute datatype", ["incorrect_event_attribute_datatype"]),
    ("event", "duplicates", ["duplicate_events_on_ids", "duplicate_events_on_attributes"]),
    ("event", "missing entity", ["missing_event"]),
    ("relation", "duplicates", ["duplicate_o2o_relations", "duplicate_e2o_relations"]),
    ("relation", "dangling", ["dangling_o2o_relationship", "dangling_e2o_relationship"]),
    ("relation", "self loop", ["o2o_self_loop"]),
]


def issue_grid(log: Log) -> DataFrame:
    """(entity, category, n): detector counts rolled up to the overview."""
    cells = log.spark.createDataFrame([(e, c, d) for e, c, ds in GRID for d in ds], "entity string, category string, issue string")
    return issue_counts(log).join(F.broadcast(cells), "issue").groupBy("entity", "category").agg(F.sum("n").alias("n"))
