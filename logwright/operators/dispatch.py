"""What belongs to an issue by its name: candidates to be judged, words for
them, the columns to point at, and whether an action can be carried out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.log import Log
from logwright.operators import detectors, sampling

#: The noun and the kind of the issues that are judged candidate by candidate.
JUDGED = {
    "incorrect_object_type": ("object", "object"),
    "incorrect_event_type": ("event", "event"),
    "incorrect_event_time": ("event time", "event"),
    "incorrect_attribute_value": ("attribute value", "object"),
    "incorrect_event_attribute_value": ("event attribute value", "event"),
    "missing_object_attribute": ("type schema", "object"),
    "missing_event_attribute": ("event type schema", "event"),
}
#: The columns in which an issue shows.
SHOWN = {
    "missing_event": ["ocel_event_id"],
    "missing_object": ["ocel_object_id"],
    "missing_event_timestamp": ["actual_value"],
    "duplicate_objects_on_ids": ["ocel_ids"],
    "duplicate_events_on_ids": ["ocel_ids"],
    "duplicate_objects_on_attributes": ["attribute_values"],
    "duplicate_events_on_attributes": ["attribute_values"],
    "duplicate_o2o_relations": ["count"],
    "duplicate_e2o_relations": ["count"],
    "o2o_self_loop": ["ocel_source_id", "ocel_target_id"],
    "incorrect_event_time": ["actual_value"],
}
_ENDS = {"dangling_o2o_relationship": ("source", "target"), "dangling_e2o_relationship": ("event", "object")}


def noun(issue: str) -> str:
    return JUDGED.get(issue, ("candidate", "object"))[0]


def kind(issue: str) -> str:
    return JUDGED.get(issue, ("candidate", "object"))[1]


def candidates(log: Log, issue: str, ocel_type: str) -> DataFrame:
    """What is to be judged of a type, in the order of ids; nothing for an
    issue that is not judged so."""
    side = kind(issue)
    if issue not in JUDGED:
        return log.spark.createDataFrame([], "ocel_id string")
    if issue == "incorrect_event_time":
        return sampling.time_candidates(log, ocel_type).orderBy("ocel_id", "ocel_time")
    if issue.endswith("_type"):
        return sampling.type_candidates(log, side, ocel_type).orderBy("ocel_id")
    if issue.endswith("_value"):
        return detectors.type_correct_cells(log, side, ocel_type).orderBy("ocel_id", "attribute", "actual_value")
    return sampling.schema_candidates(log, side).where(F.col("ocel_type") == ocel_type)


def shown_columns(issue: str) -> Column:
    """The names of the columns to point at in a violation's row."""
    if issue in _ENDS:
        ends = [F.when(F.col("missing_side").isin(end, "both"), f"ocel_{end}_id") for end in _ENDS[issue]]
        return F.array_compact(F.array(*ends))
    if issue in SHOWN:
        names = SHOWN[issue]
    elif issue.endswith("_type"):
        names = ["ocel_type"]
    elif issue.endswith(("_object_attribute", "_event_attribute")):
        names = ["attribute"]
    else:
        names = ["actual_value"]
    return F.array(*map(F.lit, names))


def routable(actions: DataFrame) -> DataFrame:
    """``actions`` (kind, table, key, column) with routable: an insertion needs
    rows, a new column a table and a name, a deletion rows of a table, anything
    else all three."""
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    keyed = F.coalesce(F.size("key") > 0, F.lit(False))
    where = F.when(F.col("kind") == "insert", keyed).when(F.col("kind") == "alter_add_column", said("table") & said("column"))
    where = where.when(F.col("kind").isin("delete", "delete_all"), said("table") & keyed).otherwise(said("table") & said("column") & keyed)
    return actions.withColumn("routable", where)
