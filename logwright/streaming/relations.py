"""Relation detectors over a stream of E2O rows, against a log at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.log import Log
from logwright.operators.detectors import known


def dangling(stream: DataFrame, log: Log) -> DataFrame:
    """New relations with an end that the log does not have."""
    joined = stream.join(known(log.event, "a"), F.col("ocel_event_id") == F.col("a_id"), "left").join(known(log.object, "b"), F.col("ocel_object_id") == F.col("b_id"), "left")
    gone_a, gone_b = F.col("a_known").isNull(), F.col("b_known").isNull()
    side = F.when(gone_a & gone_b, "both").when(gone_a, "event").when(gone_b, "object")
    return joined.where(gone_a | gone_b).select(*stream.columns, side.alias("missing_side"))


def repeated(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Triples seen again less than ``delay`` after they were last seen, with
    the window of the whole run. A stream's output mode is append."""
    names = ["ocel_event_id", "ocel_object_id", "ocel_qualifier"]
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, delay).alias("window"), *names).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
