"""Scores of repairs against planted truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.functions.values import relative_error, same_text
from logwright.log import Log
from logwright.operators import repair, sampling

TOLERANCE = 0.10


def plant(log: Log, table: str, column: str, n: int) -> tuple[Log, DataFrame]:
    """A version with ``n`` evenly spaced initial values set to null, and the
    truth (table, column, ocel_id, true_value)."""
    df = repair.frame(log, table)
    rows = df.where(F.col(f"`{column}`").isNotNull())
    rows = rows.where("ocel_changed_field is null") if "ocel_changed_field" in df.columns else rows
    chosen = sampling.systematic_sample(rows, n)
    truth = chosen.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "ocel_id", F.col(f"`{column}`").cast("string").alias("true_value"), "row_id")
    marks = F.broadcast(truth.select(F.col("row_id").alias("__r")))
    hidden = df.join(marks, F.col("row_id") == F.col("__r"), "left").withColumn(column, F.when(F.col("__r").isNull(), F.col(f"`{column}`"))).drop("__r")
    return repair.with_frame(log, table, hidden), truth.drop("row_id")


def match_violations(violations: DataFrame, truth: DataFrame) -> DataFrame:
    """Violations that were planted, by type, id and attribute."""
    return violations.join(truth, ["object_type", "ocel_id", "attribute"], "left_semi")


def score(proposals: DataFrame) -> DataFrame:
    """Proposals (proposed, true_value among others) with exact, within_tol and rel_err."""
    error = relative_error(F.col("proposed"), F.col("true_value"))
    text = F.coalesce(same_text(F.col("proposed"), F.col("true_value")), F.lit(False))
    return proposals.withColumn("rel_err", error).withColumns({"exact": F.when(F.col("rel_err").isNotNull(), F.col("rel_err") == 0).otherwise(text), "within_tol": F.when(F.col("rel_err").isNotNull(), F.col("rel_err") <= TOLERANCE).otherwise(text)})


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """Per group: n, answered, exact, within_tol, mean relative error of
    finite errors, mean confidence, errors."""
    finite = F.when(F.col("rel_err") < float("inf"), F.col("rel_err"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("proposed").isNotNull()).alias("answered"),
        F.count_if("exact").alias("exact"),
        F.count_if("within_tol").alias("within_tol"),
        F.avg(finite).alias("mean_rel_err"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )


def side_by_side(scored: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Each row of one arm beside the other arm's for the same cell."""
    keys = ["ocel_id", "attribute"]
    a, b = (scored.where(F.col("arm") == arm).select(*keys, F.col("proposed").alias(f"{n}_proposed"), F.col("exact").alias(f"{n}_exact")) for n, arm in (("a", arm_a), ("b", arm_b)))
    return a.join(b, keys, "left")


def across_runs(spark, pattern: str) -> DataFrame:  # noqa: ANN001
    """Hits by run and arm, a column for each attribute, over archived results
    (JSON lines of scored rows, a folder for each run); unreadable lines are
    skipped."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(pattern).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.groupBy("run", "arm").pivot("attribute").agg(F.count_if(F.col("exact") | F.col("within_tol")))
