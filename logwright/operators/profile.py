"""Deterministic profile of a log: types, columns, ids and qualifiers."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwright.functions.values import NAME_LIKE, as_text, classify_id, id_template
from logwright.log import Log


def type_histogram(log: Log, kind: str) -> DataFrame:
    """(ocel_type, n), null type included."""
    return getattr(log, kind).groupBy("ocel_type").agg(F.count(F.lit(1)).alias("n"))


def qualifier_histogram(log: Log) -> DataFrame:
    parts = [df.groupBy(F.col("ocel_qualifier").alias("qualifier")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("relation"), "qualifier", "n") for r, df in (("e2o", log.e2o), ("o2o", log.o2o))]
    return parts[0].unionAll(parts[1])


def qualifier_by_type(log: Log, kind: str) -> DataFrame:
    """(qualifier, ocel_type, n) of E2O relations by the type of one end;
    dangling ends drop out, repeated ids count each time, null keys drop."""
    side = getattr(log, kind).select("ocel_id", "ocel_type")
    joined = log.e2o.join(side, F.col(f"ocel_{kind}_id") == F.col("ocel_id"))
    return joined.groupBy(F.col("ocel_qualifier").alias("qualifier"), "ocel_type").agg(F.count(F.lit(1)).alias("n")).na.drop(subset=["qualifier", "ocel_type"])


def o2o_type_pairs(log: Log) -> DataFrame:
    """(qualifier, pair, n): O2O relations by "source type -> target type"."""
    a, b = (log.object.select(F.col("ocel_id").alias(f"{x}_id"), F.col("ocel_type").alias(f"{x}_type")) for x in "ab")
    joined = log.o2o.join(a, F.col("ocel_source_id") == F.col("a_id")).join(b, F.col("ocel_target_id") == F.col("b_id"))
    pair = F.concat("a_type", F.lit(" -> "), "b_type")
    return joined.groupBy(F.col("ocel_qualifier").alias("qualifier"), pair.alias("pair")).agg(F.count(F.lit(1)).alias("n")).na.drop(subset=["qualifier", "pair"])


def qualifier_outliers(log: Log, share: float = 0.8, examples: int = 50) -> DataFrame:
    """(qualifier, ocel_type, n, total, dominant_type, object_id): objects of
    other types under a qualifier that one type dominates by ``share`` or
    more; up to ``examples`` ids of each, in order."""
    by = qualifier_by_type(log, "object")
    q = Window.partitionBy("qualifier")
    ranked = by.withColumns({"total": F.sum("n").over(q), "top": F.max("n").over(q), "dominant_type": F.first("ocel_type").over(q.orderBy(F.desc("n"), "ocel_type"))})
    odd = ranked.where((F.col("top") >= share * F.col("total")) & (F.col("ocel_type") != F.col("dominant_type")))
    objects = log.object.select("ocel_id", F.col("ocel_type").alias("t"))
    named = log.e2o.join(objects, F.col("ocel_object_id") == F.col("ocel_id")).select(F.col("ocel_qualifier").alias("q"), "t", "ocel_object_id")
    ids = odd.join(named, (F.col("q") == F.col("qualifier")) & (F.col("t") == F.col("ocel_type"))).select("qualifier", "ocel_type", "n", "total", "dominant_type", F.col("ocel_object_id").alias("object_id")).distinct()
    first = F.row_number().over(Window.partitionBy("qualifier", "ocel_type").orderBy("object_id"))
    return ids.withColumn("k", first).where(F.col("k") <= examples).drop("k")


def _ids_per_type(log: Log, kind: str) -> DataFrame:
    return getattr(log, kind).where("ocel_id is not null and ocel_type is not null").select("ocel_type", "ocel_id").distinct()


def id_buckets(log: Log, kind: str = "object") -> DataFrame:
    """(ocel_type, shape, n): shapes of all distinct ids of each type."""
    return _ids_per_type(log, kind).groupBy("ocel_type", classify_id(F.col("ocel_id")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def id_examples(log: Log, kind: str = "object", most: int = 8) -> DataFrame:
    """(ocel_type, shape, example): the first ids of each shape."""
    shaped = _ids_per_type(log, kind).withColumn("shape", classify_id(F.col("ocel_id")))
    first = F.row_number().over(Window.partitionBy("ocel_type", "shape").orderBy("ocel_id"))
    return shaped.withColumn("k", first).where(F.col("k") <= most).select("ocel_type", "shape", F.col("ocel_id").alias("example"))


def id_templates(log: Log, kind: str = "object", most: int = 3) -> DataFrame:
    """(ocel_type, template, n, total): the most frequent digit templates."""
    counts = _ids_per_type(log, kind).groupBy("ocel_type", id_template(F.col("ocel_id")).alias("template")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ocel_type")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.desc("n"), "template"))})
    return ranked.where(F.col("k") <= most).drop("k")


def name_like_types(log: Log, kind: str = "object", least: float = 0.5) -> DataFrame:
    """(ocel_type, name_like): whether names or prose make up half the ids."""
    named = F.sum(F.when(F.col("shape").isin(NAME_LIKE), F.col("n")).otherwise(0))
    return id_buckets(log, kind).groupBy("ocel_type").agg((named >= least * F.sum("n")).alias("name_like"))


def column_profile(log: Log, kind: str) -> DataFrame:
    """(ocel_type, attribute, n, n_null): one pass over each type table."""
    cells = log.cells(kind)
    return cells.groupBy("ocel_type", "attribute").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell.storage").isNull()).alias("n_null"))


def column_samples(log: Log, kind: str, most: int = 15, vocabulary: int = 10) -> DataFrame:
    """(ocel_type, attribute, samples, is_vocabulary): first distinct values;
    a vocabulary if there are at most ``vocabulary``, all texts."""
    values = log.cells(kind).where("cell.storage is not null").select("ocel_type", "attribute", F.col("cell.storage").alias("storage"), as_text(F.col("cell")).alias("value")).distinct()
    w = Window.partitionBy("ocel_type", "attribute")
    first = values.withColumn("k", F.row_number().over(w.orderBy("value", "storage"))).where(F.col("k") <= most)
    samples = F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"])
    return first.groupBy("ocel_type", "attribute").agg(samples.alias("samples"), ((F.max("k") <= vocabulary) & F.every(F.col("storage") == "text")).alias("is_vocabulary"))


def schema_fingerprint(log: Log) -> str:
    """Sixteen hex digits over tables, columns, types and qualifiers."""
    names = sorted(f"{t.table}({', '.join(sorted(t.df.columns))})" for k in ("object", "event") for t in log.tables(k))
    parts = [log.object.select(F.lit("o"), "ocel_type"), log.event.select(F.lit("e"), "ocel_type"), log.e2o.select(F.lit("eq"), "ocel_qualifier"), log.o2o.select(F.lit("oq"), "ocel_qualifier")]
    found = sorted(f"{r[0]}:{r[1]}" for r in reduce(DataFrame.unionAll, [p.distinct() for p in parts]).collect())
    return hashlib.sha256("\n".join(names + found).encode()).hexdigest()[:16]


def profile(log: Log) -> dict:
    """The whole profile as a dictionary fit for JSON."""

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    columns = {}
    for kind in ("object", "event"):
        for r in rows(column_profile(log, kind)):
            columns[f"{kind}/{r['ocel_type']}/{r['attribute']}"] = {"rows": r["n"], "null_rate": round(r["n_null"] / r["n"], 3) if r["n"] else None}
        for r in rows(column_samples(log, kind)):
            columns[f"{kind}/{r['ocel_type']}/{r['attribute']}"] |= {"samples": r["samples"], "vocabulary": r["samples"] if r["is_vocabulary"] else None}
    return {
        "fingerprint": schema_fingerprint(log),
        "types": {k: {r["ocel_type"]: r["n"] for r in rows(type_histogram(log, k))} for k in ("object", "event")},
        "qualifiers": rows(qualifier_histogram(log)),
        "columns": columns,
        "id_patterns": rows(id_buckets(log)),
        "id_templates": rows(id_templates(log)),
        "qualifier_context": {"object": rows(qualifier_by_type(log, "object")), "event": rows(qualifier_by_type(log, "event")), "o2o": rows(o2o_type_pairs(log))},
        "outliers": rows(qualifier_outliers(log)),
    }


def select_hints(found: dict, ocel_type: str, attribute: str | None = None) -> dict:
    """The facts of a profile that bear on one violation."""
    columns = {k: v for k, v in found["columns"].items() if k.split("/")[1] == ocel_type and attribute in (None, k.split("/")[2])}
    return {
        "columns": columns,
        "id_patterns": [r for r in found["id_patterns"] if r["ocel_type"] == ocel_type],
        "qualifiers": [r for r in found["qualifier_context"]["object"] if r["ocel_type"] == ocel_type],
    }


def hints_are_stale(found: dict, log: Log) -> bool:
    return found.get("fingerprint") != schema_fingerprint(log)
