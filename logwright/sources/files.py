"""Logs as Parquet folders, and reports as JSON or Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from logwright.log import Log, TypeTable


def write_log(log: Log, folder: str) -> None:
    """A folder per table, and a catalog of types in the order of the map."""
    for name in ("object", "event", "e2o", "o2o"):
        getattr(log, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = []
    for kind in ("object", "event"):
        for i, t in enumerate(log.tables(kind)):
            t.df.write.mode("overwrite").parquet(f"{folder}/{t.table}")
            rows.append((kind, i, t.ocel_type, t.table, json.dumps(t.declared)))
    log.spark.createDataFrame(rows, "kind string, ordinal int, ocel_type string, table string, declared string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/catalog")


def read_log(spark: SparkSession, folder: str) -> Log:
    rows = spark.read.parquet(f"{folder}/catalog").orderBy("kind", "ordinal").collect()
    sub = {k: tuple(TypeTable(r["ocel_type"], r["table"], spark.read.parquet(f"{folder}/{r['table']}"), json.loads(r["declared"])) for r in rows if r["kind"] == k) for k in ("object", "event")}
    return Log(spark, *(spark.read.parquet(f"{folder}/{n}") for n in ("object", "event", "e2o", "o2o")), sub["object"], sub["event"])


def save_json(path: str, value: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, ensure_ascii=False, default=str)


def load_json(path: str) -> dict | None:
    """None if the file is not there or no JSON."""
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return None


def find_logs(folder: str, ending: str = ".sqlite") -> list[str]:
    return sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(ending))


def markdown(title: str, df: DataFrame, most: int = 50) -> str:
    """A small result, or the first rows of a larger one, as a table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def page(df: DataFrame, number: int, size: int = 25, order: str = "ocel_id") -> DataFrame:
    """One page of a result, counted from 1; numbers beyond the ends are
    moved to them."""
    last = max(1, -(-df.count() // size))
    number = min(max(1, number), last)
    return df.orderBy(order).offset((number - 1) * size).limit(size)
