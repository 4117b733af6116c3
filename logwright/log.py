"""An object-centric event log as a version of DataFrames.

``object`` and ``event`` have (row_id, ocel_id, ocel_type), relations have
(row_id, ...), and each type has a table (row_id, ocel_id, ocel_time,
ocel_changed_field for objects, attributes). row_id is kept from ingestion.
Attributes are of any Spark type, or cells where values differ in storage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwright.functions.values import cell

#: Columns of type tables that are no attributes.
RESERVED = {"ocel_id", "ocel:timestamp", "ocel:activity", "ocel_type", "ocel_time", "ocel_changed_field", "new_value", "row_id"}


@dataclass(frozen=True)
class TypeTable:
    ocel_type: str
    table: str
    df: DataFrame
    declared: dict[str, str]

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c not in RESERVED]


@dataclass(frozen=True)
class Log:
    spark: SparkSession
    object: DataFrame
    event: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    object_tables: tuple[TypeTable, ...] = ()
    event_tables: tuple[TypeTable, ...] = ()

    def with_(self, **parts) -> Log:
        """A new version with some parts replaced."""
        return replace(self, **parts)

    def tables(self, kind: str) -> tuple[TypeTable, ...]:
        return self.object_tables if kind == "object" else self.event_tables

    def type_names(self, kind: str) -> DataFrame:
        """(ordinal, ocel_type, table): the types in the order of the map."""
        rows = [(i, t.ocel_type, t.table) for i, t in enumerate(self.tables(kind))]
        return self.spark.createDataFrame(rows, "ordinal int, ocel_type string, table string")

    def cells(self, kind: str, ocel_type: str | None = None) -> DataFrame:
        """(ocel_type, row_id, ocel_id, is_initial, attribute, declared, cell):
        every attribute value, from one scan of each type table."""
        parts = []
        for t in self.tables(kind):
            if not t.attributes or ocel_type not in (None, t.ocel_type):
                continue
            kinds = {f.name: f.dataType for f in t.df.schema}
            every = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(t.declared.get(a, "")).alias("declared"), cell(F.col(f"`{a}`"), kinds[a]).alias("cell")) for a in t.attributes])
            initial = F.col("ocel_changed_field").isNull() if "ocel_changed_field" in t.df.columns else F.lit(True)
            parts.append(t.df.select(F.lit(t.ocel_type).alias("ocel_type"), "row_id", "ocel_id", initial.alias("is_initial"), F.inline(every)))
        if not parts:
            return self.spark.createDataFrame([], "ocel_type string, row_id long, ocel_id string, is_initial boolean, attribute string, declared string, cell struct<storage:string,i:bigint,d:double,s:string,b:binary>")
        return reduce(DataFrame.unionByName, parts)

    def event_times(self) -> DataFrame:
        """(ordinal, table, row_id, ocel_id, ocel_type, ocel_time) of all event tables with times."""
        parts = [t.df.select(F.lit(i).alias("ordinal"), F.lit(t.table).alias("table"), "row_id", "ocel_id", F.lit(t.ocel_type).alias("ocel_type"), "ocel_time") for i, t in enumerate(self.event_tables) if "ocel_time" in t.df.columns]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "ordinal int, table string, row_id long, ocel_id string, ocel_type string, ocel_time string")
