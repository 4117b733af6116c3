"""Logs in SQLite files, read in parallel by ranges of rowid, each value with
the storage class it has in the file."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logwright.functions.values import CELL
from logwright.log import RESERVED, Log, TypeTable
from logwright.session import ship


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options["dbtable"]
        self.columns = options["columns"].split("\x1f")
        self.parts = int(options.get("partitions", "8"))

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = (high - low) // self.parts + 1
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range):  # noqa: ANN201
        parts = ", ".join(f"typeof({quoted(c)}), {quoted(c)}" for c in self.columns)
        with _open(self.path) as db:
            db.text_factory = lambda data: data.decode("utf-8", "replace")
            for row in db.execute(f"SELECT rowid, {parts} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.low, partition.high)):
                cells = []
                for storage, value in zip(row[1::2], row[2::2]):
                    cells.append((None if storage == "null" else storage, value if storage == "integer" else None, value if storage == "real" else None, value if storage == "text" else None, value if storage == "blob" else None))
                yield (row[0], *cells)


class SqliteTable(DataSource):
    """format("sqlite_cells") with options path, dbtable, columns, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_cells"

    def schema(self) -> str:
        return "row_id bigint, " + ", ".join(f"`{c}` {CELL}" for c in self.options["columns"].split("\x1f"))

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, text: tuple[str, ...] = (), partitions: int = 8) -> DataFrame:
    """A table as cells with its rowids; columns in ``text`` as strings."""
    ship(spark).dataSource.register(SqliteTable)
    with _open(path) as db:
        columns = [r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
    df = spark.read.format("sqlite_cells").options(path=path, dbtable=table, columns="\x1f".join(columns), partitions=str(partitions)).load()
    string = lambda c: F.coalesce(F.col(f"`{c}`.s"), F.col(f"`{c}`.i").cast("string"), F.col(f"`{c}`.d").cast("string"))
    return df.select("row_id", *[string(c).alias(c) if c in text else F.col(f"`{c}`") for c in columns])


def open_log(spark: SparkSession, path: str, partitions: int = 8) -> Log:
    """The log in a SQLite file; types in the order of the map tables. The
    file must be readable under the same path on every executor."""
    with _open(path) as db:

        def types(kind: str) -> list[tuple]:
            return db.execute(f"SELECT ocel_type, ocel_type_map FROM {kind}_map_type ORDER BY rowid").fetchall()

        maps = {k: types(k) for k in ("object", "event")}
        declared = {f"{k}_{m}": {r[1]: r[2] for r in db.execute(f"PRAGMA table_info({quoted(f'{k}_{m}')})")} for k in maps for _, m in maps[k]}

    def sub(kind: str) -> tuple[TypeTable, ...]:
        found = []
        for ocel_type, name in maps[kind]:
            table = f"{kind}_{name}"
            if declared[table]:
                own = {c: d for c, d in declared[table].items() if c not in RESERVED}
                found.append(TypeTable(ocel_type, table, read_table(spark, path, table, tuple(c for c in declared[table] if c in RESERVED), partitions), own))
        return tuple(found)

    spine = lambda table, *columns: read_table(spark, path, table, columns, partitions).select("row_id", *columns)
    return Log(
        spark,
        spine("object", "ocel_id", "ocel_type"),
        spine("event", "ocel_id", "ocel_type"),
        spine("event_object", "ocel_event_id", "ocel_object_id", "ocel_qualifier"),
        spine("object_object", "ocel_source_id", "ocel_target_id", "ocel_qualifier"),
        sub("object"),
        sub("event"),
    )
