"""Known corruption for tests: each injection changes a few rows, chosen by
row_id, and tells which; together by level they make a damaged log.

An injection is a value: an issue, a level, and a change with its
parameters. Changes run over any log that has the types they name; where it
has not, the injection does nothing and says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.log import Log
from logwright.operators import repair


@dataclass(frozen=True)
class Injection:
    issue: str
    level: str
    change: str
    how: dict


def _first(df: DataFrame, n: int = 1, skip: int = 0) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy("row_id").limit(n + skip).collect()[skip:]]


def _typed(log: Log, kind: str, ocel_type: str) -> DataFrame:
    return getattr(log, kind).where(F.col("ocel_type") == ocel_type)


def _sub(log: Log, kind: str, ocel_type: str):  # noqa: ANN202
    return next((t for t in log.tables(kind) if t.ocel_type == ocel_type), None)


def _set_type(log: Log, kind: str, ocel_type: str, value: str | None, skip: int = 0) -> tuple[Log, list] | None:
    rows = _first(_typed(log, kind, ocel_type), 1, skip)
    return rows and (_patch(log, kind, rows, "ocel_type", value), rows)


def _patch(log: Log, table: str, rows: list[dict], column: str, value: object) -> Log:
    df = repair.frame(log, table)
    kind = dict(df.dtypes)[column]
    hit = F.col("row_id").isin([r["row_id"] for r in rows])
    if value is None:
        new = F.lit(None).cast(kind)
    elif kind.startswith("struct") or kind != "string":
        # a value of another storage than the column's makes its cells explicit
        from logwright.functions.values import CELL, cell

        field = df.schema[column].dataType
        old = cell(F.col(f"`{column}`"), field)
        storage, at = {str: ("text", "s"), float: ("real", "d"), int: ("integer", "i"), bytes: ("blob", "b")}[type(value)]
        made = F.struct(F.lit(storage).alias("storage"), *[(F.lit(value) if a == at else F.lit(None)).cast(t).alias(a) for a, t in (("i", "bigint"), ("d", "double"), ("s", "string"), ("b", "binary"))]).cast(CELL)
        return repair.with_frame(log, table, df.withColumn(column, F.when(hit, made).otherwise(old)))
    elif isinstance(value, bytes):
        from logwright.functions.values import CELL, cell

        made = F.struct(F.lit("blob").alias("storage"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"), F.lit(value).alias("b")).cast(CELL)
        return repair.with_frame(log, table, df.withColumn(column, F.when(hit, made).otherwise(cell(F.col(f"`{column}`"), df.schema[column].dataType))))
    else:
        new = F.lit(value)
    return repair.with_frame(log, table, df.withColumn(column, F.when(hit, new).otherwise(F.col(f"`{column}`"))))


def _set_cell(log: Log, kind: str, ocel_type: str, column: str, value: object, count: int = 1, skip: int = 0) -> tuple[Log, list] | None:
    t = _sub(log, kind, ocel_type)
    if t is None or column not in t.df.columns:
        return None
    rows = t.df.where("ocel_changed_field is null") if "ocel_changed_field" in t.df.columns else t.df
    rows = _first(rows.where(F.col(f"`{column}`").isNotNull()), count, skip)
    return rows and (_patch(log, t.table, rows, column, value), rows)


def _repeat_row(log: Log, kind: str, ocel_type: str, types: tuple = (...,)) -> tuple[Log, list] | None:
    """Rows with the id of the first of a type; ... keeps its type."""
    rows = _first(_typed(log, kind, ocel_type))
    return rows and (repair.insert(log, kind, [{"ocel_id": rows[0]["ocel_id"], "ocel_type": rows[0]["ocel_type"] if t is ... else t} for t in types]), rows)


def _clone(log: Log, kind: str, ocel_type: str, suffix: str, relations: bool = False) -> tuple[Log, list] | None:
    """A new id with the attributes, and maybe the relations, of another."""
    t = _sub(log, kind, ocel_type)
    rows = _first(t.df.where("ocel_changed_field is null") if t is not None and "ocel_changed_field" in t.df.columns else t.df) if t is not None and t.attributes else []
    if not rows:
        return None
    old, new = rows[0]["ocel_id"], f"{rows[0]['ocel_id']}{suffix}"
    last = t.df.agg(F.max("row_id")).first()[0]
    copy = t.df.where(F.col("row_id") == rows[0]["row_id"]).withColumns({"ocel_id": F.lit(new), "row_id": F.lit(last + 1)})
    log = repair.with_frame(log, t.table, t.df.unionByName(copy))
    log = repair.insert(log, kind, [{"ocel_id": new, "ocel_type": ocel_type}])
    if relations:
        side = f"ocel_{kind}_id"
        found = [r.asDict() for r in log.e2o.where(F.col(side) == old).collect()]
        log = repair.insert(log, "event_object", [{k: v for k, v in r.items() if k != "row_id"} | {side: new} for r in found])
    return log, rows


def _lose(log: Log, kind: str, event_type: str, qualifier: str) -> tuple[Log, list] | None:
    """Delete an event, or the object at its other end, that a relation with
    this qualifier names."""
    events = _typed(log, "event", event_type).select(F.col("ocel_id").alias("ocel_event_id")).distinct()
    there = getattr(log, kind).select(F.col("ocel_id").alias(f"ocel_{kind}_id")).distinct()
    rows = log.e2o.where(F.col("ocel_qualifier") == qualifier).join(events, "ocel_event_id", "left_semi").join(there, f"ocel_{kind}_id", "left_semi")
    rows = _first(rows)
    return rows and (repair.delete_all(log, kind, {"ocel_id": rows[0][f"ocel_{kind}_id"]}), rows)


def _typo(log: Log, relation: str, qualifier: str | None, sides: tuple[str, ...]) -> tuple[Log, list] | None:
    """A relation like the first, with near misses of ids at some ends."""
    df = getattr(log, relation)
    rows = _first(df.where(F.col("ocel_qualifier") == qualifier) if qualifier else df)
    if not rows:
        return None
    new = {k: v for k, v in rows[0].items() if k != "row_id"} | {s: f"{rows[0][s]}-TYPO" for s in sides}
    return repair.insert(log, {"e2o": "event_object", "o2o": "object_object"}[relation], [new]), [new]


def _copies(log: Log, relation: str, qualifier: str, copies: int = 2) -> tuple[Log, list] | None:
    df = getattr(log, relation)
    rows = _first(df.where(F.col("ocel_qualifier") == qualifier))
    return rows and (repair.insert(log, {"e2o": "event_object", "o2o": "object_object"}[relation], [{k: v for k, v in rows[0].items() if k != "row_id"}] * copies), rows)


def _loop(log: Log, ocel_type: str, qualifier: str) -> tuple[Log, list] | None:
    rows = _first(_typed(log, "object", ocel_type))
    return rows and (repair.insert(log, "object_object", [{"ocel_source_id": rows[0]["ocel_id"], "ocel_target_id": rows[0]["ocel_id"], "ocel_qualifier": qualifier}]), rows)


def _retarget(log: Log, relation: str, qualifier: str, skip: int) -> tuple[Log, list] | None:
    """The first relation gets another object of its target's type."""
    table, side = {"e2o": ("event_object", "ocel_object_id"), "o2o": ("object_object", "ocel_target_id")}[relation]
    rows = _first(getattr(log, relation).where(F.col("ocel_qualifier") == qualifier))
    own = rows and log.object.where(F.col("ocel_id") == rows[0][side]).select("ocel_type").first()
    if not own:
        return None
    others = _first(log.object.where((F.col("ocel_type") == own[0]) & (F.col("ocel_id") != rows[0][side])), 1, skip)
    return others and (_patch(log, table, rows, side, others[0]["ocel_id"]), rows)


def _requalify(log: Log, relation: str, old: str, new: str) -> tuple[Log, list] | None:
    rows = _first(getattr(log, relation).where(F.col("ocel_qualifier") == old))
    return rows and (_patch(log, {"e2o": "event_object", "o2o": "object_object"}[relation], rows, "ocel_qualifier", new), rows)


def _time(log: Log, ocel_type: str, value: str | None) -> tuple[Log, list] | None:
    return _set_cell(log, "event", ocel_type, "ocel_time", value)


def _none(log: Log) -> None:
    """A change of schema that no row can show."""


CHANGES = {"type": _set_type, "cell": _set_cell, "repeat": _repeat_row, "clone": _clone, "lose": _lose, "typo": _typo, "copies": _copies, "loop": _loop, "retarget": _retarget, "requalify": _requalify, "time": _time, "none": _none}


def _i(issue: str, level: str, change: str, **how) -> Injection:
    return Injection(issue, level, change, how)


#: easy, medium and hard are wired into levels; "extra" ones are run by hand.
INJECTIONS = [
    _i("missing_object_type", "easy", "type", kind="object", ocel_type="employees", value=None),
    _i("missing_object_type", "medium", "type", kind="object", ocel_type="orders", value=""),
    _i("missing_object_type", "hard", "type", kind="object", ocel_type="products", value="   "),
    _i("missing_attribute_value", "easy", "cell", kind="object", ocel_type="products", column="weight", value=None),
    _i("missing_attribute_value", "medium", "cell", kind="object", ocel_type="employees", column="role", value=""),
    _i("missing_attribute_value", "hard", "cell", kind="object", ocel_type="orders", column="price", value=None, skip=1),
    _i("incorrect_object_type", "easy", "type", kind="object", ocel_type="orders", value="employees", skip=2),
    _i("incorrect_object_type", "medium", "type", kind="object", ocel_type="items", value="products"),
    _i("incorrect_object_type", "hard", "type", kind="object", ocel_type="customers", value="Customers"),
    _i("incorrect_attribute_datatype", "easy", "cell", kind="object", ocel_type="products", column="weight", value="unknown", skip=1),
    _i("incorrect_attribute_datatype", "medium", "cell", kind="object", ocel_type="orders", column="price", value="TBD"),
    _i("incorrect_attribute_datatype", "hard", "cell", kind="object", ocel_type="employees", column="role", value="Shipment".encode("utf-16-le"), skip=1),
    _i("duplicate_objects_on_ids", "easy", "repeat", kind="object", ocel_type="products"),
    _i("duplicate_objects_on_ids", "medium", "repeat", kind="object", ocel_type="orders", types=("products",)),
    _i("duplicate_objects_on_ids", "hard", "repeat", kind="object", ocel_type="customers", types=(..., None)),
    _i("duplicate_objects_on_attributes", "easy", "clone", kind="object", ocel_type="products", suffix="-copy"),
    _i("duplicate_objects_on_attributes", "medium", "clone", kind="object", ocel_type="employees", suffix=" (dup)"),
    _i("duplicate_objects_on_attributes", "hard", "clone", kind="object", ocel_type="orders", suffix="-again", relations=True),
    _i("missing_event_timestamp", "easy", "time", ocel_type="place order", value=None),
    _i("missing_event_timestamp", "medium", "time", ocel_type="pick item", value=""),
    _i("missing_event_timestamp", "hard", "time", ocel_type="item out of stock", value=None),
    _i("missing_event", "easy", "lose", kind="event", event_type="place order", qualifier="order"),
    _i("missing_event", "medium", "lose", kind="event", event_type="pick item", qualifier="item"),
    _i("missing_event", "hard", "lose", kind="event", event_type="create package", qualifier="packer"),
    _i("missing_event_type", "easy", "type", kind="event", ocel_type="confirm order", value=None),
    _i("missing_event_type", "medium", "type", kind="event", ocel_type="pay order", value=""),
    _i("missing_event_type", "hard", "type", kind="event", ocel_type="create package", value="  "),
    _i("dangling_e2o_relationship", "easy", "typo", relation="e2o", qualifier="order", sides=("ocel_object_id",)),
    _i("dangling_e2o_relationship", "medium", "typo", relation="e2o", qualifier="item", sides=("ocel_event_id",)),
    _i("dangling_e2o_relationship", "hard", "typo", relation="e2o", qualifier="product", sides=("ocel_event_id", "ocel_object_id")),
    _i("dangling_o2o_relationship", "easy", "typo", relation="o2o", qualifier="primarySalesRep", sides=("ocel_source_id",)),
    _i("dangling_o2o_relationship", "medium", "typo", relation="o2o", qualifier="places", sides=("ocel_target_id",)),
    _i("dangling_o2o_relationship", "hard", "typo", relation="o2o", qualifier="comprises", sides=("ocel_source_id", "ocel_target_id")),
    _i("missing_object", "easy", "lose", kind="object", event_type="place order", qualifier="order"),
    _i("missing_object", "medium", "lose", kind="object", event_type="pick item", qualifier="item"),
    _i("missing_object", "hard", "lose", kind="object", event_type="place order", qualifier="product"),
    _i("duplicate_o2o_relations", "easy", "copies", relation="o2o", qualifier="comprises"),
    _i("duplicate_o2o_relations", "medium", "copies", relation="o2o", qualifier="places"),
    _i("duplicate_o2o_relations", "hard", "copies", relation="o2o", qualifier="primarySalesRep"),
    _i("o2o_self_loop", "easy", "loop", ocel_type="orders", qualifier="contains"),
    _i("o2o_self_loop", "medium", "loop", ocel_type="employees", qualifier="primarySalesRep"),
    _i("o2o_self_loop", "hard", "loop", ocel_type="products", qualifier="is a"),
    _i("duplicate_e2o_relations", "easy", "copies", relation="e2o", qualifier="order"),
    _i("duplicate_e2o_relations", "medium", "copies", relation="e2o", qualifier="item"),
    _i("duplicate_e2o_relations", "hard", "copies", relation="e2o", qualifier="sales person"),
    _i("duplicate_objects_on_ids", "extra", "repeat", kind="object", ocel_type="items"),
    _i("incorrect_object_type", "extra", "type", kind="object", ocel_type="packages", value="orders"),
    _i("incorrect_attribute_value", "extra", "cell", kind="object", ocel_type="products", column="weight", value=-999.0, skip=2),
    _i("incorrect_attribute_value", "extra", "cell", kind="object", ocel_type="products", column="price", value=999999.0, skip=3),
    _i("missing_attribute_value", "extra", "cell", kind="object", ocel_type="packages", column="weight", value=None, count=8),
    _i("missing_object_attribute", "extra", "none"),
    _i("missing_object_attribute", "extra", "none"),
    _i("missing_event_attribute_value", "extra", "cell", kind="event", ocel_type="place order", column="lifecycle", value=None),
    _i("missing_event_attribute_value", "extra", "cell", kind="event", ocel_type="item out of stock", column="resource", value=None),
    _i("incorrect_event_attribute_datatype", "extra", "cell", kind="event", ocel_type="pick item", column="resource", value=7),
    _i("incorrect_event_attribute_datatype", "extra", "cell", kind="event", ocel_type="place order", column="lifecycle", value="complete".encode("utf-16-le"), skip=1),
    _i("incorrect_event_attribute_value", "extra", "cell", kind="event", ocel_type="pick item", column="lifecycle", value="-1"),
    _i("incorrect_event_time", "extra", "time", ocel_type="confirm order", value="2000-01-01 00:00:00"),
    _i("incorrect_event_type", "extra", "type", kind="event", ocel_type="place order", value="pick item", skip=3),
    _i("incorrect_event_type", "extra", "type", kind="event", ocel_type="place order", value="placeorder", skip=4),
    _i("incorrect_event_time", "extra", "time", ocel_type="pay order", value="2099-01-01 00:00:00"),
    _i("incorrect_event_time", "extra", "time", ocel_type="send package", value="1900-01-01 00:00:00"),
    _i("duplicate_events_on_ids", "extra", "repeat", kind="event", ocel_type="pay order"),
    _i("duplicate_events_on_ids", "extra", "repeat", kind="event", ocel_type="confirm order", types=("place order",)),
    _i("duplicate_events_on_attributes", "extra", "clone", kind="event", ocel_type="place order", suffix="-copy"),
    _i("duplicate_events_on_attributes", "extra", "clone", kind="event", ocel_type="pick item", suffix="-copy", relations=True),
    _i("missing_event_attribute", "extra", "none"),
    _i("missing_event_attribute", "extra", "none"),
    _i("dangling_e2o_relationship", "extra", "typo", relation="e2o", qualifier="shipper", sides=("ocel_object_id",)),
    _i("dangling_e2o_relationship", "extra", "typo", relation="e2o", qualifier="shipper", sides=("ocel_event_id",)),
    _i("incorrect_e2o_relationship_target", "extra", "retarget", relation="e2o", qualifier="order", skip=5),
    _i("incorrect_e2o_relationship_target", "extra", "retarget", relation="e2o", qualifier="item", skip=0),
    _i("incorrect_e2o_relationship_qualifier", "extra", "requalify", relation="e2o", old="order", new="item"),
    _i("incorrect_e2o_relationship_qualifier", "extra", "requalify", relation="e2o", old="sales person", new="salesperson"),
    _i("incorrect_o2o_relationship_target", "extra", "retarget", relation="o2o", qualifier="comprises", skip=5),
    _i("incorrect_o2o_relationship_target", "extra", "retarget", relation="o2o", qualifier="places", skip=0),
    _i("incorrect_o2o_relationship_qualifier", "extra", "requalify", relation="o2o", old="comprises", new="contains"),
    _i("incorrect_o2o_relationship_qualifier", "extra", "requalify", relation="o2o", old="primarySalesRep", new="primarySalesRepresentative"),
]


def inject(log: Log, injection: Injection) -> tuple[Log, list[dict]]:
    """The log after an injection, and the rows as they were; no rows if the
    log has nothing for it."""
    done = CHANGES[injection.change](log, **injection.how)
    return done or (log, [])


def corrupt(log: Log, level: str = "all") -> tuple[Log, list[tuple[str, str, list[dict]]]]:
    """The log after all injections of a level, or of the three, and the
    truth: (issue, level, rows as they were)."""
    truth = []
    for injection in INJECTIONS:
        if injection.level == level or level == "all" and injection.level != "extra":
            log, rows = inject(log, injection)
            truth.append((injection.issue, injection.level, rows))
    return log, truth
