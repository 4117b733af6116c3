"""Repairs: proposals become actions, actions make a new version of the log.

Tables of a log are named as in its catalog: ``object``, ``event``,
``event_object``, ``object_object`` and the type tables. An update, delete or
insert touches the rows it names and leaves the version before as it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logwright.functions.values import blank, to_affinity
from logwright.log import RESERVED, Log
from logwright.operators import sampling

SPINE = {"object": "object", "event": "event", "event_object": "e2o", "object_object": "o2o"}
#: Affinities that a new column may have, and their types.
AFFINITIES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}


class Refused(ValueError):
    """The action names what the log does not have, or may not be applied."""


@dataclass(frozen=True)
class Action:
    """``kind``: update, delete, delete_all, insert, alter_add_column or noop."""

    kind: str
    table: str = ""
    key: dict = field(default_factory=dict)
    column: str = ""
    value: object = None
    rows: tuple = ()
    affinity: str = "TEXT"
    reason: str = ""


def table_names(log: Log) -> list[str]:
    return [*SPINE, *(t.table for k in ("object", "event") for t in log.tables(k))]


def resolve(log: Log, name: str) -> str:
    """A table's name as the log has it, whatever its case."""
    for known in table_names(log):
        if known.lower() == name.lower():
            return known
    raise Refused(f"no table {name}")


def frame(log: Log, table: str) -> DataFrame:
    table = resolve(log, table)
    if table in SPINE:
        return getattr(log, SPINE[table])
    return next(t.df for k in ("object", "event") for t in log.tables(k) if t.table == table)


def with_frame(log: Log, table: str, df: DataFrame, declared: dict | None = None) -> Log:
    table = resolve(log, table)
    if table in SPINE:
        return log.with_(**{SPINE[table]: df})
    swap = lambda ts: tuple(replace(t, df=df, declared=t.declared | (declared or {})) if t.table == table else t for t in ts)
    return log.with_(object_tables=swap(log.object_tables), event_tables=swap(log.event_tables))


def _matches(df: DataFrame, key: dict) -> Column:
    out = F.lit(True)
    for c, v in key.items():
        if c not in df.columns:
            raise Refused(f"no column {c}")
        out = out & F.col(f"`{c}`").eqNullSafe(F.lit(v))
    return out


def _coerced(value: object, kind: str) -> Column:
    affinity = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}.get(kind, "TEXT")
    return to_affinity(F.lit(None if value is None else str(value)), affinity)


def update(log: Log, table: str, key: dict, column: str, value: object) -> Log:
    """All rows with the key get the value, in the column's own type; text
    that does not fit a number is refused."""
    df = frame(log, table)
    kinds = dict(df.dtypes)
    if column not in kinds or column == "row_id":
        raise Refused(f"no column {column}")
    kind = kinds[column]
    if kind.startswith("struct"):
        text = F.lit(None if value is None else str(value))
        number = text.try_cast("double")
        new = F.struct(F.when(text.isNull(), None).when(number.isNotNull(), "real").otherwise("text").alias("storage"), F.lit(None).cast("bigint").alias("i"), number.alias("d"), F.when(number.isNull(), text).alias("s"), F.lit(None).cast("binary").alias("b"))
    else:
        number = _number(value)
        if value is not None and (kind in ("bigint", "int") and (number is None or number != int(number)) or kind == "double" and number is None):
            raise Refused(f"{value!r} is no {kind}")
        new = _coerced(value, kind)
    return with_frame(log, table, df.withColumn(column, F.when(_matches(df, key), new.cast(kind)).otherwise(F.col(f"`{column}`"))))


def _number(value: object) -> float | None:
    try:
        return float(str(value))
    except ValueError:
        return None


def keep_first(log: Log, table: str, key: dict) -> Log:
    """Of the rows with the key only that with the least row_id stays, of those
    with a type if there are such."""
    df = frame(log, table)
    hit = _matches(df, key)
    untyped = blank(F.col("ocel_type")) if "ocel_type" in df.columns else F.lit(False)
    first = df.where(hit).agg(F.min(F.struct(untyped.alias("u"), "row_id"))["row_id"].alias("__first"))
    return with_frame(log, table, df.join(F.broadcast(first), F.lit(True), "left").where(~hit | F.col("row_id").eqNullSafe(F.col("__first"))).drop("__first"))


def delete_all(log: Log, table: str, key: dict) -> Log:
    df = frame(log, table)
    return with_frame(log, table, df.where(~_matches(df, key)))


def insert(log: Log, table: str, rows: list[dict]) -> Log:
    """Rows by column name; row_ids go on from the largest."""
    df = frame(log, table)
    unknown = {c for r in rows for c in r} - set(df.columns)
    if unknown:
        raise Refused(f"no columns {sorted(unknown)}")
    names = [c for c in df.columns if c != "row_id"]
    kinds = dict(df.dtypes)
    last = F.broadcast(df.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("__last")))
    new = log.spark.createDataFrame([(i + 1, *(None if r.get(c) is None else str(r[c]) for c in names)) for i, r in enumerate(rows)], "n long, " + ", ".join(f"`{c}` string" for c in names))

    def value(c: str) -> Column:
        if kinds[c].startswith("struct"):
            return F.struct(F.when(F.col(c).isNotNull(), "text").alias("storage"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.col(c).alias("s"), F.lit(None).cast("binary").alias("b"))
        return F.col(f"`{c}`").try_cast(kinds[c])

    made = new.join(last, F.lit(True)).select((F.col("__last") + F.col("n")).alias("row_id"), *[value(c).alias(c) for c in names])
    return with_frame(log, table, df.unionByName(made))


def add_column(log: Log, table: str, column: str, affinity: str = "TEXT") -> Log:
    """A new attribute of a type table, without values."""
    table = resolve(log, table)
    if table in SPINE:
        raise Refused("only type tables take new columns")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ ]*", column) or column.lower().startswith("ocel_") or column in RESERVED:
        raise Refused(f"{column!r} is no name for an attribute")
    df = frame(log, table)
    if column.lower() in {c.lower() for c in df.columns}:
        raise Refused(f"{column} is there")
    if affinity not in AFFINITIES:
        raise Refused(f"no affinity {affinity}")
    return with_frame(log, table, df.withColumn(column, F.lit(None).cast(AFFINITIES[affinity])), {column: affinity})


def apply(log: Log, action: Action, dry_run: bool = False, override: object = None) -> Log | DataFrame:
    """The log after an action; with ``dry_run`` the rows it would touch. A
    noop is refused unless an override value gives it something to do."""
    if action.kind == "noop":
        if override is None or not action.table or not action.column:
            raise Refused(action.reason or "nothing to do")
        action = replace(action, kind="update", value=override)
    elif override is not None:
        action = replace(action, value=override)
    if dry_run:
        df = frame(log, action.table)
        return df.where(_matches(df, action.key)) if action.kind in ("update", "delete", "delete_all") else df.limit(0)
    if action.kind == "update":
        return update(log, action.table, action.key, action.column, action.value)
    if action.kind == "delete":
        return keep_first(log, action.table, action.key)
    if action.kind == "delete_all":
        return delete_all(log, action.table, action.key)
    if action.kind == "insert":
        for table, row in action.rows:
            log = insert(log, table, [row])
        return log
    if action.kind == "alter_add_column":
        return add_column(log, action.table, action.column, action.affinity)
    raise Refused(f"no action {action.kind}")


# Whole issues at once: one plan repairs every violation.


def dedupe_ids(log: Log, kind: str) -> Log:
    """Repeated ids of one type keep their first row, typed rows before
    others; ids with several types are left for a judgement."""
    df = getattr(log, kind)
    typed = F.when(~blank(F.col("ocel_type")), F.col("ocel_type"))
    groups = df.groupBy("ocel_id").agg(F.count_distinct(typed).alias("types"), F.min(F.struct(blank(F.col("ocel_type")).alias("no"), "row_id")).alias("best"), F.count(F.lit(1)).alias("n"))
    same = groups.where("n > 1 and types = 1").select(F.col("ocel_id").alias("__id"), F.col("best.row_id").alias("__keep"))
    joined = df.join(same, F.col("ocel_id").eqNullSafe(F.col("__id")), "left")
    return log.with_(**{kind: joined.where("__keep is null or row_id = __keep").select(*df.columns)})


def dedupe_relations(log: Log, relation: str) -> Log:
    """Of equal triples, nulls equal, the row with the least row_id stays."""
    df = getattr(log, relation)
    names = [c for c in df.columns if c != "row_id"]
    return log.with_(**{relation: df.groupBy(*names).agg(F.min("row_id").alias("row_id")).select(*df.columns)})


def drop_self_loops(log: Log) -> Log:
    return log.with_(o2o=log.o2o.where("not coalesce(ocel_source_id = ocel_target_id, false)"))


def midpoint_times(log: Log) -> DataFrame:
    """(ocel_id, proposed): for events without a time, the middle between the
    earliest and the latest time of their neighbours."""
    gone = log.event_times().where(blank(F.col("ocel_time"))).select("ocel_id").distinct()
    at = F.unix_timestamp(F.try_to_timestamp("ocel_time")).alias("at")
    known = log.event.select("ocel_id").where("ocel_id is not null").distinct()
    times = sampling.event_time(log).join(known, "ocel_id").select(F.col("ocel_id").alias("ocel_event_id"), at)
    pairs = log.e2o.select("ocel_event_id", "ocel_object_id").distinct()
    timed = pairs.join(times, "ocel_event_id").where("at is not null")
    anchors = gone.withColumnRenamed("ocel_id", "anchor")
    own = pairs.withColumnRenamed("ocel_event_id", "anchor").join(anchors, "anchor")
    # an object's span is found once, over events that are no anchors; few anchors have a time elsewhere
    spans = timed.join(anchors, F.col("ocel_event_id") == F.col("anchor"), "left_anti").groupBy("ocel_object_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    others = timed.join(anchors, F.col("ocel_event_id") == F.col("anchor"), "left_semi")
    near = own.join(spans, "ocel_object_id").select("anchor", "lo", "hi")
    near = near.unionByName(own.join(others, "ocel_object_id").where("anchor <> ocel_event_id").select("anchor", F.col("at").alias("lo"), F.col("at").alias("hi")))
    middle = F.expr("(lo + hi) div 2")
    spans = near.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.select(F.col("anchor").alias("ocel_id"), F.date_format(F.timestamp_seconds(middle), "yyyy-MM-dd HH:mm:ss").alias("proposed"))


# Issues one by one: how each is judged and what a judgement does.


@dataclass(frozen=True)
class Task:
    """``fixed`` issues need no judgement. ``gate``: the least confidence."""

    issue: str
    kind: str
    act: Callable[[dict, dict], Action]
    gate: float = 0.4
    fixed: bool = False


def _set_type(kind: str) -> Callable[[dict, dict], Action]:
    return lambda row, said: Action("update", kind, {"ocel_id": row["ocel_id"]}, "ocel_type", said["value"]) if said.get("value") and said["value"] != row.get("ocel_type") else Action("noop", kind, {"ocel_id": row["ocel_id"]}, "ocel_type", reason="no other type")


def _set_cell(kind: str) -> Callable[[dict, dict], Action]:
    def act(row: dict, said: dict) -> Action:
        if "ocel_id" not in row or not row.get("attribute"):
            # a group of rows, of which the resolver has to name one and an attribute
            picked = {k: said[k] for k in ("ocel_id", "attribute") if said.get(k)}
            if len(picked) < 2:
                return Action("noop", reason="no row and attribute of the group")
            row = row | picked
        table = row.get("target_table") or f"{kind}_{row[f'{kind}_type']}"
        if said.get("value") is None or str(said["value"]) == str(row.get("actual_value")):
            return Action("noop", table, {"ocel_id": row["ocel_id"]}, row.get("attribute", ""), reason="no other value")
        return Action("update", table, {"ocel_id": row["ocel_id"]}, row["attribute"], said["value"])

    return act


def _set_time(row: dict, said: dict) -> Action:
    if not said.get("value"):
        return Action("noop", row["target_table"], {"ocel_id": row["ocel_id"]}, "ocel_time", reason="no time")
    return Action("update", row["target_table"], {"ocel_id": row["ocel_id"]}, "ocel_time", said["value"])


def _swap_end(table: str, columns: dict[str, str]) -> Callable[[dict, dict], Action]:
    def act(row: dict, said: dict) -> Action:
        side = row["missing_side"]
        if side == "both" or not said.get("value"):
            return Action("noop", reason="both ends are unknown" if side == "both" else "no candidate")
        key = {c: row[c] for c in (*columns.values(), "ocel_qualifier")}
        return Action("update", table, key, columns[side], said["value"])

    return act


def _one_row(table: str, several_types: bool) -> Callable[[dict, dict], Action]:
    def act(row: dict, said: dict) -> Action:
        types = row.get("ocel_types") or ""
        if several_types and ("," in types or not types):
            return Action("noop", table, {"ocel_id": row["ocel_id"]}, "ocel_type", reason="several types" if types else "no type")
        return Action("delete", table, {k: v for k, v in row.items() if k.startswith("ocel_") and k != "ocel_types"})

    return act


def _make(kind: str) -> Callable[[dict, dict], Action]:
    def act(row: dict, said: dict) -> Action:
        ocel_type = said.get("value") or row.get("inferred_type_from_prefix")
        if not ocel_type:
            return Action("noop", reason="no type")
        new_id = row["ocel_event_id" if kind == "event" else "ocel_object_id"]
        sub = {"ocel_id": new_id} | ({"ocel_time": said["time"]} if said.get("time") else {})
        return Action("insert", rows=((kind, {"ocel_id": new_id, "ocel_type": ocel_type}), (said.get("table") or f"{kind}_{ocel_type}", sub)))

    return act


def _add(row: dict, said: dict) -> Action:
    return Action("alter_add_column", row["table"], column=said.get("value") or "", affinity=said.get("affinity", "TEXT")) if said.get("value") else Action("noop", reason="no attribute")


_E2O, _O2O = {"event": "ocel_event_id", "object": "ocel_object_id"}, {"source": "ocel_source_id", "target": "ocel_target_id"}
TASKS = {
    t.issue: t
    for t in (
        Task("missing_object_type", "resolve", _set_type("object")),
        Task("incorrect_object_type", "detect", _set_type("object")),
        Task("incorrect_event_type", "detect", _set_type("event")),
        Task("incorrect_event_time", "detect", _set_time),
        Task("missing_attribute_value", "resolve", _set_cell("object"), 0.0),
        Task("missing_event_attribute_value", "resolve", _set_cell("event"), 0.0),
        Task("incorrect_attribute_datatype", "resolve", _set_cell("object")),
        Task("incorrect_event_attribute_datatype", "resolve", _set_cell("event")),
        Task("incorrect_attribute_value", "detect", _set_cell("object")),
        Task("incorrect_event_attribute_value", "detect", _set_cell("event")),
        Task("dangling_o2o_relationship", "resolve", _swap_end("object_object", _O2O)),
        Task("dangling_e2o_relationship", "resolve", _swap_end("event_object", _E2O)),
        Task("duplicate_objects_on_ids", "resolve", _one_row("object", True), 0.0, True),
        Task("duplicate_events_on_ids", "resolve", _one_row("event", True), 0.0, True),
        Task("duplicate_objects_on_attributes", "resolve", _set_cell("object")),
        Task("duplicate_events_on_attributes", "resolve", _set_cell("event")),
        Task("duplicate_o2o_relations", "resolve", _one_row("object_object", False), 0.0, True),
        Task("duplicate_e2o_relations", "resolve", _one_row("event_object", False), 0.0, True),
        Task("o2o_self_loop", "resolve", lambda row, said: Action("delete_all", "object_object", {k: row[k] for k in (*_O2O.values(), "ocel_qualifier")}), 0.0, True),
        Task("missing_event", "resolve", _make("event"), 0.0),
        Task("missing_event_type", "resolve", _set_type("event")),
        Task("missing_event_timestamp", "resolve", _set_time, 0.0),
        Task("missing_object", "resolve", _make("object"), 0.0),
        Task("missing_object_attribute", "detect", _add),
        Task("missing_event_attribute", "detect", _add),
    )
}


def act_on(issue: str, row: dict, said: dict | None = None) -> Action:
    """The action for a violation, given what a resolver said of it: value,
    confidence and, of flags to be judged, flagged."""
    if issue not in TASKS:
        return Action("noop", reason=f"no task for {issue}")
    task, said = TASKS[issue], said or {}
    if task.fixed:
        return task.act(row, said)
    if said.get("confidence", 1.0) < task.gate:
        routed = task.act(row, said)
        return replace(routed, kind="noop", reason=f"confidence under {task.gate}")
    if task.kind == "detect" and not said.get("flagged", True):
        return Action("noop", reason="not flagged")
    return task.act(row, said)


def peer_mode(log: Log, ocel_type: str, attribute: str, kind: str = "object") -> DataFrame:
    """(ocel_id, value): a proposal without a language model: for each row
    that lacks the attribute, its type's most frequent value."""
    t = next(t for t in log.tables(kind) if t.ocel_type == ocel_type)
    value = F.col(f"`{attribute}`").cast("string")
    best = t.df.where(~blank(value)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(1)
    return t.df.where(blank(value)).select("ocel_id").join(F.broadcast(best.select("value")), F.lit(True))


def resolve_with(context: DataFrame, resolver: Callable, schema: str) -> DataFrame:
    """Proposals of a resolver, such as a client of a language model, for
    batches of contexts (pandas in, pandas out), and error. Where a batch
    fails its rows are tried one by one; an error stays in its row, beside
    what the context and ``schema`` have in common."""
    names = StructType.fromDDL(schema).names

    def run(frames):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in frames:
            try:
                yield resolver(pdf)[names].assign(error=None)
                continue
            except Exception:  # noqa: BLE001, S110
                pass
            for row in pdf.to_dict("records"):
                one = pd.DataFrame([row])
                try:
                    yield resolver(one)[names].assign(error=None)
                except Exception as error:  # noqa: BLE001
                    yield pd.DataFrame([{n: row.get(n) for n in names} | {"error": f"{type(error).__name__}: {error}"}])

    return context.mapInPandas(run, f"{schema}, error string")


def fan_out(proposals: DataFrame, column: str = "suggestions") -> DataFrame:
    """A row for each suggested attribute of a type."""
    return proposals.select(*[c for c in proposals.columns if c != column], F.explode(column).alias("suggestion"))


def latest_flags(flags: DataFrame) -> DataFrame:
    """The last decision for each (issue, ocel_id, attribute) of a journal
    with a growing ``at``."""
    w = Window.partitionBy("issue", "ocel_id", "attribute").orderBy(F.desc("at"))
    return flags.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
