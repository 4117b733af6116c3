"""Repairs of all violations of an issue at once: judgements become a table
of actions, and a table of actions makes one new version of the log. The same
rules as ``repair.act_on`` and ``repair.apply``, as columns and joins, so that
neither violations nor actions ever come to the driver.

An action row has (kind, table, key, column, value, reason): ``key`` maps the
columns that name the rows to their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwright.functions.values import blank, to_affinity
from logwright.log import RESERVED, Log
from logwright.operators import repair
from logwright.session import durable

_BLOCKS = 1024


def _key(*columns: str) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))


def _table_of(log: Log, kind: str, ocel_type: Column) -> Column:
    """The name of a type's table; null for a type that the log has not."""
    out = F.lit(None).cast("string")
    for t in reversed(log.tables(kind)):
        out = F.when(ocel_type == t.ocel_type, t.table).otherwise(out)
    return out


def _row(kind: Column | str, table: Column | str, key: Column, column: Column | str | None, value: Column | None, reason: Column | None) -> Column:
    """One action; a reason makes it a noop that still says where it would go."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    why = F.lit(None).cast("string") if reason is None else reason
    return F.struct(
        F.when(why.isNotNull(), "noop").otherwise(lit(kind)).alias("kind"),
        lit(table).alias("table"),
        key.alias("key"),
        lit(column).alias("column"),
        F.when(why.isNull(), lit(value)).alias("value"),
        why.alias("reason"),
    )


def _said(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _one(row: Column) -> Column:
    return F.array(row)


def _type_actions(kind: str, value: Column, gate: Column, other: Column) -> Column:
    none = F.when(~_said(value) | value.eqNullSafe(other), "no other type")
    return _one(_row("update", kind, _key("ocel_id"), "ocel_type", value, F.coalesce(gate, none)))


def _cell_actions(table: Column, column: Column, value: Column, gate: Column, other: Column) -> Column:
    none = F.when(value.isNull() | value.eqNullSafe(other), "no other value")
    return _one(_row("update", table, _key("ocel_id"), column, value, F.coalesce(gate, none)))


def plan_actions(log: Log, issue: str, judged: DataFrame) -> DataFrame:
    """The actions for violations of an issue. ``judged``: the detector's
    columns beside what a resolver said: value, and maybe confidence (default
    1) and, of flags to be judged, flagged (default true). Issues with a fixed
    repair need none of these. An insertion gives two actions, one a table."""
    task = repair.TASKS.get(issue)
    if task is None:
        raise repair.Refused(f"no task for {issue}")

    def own(name: str, kind: str = "string", default: object = None) -> Column:
        have = F.col(name).cast(kind) if name in judged.columns else F.lit(None).cast(kind)
        return have if default is None else F.coalesce(have, F.lit(default))

    value, side = own("value"), "event" if "event" in issue else "object"
    gate = F.when(own("flagged", "boolean", True) == F.lit(False), "not flagged") if task.kind == "detect" else F.lit(None).cast("string")
    gate = F.when(own("confidence", "double", 1.0) < task.gate, f"confidence under {task.gate}").otherwise(gate)
    if issue in ("missing_object_type", "incorrect_object_type", "missing_event_type", "incorrect_event_type"):
        made = _type_actions(side, value, gate, own("ocel_type"))
    elif issue in ("missing_event_timestamp", "incorrect_event_time"):
        none = F.when(~_said(value), "no time")
        made = _one(_row("update", F.col("target_table"), _key("ocel_id"), "ocel_time", value, F.coalesce(gate, none)))
    elif issue.startswith("dangling_"):
        table, ends = ("event_object", {"event": "ocel_event_id", "object": "ocel_object_id"}) if "e2o" in issue else ("object_object", {"source": "ocel_source_id", "target": "ocel_target_id"})
        column = F.lit(None).cast("string")
        for name, end in ends.items():
            column = F.when(F.col("missing_side") == name, end).otherwise(column)
        none = F.when(column.isNull(), "both ends are unknown").when(~_said(value), "no candidate")
        made = _one(_row("update", table, _key(*ends.values(), "ocel_qualifier"), column, value, F.coalesce(none, gate)))
    elif issue.endswith("_on_ids"):
        several = F.when(F.col("ocel_types").contains(","), "several types").when(F.col("ocel_types") == "", "no type")
        made = _one(_row("delete", side, _key("ocel_id"), None, None, several))
    elif issue.startswith("duplicate_") and issue.endswith("_relations") or issue == "o2o_self_loop":
        table, ends = ("event_object", ("ocel_event_id", "ocel_object_id")) if "e2o" in issue else ("object_object", ("ocel_source_id", "ocel_target_id"))
        made = _one(_row("delete_all" if issue == "o2o_self_loop" else "delete", table, _key(*ends, "ocel_qualifier"), None, None, None))
    elif issue in ("missing_event", "missing_object"):
        new, known = F.col(f"ocel_{side}_id"), F.coalesce(F.when(_said(value), value), own("inferred_type_from_prefix"))
        none = F.coalesce(gate, F.when(known.isNull(), "no type"))
        key = F.map_from_arrays(F.array(F.lit("ocel_id")), F.array(new))
        sub = _table_of(log, side, known)
        made = F.filter(F.array(_row("insert", side, key, "ocel_type", known, none), _row("insert", sub, key, "ocel_time", own("time"), none)), lambda x: x["table"].isNotNull())
    elif issue in ("missing_object_attribute", "missing_event_attribute"):
        names = {c.lower() for c in RESERVED}
        bad = ~value.rlike(r"^[A-Za-z_][A-Za-z0-9_ ]*$") | F.lower(value).startswith("ocel_") | F.lower(value).isin(*names)
        none = F.when(~_said(value), "no attribute").when(bad, "no name for an attribute")
        made = _one(_row("alter_add_column", F.col("table"), F.map_from_arrays(F.array(F.lit("affinity")), F.array(own("affinity", default="TEXT"))), value, None, F.coalesce(gate, none)))
    else:
        table = F.coalesce(own("target_table"), _table_of(log, side, own(f"{side}_type")))
        made = _cell_actions(table, own("attribute"), value, gate, own("actual_value"))
    return judged.select(F.explode(made).alias("a")).select("a.*")


def _same(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"__{c}"))
    return out


def _with_updates(df: DataFrame, actions: DataFrame, names: list[str]) -> DataFrame:
    """Every row that a key names gets the new values of its columns, in the
    columns' own types; a number's column keeps what it has where the text
    does not fit. Of several values for a cell the least is taken."""
    keys = [f"__{c}" for c in names]
    once = actions.select(*[F.col("key").getItem(c).alias(k) for c, k in zip(names, keys)], "column", "value").groupBy(*keys, "column").agg(F.min("value").alias("value"))
    new = once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__new"))
    affinity = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}

    def value(c: str, kind: str) -> Column:
        text, old = F.col("__new").getItem(c), F.col(f"`{c}`")
        if kind.startswith("struct"):
            number = text.try_cast("double")
            made = F.struct(F.when(number.isNotNull(), "real").otherwise("text").alias("storage"), F.lit(None).cast("bigint").alias("i"), number.alias("d"), F.when(number.isNull(), text).alias("s"), F.lit(None).cast("binary").alias("b"))
            return F.when(text.isNotNull(), made.cast(kind)).otherwise(old)
        return F.coalesce(to_affinity(text, affinity.get(kind, "TEXT")).cast(kind), old)

    joined = df.join(new, _same(names), "left")
    return joined.select(*[(F.col("row_id") if c == "row_id" else value(c, kind).alias(c)) for c, kind in df.dtypes])


def _keys(actions: DataFrame, names: list[str]) -> DataFrame:
    return actions.select(*[F.col("key").getItem(c).alias(f"__{c}") for c in names]).distinct()


def _without(df: DataFrame, actions: DataFrame, names: list[str]) -> DataFrame:
    """The rows that no key names."""
    return df.join(_keys(actions, names), _same(names), "left_anti")


def _keep_first(df: DataFrame, actions: DataFrame, names: list[str]) -> DataFrame:
    """The rows that no key names, and the first of those that each does, of
    which those with a type come first."""
    untyped = blank(F.col("ocel_type")) if "ocel_type" in df.columns else F.lit(False)
    first = df.join(_keys(actions, names), _same(names), "left_semi").groupBy(*names).agg(F.min(F.struct(untyped.alias("u"), "row_id"))["row_id"].alias("__first"))
    first = first.select(*[F.col(f"`{c}`").cast("string").alias(f"__{c}") for c in names], "__first")
    return df.join(first, _same(names), "left").where("__first is null or row_id = __first").select(*df.columns)


def _with_rows(df: DataFrame, actions: DataFrame, names: list[str]) -> DataFrame:
    """A row for each new id; of several values for one the least is taken.
    row_ids go on from the largest, dealt by blocks of the ids' hashes, so
    that no task ranks all rows."""
    column = "ocel_type" if "ocel_type" in df.columns else "ocel_time"
    new = actions.groupBy(F.col("key").getItem("ocel_id").alias("ocel_id")).agg(F.min("value").alias(column))
    new = new.withColumn("__b", F.pmod(F.xxhash64("ocel_id"), F.lit(_BLOCKS)))
    base = new.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))
    last = df.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("__last"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("ocel_id"))
    made = new.withColumn("__k", place).join(F.broadcast(base.select("__b", "__base")), "__b").join(F.broadcast(last), F.lit(True))
    made = made.select((F.col("__last") + F.col("__base") + F.col("__k")).alias("row_id"), "ocel_id", *([column] if column in df.columns else []))
    return df.unionByName(made, allowMissingColumns=True)


def apply_actions(log: Log, actions: DataFrame) -> Log:
    """The log after all updates, deletions and insertions of an action table,
    in this order; noops do nothing. Actions are computed once; only tables
    that some action names are rewritten. A new column changes the schema, so
    those go through ``repair.apply`` one by one."""
    actions = durable(actions.where("kind in ('update', 'delete', 'delete_all', 'insert')"))
    # at most a row for each table of the catalog and kind of action
    present = {tuple(r) for r in actions.select("table", "kind").distinct().collect()}
    for table in repair.table_names(log):
        df = repair.frame(log, table)
        names = [c for c in df.columns if c.startswith("ocel_") and c not in RESERVED] if table in ("event_object", "object_object") else ["ocel_id"]
        for kind, change in (("update", _with_updates), ("delete", _keep_first), ("delete_all", _without), ("insert", _with_rows)):
            if (table, kind) in present:
                df = change(df, actions.where((F.col("table") == table) & (F.col("kind") == kind)), names)
                log = repair.with_frame(log, table, df)
    return log


def attach_hints(log: Log, violations: DataFrame, kind: str = "object") -> DataFrame:
    """Violations of cells beside what the profile knows of their column: rows,
    nulls, and its first values. The facts have one row for each column of
    the schema, which bounds what is broadcast."""
    from logwright.operators import profile

    counts, samples = profile.column_profile(log, kind), profile.column_samples(log, kind)
    facts = counts.join(samples, ["ocel_type", "attribute"], "left").withColumnRenamed("ocel_type", f"{kind}_type")
    return violations.join(F.broadcast(facts), [f"{kind}_type", "attribute"], "left")
