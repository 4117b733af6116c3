"""Queries over the test log for tasks, bulk repairs, injections, hints and
scores, each with its SQL. Judgements are arithmetic on ids, so that both
engines judge alike."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.functions import values
from logwright.log import Log
from logwright.operators import batch, detectors, evaluate, inject, profile, repair, sampling
from logwright.plans import queries as base
from logwright.plans.bridge import load, oracle
from logwright.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make, sql: str | None) -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


# tasks: violations and judgements to actions

_SURE = "CAST(length({0}) % 4 AS double) / 4"


def _flat(actions: DataFrame) -> DataFrame:
    key = F.array_join(F.array_sort(F.transform(F.map_entries("key"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")
    return actions.select("kind", F.col("table").alias("table_name"), key.alias("key"), F.col("column").alias("column_name"), "value", "reason")


def _actions(log: Log, issue: str, judged: DataFrame) -> DataFrame:
    return _flat(batch.plan_actions(log, issue, judged))


def _task(name: str, issue: str, judge, sql: str) -> None:  # noqa: ANN001
    """``judge``: the violations of a log beside what was said of them."""
    _query(name, lambda log: _actions(log, issue, judge(log)), sql)


def _set(source: str, table: str, column: str, value: str, none: str, sure: str | None = None, key: str = "'ocel_id=' || ocel_id") -> str:
    """SQL of update actions over ``source``; ``none``: reason cases for noops."""
    reason = f"CASE {f'WHEN {sure} < 0.4 THEN {chr(39)}confidence under 0.4{chr(39)} ' if sure else ''}{none} END"
    return f"SELECT CASE WHEN reason IS NULL THEN 'update' ELSE 'noop' END AS kind, table_name, key, column_name, CASE WHEN reason IS NULL THEN value END AS value, reason FROM (SELECT {table} AS table_name, {key} AS key, {column} AS column_name, {value} AS value, {reason} AS reason FROM ({source}) AS v) AS a"


def _says(df: DataFrame, value: str, sure: str | None = None) -> DataFrame:
    df = df.withColumn("value", F.expr(value))
    return df if sure is None else df.withColumn("confidence", F.expr(sure))


_ID = _SURE.format("ocel_id")
for _name, _issue, _value in (("r01", "missing_object_type", "customers"), ("r21", "missing_event_type", "place order")):
    _kind = "event" if "event" in _issue else "object"
    _key = "d01_missing_object_type" if _kind == "object" else "d17_missing_event_type"
    _task(f"{_name}_{_issue}", _issue, lambda log, i=_issue, v=_value: _says(detectors.DETECTORS[i](log), f"'{v}'", _ID), _set(base.ORACLES[_key], f"'{_kind}'", "'ocel_type'", f"'{_value}'", "WHEN ocel_id = '' THEN ''", _ID))
for _name, _issue, _own, _value in (("r02", "incorrect_object_type", "products", "suppliers"), ("r03", "incorrect_event_type", "place order", "ship item")):
    _kind = "event" if "event" in _issue else "object"
    _guess = f"CASE WHEN length(ocel_id) % 2 = 0 THEN '{_value}' ELSE '{_own}' END"
    _task(
        f"{_name}_{_issue}",
        _issue,
        lambda log, k=_kind, o=_own, g=_guess: _says(sampling.type_candidates(log, k, o), g, _ID),
        oracle(" " + _set(f"SELECT * FROM {_kind} WHERE ocel_type = '{_own}'", f"'{_kind}'", "'ocel_type'", _guess, "WHEN length(ocel_id) % 2 <> 0 THEN 'no other type'", _ID)),
    )
_NOW = "CASE WHEN length(ocel_id) % 3 = 0 THEN NULL ELSE '2024-05-05 05:05:05' END"
_task("r04_incorrect_event_time", "incorrect_event_time", lambda log: _says(sampling.time_candidates(log, "place order"), _NOW, _ID), oracle(" " + _set("SELECT * FROM place", "'event_PlaceOrder'", "'ocel_time'", _NOW, "WHEN length(ocel_id) % 3 = 0 THEN 'no time'", _ID)))
_task("r22_missing_event_timestamp", "missing_event_timestamp", lambda log: _says(detectors.missing_event_timestamp(log), _NOW, _ID), _set(base.ORACLES["d15_missing_event_timestamp"], "target_table", "'ocel_time'", _NOW, "WHEN length(ocel_id) % 3 = 0 THEN 'no time'"))
_OBJECT_TABLE = "CASE object_type WHEN 'customers' THEN 'object_Customers' WHEN 'orders' THEN 'object_Orders' WHEN 'products' THEN 'object_Products' END"
_EVENT_TABLE = "CASE event_type WHEN 'ship item' THEN 'event_ShipItem' WHEN 'click' THEN 'event_Click' WHEN 'place order' THEN 'event_PlaceOrder' END"
_ONE = "CASE WHEN length(ocel_id) % 3 = 0 THEN NULL ELSE '1' END"
_NONE = "WHEN length(ocel_id) % 3 = 0 THEN 'no other value'"
for _name, _issue, _key, _sure in (
    ("r05", "missing_attribute_value", "d02_missing_attribute_value", None),
    ("r06", "missing_event_attribute_value", "d03_missing_event_attribute_value", None),
    ("r07", "incorrect_attribute_datatype", "d11_incorrect_attribute_datatype", _ID),
    ("r08", "incorrect_event_attribute_datatype", "d12_incorrect_event_attribute_datatype", _ID),
):
    _table = _EVENT_TABLE if "event" in _issue else _OBJECT_TABLE
    _task(f"{_name}_{_issue}", _issue, lambda log, i=_issue, s=_sure: _says(detectors.DETECTORS[i](log), _ONE, s), _set(base.ORACLES[_key], _table, "attribute", _ONE, _NONE, _sure))
_SIZES = " SELECT 'products' AS object_type, ocel_id, 'size' AS attribute, CAST(size AS varchar) AS actual_value FROM products WHERE size IS NOT NULL"
_AMOUNTS = " SELECT 'ship item' AS event_type, ocel_id, 'quantity' AS attribute, CAST(quantity AS varchar) AS actual_value FROM ship WHERE quantity IS NOT NULL"
_query("g4_attribute_candidates", lambda log: detectors.type_correct_cells(log, "object", "products").where("attribute = 'size'").select("object_type", "ocel_id", "attribute", "actual_value"), oracle(_SIZES))
_query("g5_event_attribute_candidates", lambda log: detectors.type_correct_cells(log, "event", "ship item").where("attribute = 'quantity'").select("event_type", "ocel_id", "attribute", "actual_value"), oracle(_AMOUNTS))
_query("g7_event_schema_candidates", lambda log: sampling.schema_candidates(log, "event"), "SELECT * FROM (VALUES ('place order', 'event_PlaceOrder', ''), ('ship item', 'event_ShipItem', 'quantity REAL, returnflag INTEGER'), ('click', 'event_Click', 'value REAL')) AS t(ocel_type, \"table\", columns)")
_task("r09_incorrect_attribute_value", "incorrect_attribute_value", lambda log: _says(detectors.type_correct_cells(log, "object", "products").where("attribute = 'size'"), "'7'", _ID), oracle(" " + _set(_SIZES, _OBJECT_TABLE, "attribute", "'7'", "WHEN actual_value = '7' THEN 'no other value'", _ID)))
_task("r10_incorrect_event_attribute_value", "incorrect_event_attribute_value", lambda log: _says(detectors.type_correct_cells(log, "event", "ship item").where("attribute = 'quantity'"), "'7.0'", _ID), oracle(" " + _set(_AMOUNTS, _EVENT_TABLE, "attribute", "'7.0'", "WHEN actual_value = '7.0' THEN 'no other value'", _ID)))


def _ends(a: str, b: str) -> str:
    """SQL of a key by the three columns of a relation, in their names' order."""
    return " || ';' || ".join(f"'{c}=' || coalesce({c}, 'null')" for c in sorted((a, b, "ocel_qualifier")))


_SOME = "CASE WHEN length({0}) % 3 = 0 THEN NULL ELSE 'o-1' END"
for _name, _issue, _key, _a, _b, _table in (
    ("r11", "dangling_o2o_relationship", "d13_dangling_o2o_relationship", "source", "target", "object_object"),
    ("r12", "dangling_e2o_relationship", "d14_dangling_e2o_relationship", "event", "object", "event_object"),
):
    _first, _second = f"ocel_{_a}_id", f"ocel_{_b}_id"
    _why = f"CASE WHEN missing_side = 'both' THEN 'both ends are unknown' WHEN length({_second}) % 3 = 0 THEN 'no candidate' WHEN {_SURE.format(_first)} < 0.4 THEN 'confidence under 0.4' END"
    _task(
        f"{_name}_{_issue}",
        _issue,
        lambda log, i=_issue, a=_first, b=_second: _says(detectors.DETECTORS[i](log), _SOME.format(b), _SURE.format(a)),
        f"SELECT CASE WHEN reason IS NULL THEN 'update' ELSE 'noop' END AS kind, table_name, key, column_name, CASE WHEN reason IS NULL THEN 'o-1' END AS value, reason FROM (SELECT '{_table}' AS table_name, {_ends(_first, _second)} AS key, CASE missing_side WHEN '{_a}' THEN '{_first}' WHEN '{_b}' THEN '{_second}' END AS column_name, {_why} AS reason FROM ({base.ORACLES[_key]}) AS v) AS a",
    )
_NULLS = "CAST(NULL AS varchar) AS column_name, CAST(NULL AS varchar) AS value"
for _name, _issue, _key in (("r13", "duplicate_objects_on_ids", "d04_duplicate_objects_on_ids"), ("r14", "duplicate_events_on_ids", "d06_duplicate_events_on_ids")):
    _kind = "event" if "event" in _issue else "object"
    _task(
        f"{_name}_{_issue}",
        _issue,
        lambda log, i=_issue: detectors.DETECTORS[i](log),
        f"SELECT CASE WHEN reason IS NULL THEN 'delete' ELSE 'noop' END AS kind, * FROM (SELECT '{_kind}' AS table_name, 'ocel_id=' || coalesce(ocel_id, 'null') AS key, {_NULLS}, CASE WHEN contains(ocel_types, ',') THEN 'several types' WHEN ocel_types = '' THEN 'no type' END AS reason FROM ({base.ORACLES[_key]}) AS v) AS a",
    )


def _first_of_group(df: DataFrame, attribute: str) -> DataFrame:
    return df.withColumns({"ocel_id": F.split("ocel_ids", ", ")[0], "attribute": F.lit(attribute), "value": F.lit("1")})


_task("r15_duplicate_objects_on_attributes", "duplicate_objects_on_attributes", lambda log: _first_of_group(detectors.duplicate_objects_on_attributes(log), "status"), _set(f"SELECT object_type, string_split(ocel_ids, ', ')[1] AS ocel_id FROM ({base.ORACLES['d05_duplicate_objects_on_attributes']}) AS d", _OBJECT_TABLE, "'status'", "'1'", "WHEN ocel_id = '' THEN ''"))
_GROUPS = " SELECT 'ship item' AS event_type, first(ocel_id ORDER BY row_id, ocel_id) AS ocel_id FROM ship GROUP BY quantity, returnflag HAVING count(*) > 1 UNION ALL SELECT 'click', first(ocel_id ORDER BY row_id, ocel_id) FROM click GROUP BY value HAVING count(*) > 1"
_task("r16_duplicate_events_on_attributes", "duplicate_events_on_attributes", lambda log: _first_of_group(detectors.duplicate_events_on_attributes(log), "value"), oracle(" " + _set(_GROUPS, _EVENT_TABLE, "'value'", "'1'", "WHEN ocel_id = '' THEN ''")))
for _name, _issue, _key, _a, _b in (
    ("r17", "duplicate_o2o_relations", "d08_duplicate_o2o_relations", "source", "target"),
    ("r18", "duplicate_e2o_relations", "d10_duplicate_e2o_relations", "event", "object"),
    ("r19", "o2o_self_loop", "d09_o2o_self_loop", "source", "target"),
):
    _table, _what = "event_object" if "e2o" in _issue else "object_object", "delete_all" if _name == "r19" else "delete"
    _task(f"{_name}_{_issue}", _issue, lambda log, i=_issue: detectors.DETECTORS[i](log), f"SELECT '{_what}' AS kind, '{_table}' AS table_name, {_ends(f'ocel_{_a}_id', f'ocel_{_b}_id')} AS key, {_NULLS}, CAST(NULL AS varchar) AS reason FROM ({base.ORACLES[_key]}) AS v")


def _insertions(source: str, side: str, value: str, sub: str, time: str) -> str:
    key = f"'ocel_id=' || ocel_{side}_id AS key"
    spine = f"SELECT 'insert' AS kind, '{side}' AS table_name, {key}, 'ocel_type' AS column_name, {value} AS value, CAST(NULL AS varchar) AS reason FROM ({source}) AS v"
    return f"{spine} UNION ALL SELECT 'insert', {sub}, {key}, 'ocel_time', {time}, NULL FROM ({source}) AS v"


_task("r20_missing_event", "missing_event", lambda log: _says(detectors.missing_event(log), "'place order'").withColumn("time", F.lit("2024-05-05 05:05:05")), _insertions(base.ORACLES["d16_missing_event"], "event", "'place order'", "'event_PlaceOrder'", "'2024-05-05 05:05:05'"))
_SUBS = "CASE inferred_type_from_prefix WHEN 'customers' THEN 'object_Customers' WHEN 'orders' THEN 'object_Orders' WHEN 'products' THEN 'object_Products' WHEN 'suppliers' THEN 'object_Suppliers' WHEN 'nations' THEN 'object_Nations' END"
_task("r23_missing_object", "missing_object", detectors.missing_object, _insertions(base.ORACLES["d18_missing_object"], "object", "inferred_type_from_prefix", _SUBS, "CAST(NULL AS varchar)"))
for _name, _issue, _key in (("r24", "missing_object_attribute", "g6_schema_candidates"), ("r25", "missing_event_attribute", "g7_event_schema_candidates")):
    _kind = "event" if "event" in _issue else "object"
    _add = "CASE WHEN ocel_type IN ('products', 'click') THEN 'weight' WHEN ocel_type = 'orders' THEN 'ocel_colour' END"
    _task(
        f"{_name}_{_issue}",
        _issue,
        lambda log, k=_kind: _says(sampling.schema_candidates(log, k), _add).withColumn("flagged", F.expr("ocel_type <> 'nations'")),
        f"""SELECT CASE WHEN reason IS NULL THEN 'alter_add_column' ELSE 'noop' END AS kind, * FROM (SELECT "table" AS table_name, 'affinity=TEXT' AS key, {_add} AS column_name, CAST(NULL AS varchar) AS value,
 CASE ocel_type WHEN 'nations' THEN 'not flagged' WHEN 'orders' THEN 'no name for an attribute' WHEN 'products' THEN NULL WHEN 'click' THEN NULL ELSE 'no attribute' END AS reason FROM ({ORACLES.get(_key) or base.ORACLES[_key]}) AS v) AS a""",
    )


# bulk repairs


def _applied(log: Log, issue: str, judged: DataFrame) -> Log:
    return batch.apply_actions(log, batch.plan_actions(log, issue, judged))


_query(
    "x2_bulk_update",
    lambda log: _applied(log, "missing_object_type", _says(detectors.missing_object_type(log), "'customers'", _ID)).object,
    oracle(f" SELECT row_id, ocel_id, CASE WHEN ocel_id IN (SELECT ocel_id FROM object WHERE (ocel_type IS NULL OR trim(ocel_type) = '') AND {_ID} >= 0.4) THEN 'customers' ELSE ocel_type END AS ocel_type FROM object"),
)
_query(
    "x2_bulk_swap",
    lambda log: _applied(log, "dangling_e2o_relationship", _says(detectors.dangling_e2o_relationship(log).where("missing_side = 'object'"), "'o-1'")).e2o,
    oracle(" SELECT row_id, ocel_event_id, CASE WHEN ocel_event_id IN (SELECT ocel_id FROM event) AND ocel_object_id NOT IN (SELECT ocel_id FROM object) THEN 'o-1' ELSE ocel_object_id END AS ocel_object_id, ocel_qualifier FROM e2o"),
)
_query(
    "x2_bulk_cells",
    lambda log: repair.frame(_applied(log, "missing_attribute_value", _says(detectors.missing_attribute_value(log).where("object_type = 'customers'"), "CASE attribute WHEN 'acctbal' THEN '42.5' ELSE 'unknown' END")), "object_Customers").select("row_id", "name", "acctbal", "segment"),
    oracle(""", gap AS (SELECT DISTINCT ocel_id, acctbal IS NULL AS a, trim(segment) = '' AS s FROM customers WHERE ocel_changed_field IS NULL)
 SELECT row_id, name, CASE WHEN a THEN 42.5 ELSE acctbal END AS acctbal, CASE WHEN s THEN 'unknown' ELSE segment END AS segment FROM customers JOIN gap USING (ocel_id)"""),
)
_query("x3_bulk_delete", lambda log: _applied(log, "duplicate_e2o_relations", detectors.duplicate_e2o_relations(log)).e2o.select("ocel_event_id", "ocel_object_id", "ocel_qualifier", "row_id"), oracle(" SELECT e.* FROM e2o AS e JOIN (SELECT ocel_event_id, ocel_object_id, ocel_qualifier, min(row_id) AS row_id FROM e2o GROUP BY 1, 2, 3) AS f USING (ocel_event_id, ocel_object_id, ocel_qualifier, row_id)"))
_query("x4_bulk_delete_all", lambda log: _applied(log, "o2o_self_loop", detectors.o2o_self_loop(log)).o2o, base.ORACLES["x4_delete_all"])
_query("x5_bulk_insert", lambda log: _applied(log, "missing_object", detectors.missing_object(log)).object.select("ocel_id", "ocel_type"), base.ORACLES["x5_insert_missing"])
_query(
    "x5_bulk_row_ids",
    lambda log: _applied(log, "missing_object", detectors.missing_object(log)).object.agg(F.max("row_id").alias("last"), F.count_distinct("row_id").alias("ids")),
    oracle(f", new AS (SELECT DISTINCT ocel_object_id FROM e2o WHERE ocel_object_id NOT IN (SELECT ocel_id FROM object) AND {base._INFER} IS NOT NULL) SELECT max(row_id) + (SELECT count(*) FROM new) AS last, count(DISTINCT row_id) + (SELECT count(*) FROM new) AS ids FROM object"),
)
_query("x9_dry_run", lambda log: repair.apply(log, repair.Action("delete_all", "OBJECT", {"ocel_type": "products"}), dry_run=True), oracle(" SELECT * FROM object WHERE ocel_type = 'products'"))
_query("x7_override", lambda log: repair.apply(log, repair.Action("noop", "object", {"ocel_type": "suppliers"}, "ocel_type"), override="vendors").object, oracle(" SELECT row_id, ocel_id, CASE WHEN ocel_type = 'suppliers' THEN 'vendors' ELSE ocel_type END AS ocel_type FROM object"))

# injections: what each kind of change adds to and takes from a table


def _changes(name: str, change: str, table: str, sql: str, **how) -> None:  # noqa: ANN003
    def make(log: Log) -> DataFrame:
        after, _ = inject.inject(log, inject.Injection("", "extra", change, how))
        old, new = ([F.col(c).cast("string") for c in d.columns if c != "row_id"] for d in (repair.frame(log, table), repair.frame(after, table)))
        a, b = repair.frame(log, table).select(*old), repair.frame(after, table).select(*new)
        return b.exceptAll(a).select(F.lit("added").alias("op"), "*").unionAll(a.exceptAll(b).select(F.lit("removed"), "*"))

    _query(f"i_{name}", make, oracle(sql))


def _patched(table: str, where: str, columns: str, column: str, value: str) -> str:
    one = f"SELECT {columns} FROM {table} WHERE {where} ORDER BY row_id LIMIT 1"
    return f" SELECT 'added' AS op, * REPLACE ({value} AS {column}) FROM ({one}) UNION ALL SELECT 'removed', * FROM ({one})"


_TYPED, _E2O, _O2O = "ocel_id, ocel_type", "ocel_event_id, ocel_object_id, ocel_qualifier", "ocel_source_id, ocel_target_id, ocel_qualifier"
_CUSTOMER = "ocel_id, ocel_time, ocel_changed_field, name, CAST(acctbal AS varchar) AS acctbal, segment"
_changes("set_type", "type", "object", _patched("object", "ocel_type = 'suppliers'", _TYPED, "ocel_type", "'nations'"), kind="object", ocel_type="suppliers", value="nations")
_changes("blank_event_type", "type", "event", _patched("event", "ocel_type = 'place order'", _TYPED, "ocel_type", "'  '"), kind="event", ocel_type="place order", value="  ")
_changes("null_cell", "cell", "object_Customers", _patched("customers", "ocel_changed_field IS NULL AND segment IS NOT NULL", _CUSTOMER, "segment", "CAST(NULL AS varchar)"), kind="object", ocel_type="customers", column="segment", value=None)
_changes("set_time", "time", "event_PlaceOrder", _patched("place", "ocel_time IS NOT NULL", "ocel_id, ocel_time", "ocel_time", "'2099-01-01 00:00:00'"), ocel_type="place order", value="2099-01-01 00:00:00")
_changes("repeat_id", "repeat", "object", " SELECT 'added' AS op, ocel_id, t AS ocel_type FROM (SELECT * FROM object WHERE ocel_type = 'suppliers' ORDER BY row_id LIMIT 1), (VALUES ('suppliers'), (NULL)) AS v(t)", kind="object", ocel_type="suppliers", types=(..., None))
_changes("clone_attributes", "clone", "object_Customers", f" SELECT 'added' AS op, * REPLACE (ocel_id || '-copy' AS ocel_id) FROM (SELECT {_CUSTOMER} FROM customers WHERE ocel_changed_field IS NULL ORDER BY row_id LIMIT 1)", kind="object", ocel_type="customers", suffix="-copy")
_changes("lose_event", "lose", "event", " SELECT 'removed' AS op, ocel_id, ocel_type FROM event WHERE ocel_id = (SELECT ocel_event_id FROM e2o WHERE ocel_qualifier = 'customer' AND ocel_event_id IN (SELECT ocel_id FROM event WHERE ocel_type = 'place order') ORDER BY row_id LIMIT 1)", kind="event", event_type="place order", qualifier="customer")
_changes("lose_object", "lose", "object", " SELECT 'removed' AS op, ocel_id, ocel_type FROM object WHERE ocel_id = (SELECT ocel_object_id FROM e2o WHERE ocel_qualifier = 'customer' AND ocel_event_id IN (SELECT ocel_id FROM event WHERE ocel_type = 'place order') AND ocel_object_id IN (SELECT ocel_id FROM object) ORDER BY row_id LIMIT 1)", kind="object", event_type="place order", qualifier="customer")
_changes("near_miss_id", "typo", "object_object", " SELECT 'added' AS op, ocel_source_id, ocel_target_id || '-TYPO' AS ocel_target_id, ocel_qualifier FROM (SELECT * FROM o2o WHERE ocel_qualifier = 'places' ORDER BY row_id LIMIT 1)", relation="o2o", qualifier="places", sides=("ocel_target_id",))
_changes("copy_relation", "copies", "object_object", f" SELECT 'added' AS op, {_O2O} FROM (SELECT * FROM o2o WHERE ocel_qualifier = 'places' ORDER BY row_id LIMIT 1), range(2)", relation="o2o", qualifier="places")
_changes("self_loop", "loop", "object_object", " SELECT 'added' AS op, ocel_id AS ocel_source_id, ocel_id AS ocel_target_id, 'is a' AS ocel_qualifier FROM (SELECT * FROM object WHERE ocel_type = 'suppliers' ORDER BY row_id LIMIT 1)", ocel_type="suppliers", qualifier="is a")
_changes("requalify", "requalify", "object_object", _patched("o2o", "ocel_qualifier = 'places'", _O2O, "ocel_qualifier", "'place'"), relation="o2o", old="places", new="place")
_OTHER = "(SELECT ocel_id FROM object WHERE ocel_type = 'nations' AND ocel_id <> (SELECT ocel_target_id FROM o2o WHERE ocel_qualifier = 'located in' ORDER BY row_id LIMIT 1) ORDER BY row_id LIMIT 1 OFFSET 2)"
_changes("retarget", "retarget", "object_object", _patched("o2o", "ocel_qualifier = 'located in'", _O2O, "ocel_target_id", _OTHER), relation="o2o", qualifier="located in", skip=2)

# hints, scalar functions and scores

_query(
    "e8_hints",
    lambda log: batch.attach_hints(log, detectors.missing_attribute_value(log).where("object_type = 'customers'")).select("ocel_id", "attribute", "n", "n_null", "is_vocabulary"),
    oracle(""", v AS (SELECT ocel_id, ocel_changed_field, unnest(['name', 'acctbal', 'segment']) AS attribute, unnest([name, CAST(acctbal AS varchar), segment]) AS value FROM customers),
 f AS (SELECT attribute, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null, attribute <> 'acctbal' AND count(DISTINCT value) <= 10 AS is_vocabulary FROM v GROUP BY 1)
 SELECT ocel_id, attribute, n, n_null, is_vocabulary FROM v JOIN f USING (attribute) WHERE ocel_changed_field IS NULL AND (value IS NULL OR trim(value) = '')"""),
)
_query("e2_name_like_types", lambda log: profile.name_like_types(log), oracle(" SELECT DISTINCT ocel_type, false AS name_like FROM object WHERE ocel_type IS NOT NULL"))
_query("w7_id_prefixes", lambda log: log.e2o.groupBy(values.id_prefix(F.col("ocel_event_id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), oracle(" SELECT left(string_split(ocel_event_id, '-')[1], 8) AS prefix, count(*) AS n FROM e2o GROUP BY 1"))
_query("j15_first_event_rows", lambda log: sampling.event_time(log, skip_blank=False), oracle(" SELECT ocel_id, ocel_time FROM (SELECT 0 AS o, row_id, ocel_id, ocel_time FROM place UNION ALL SELECT 1, row_id, ocel_id, ocel_time FROM ship UNION ALL SELECT 2, row_id, ocel_id, ocel_time FROM click) AS t QUALIFY row_number() OVER (PARTITION BY ocel_id ORDER BY o, row_id DESC, ocel_time) = 1"))


def _coerced(log: Log) -> DataFrame:
    text = F.concat(F.col("size").cast("string"), F.when(F.col("size") % 3 == 0, ".5").when(F.col("size") % 3 == 1, ".0").otherwise("x"))
    return repair.frame(log, "object_Products").select("ocel_id", values.to_affinity(text, "INTEGER").cast("string").alias("as_integer"), values.to_affinity(text, "REAL").alias("as_real"), values.to_affinity(text, "TEXT").alias("as_text"))


_query("f7_coerced_values", _coerced, oracle(" SELECT ocel_id, CASE WHEN size % 3 = 1 THEN CAST(size AS varchar) END AS as_integer, CASE size % 3 WHEN 0 THEN size + 0.5::double WHEN 1 THEN CAST(size AS double) END AS as_real, CAST(size AS varchar) || CASE size % 3 WHEN 0 THEN '.5' WHEN 1 THEN '.0' ELSE 'x' END AS as_text FROM products"))


def _matched(log: Log) -> DataFrame:
    hidden, truth = evaluate.plant(log, "object_Products", "brand", 12)
    planted = truth.select(F.lit("products").alias("object_type"), "ocel_id", F.col("column").alias("attribute"))
    return evaluate.match_violations(detectors.missing_attribute_value(hidden), planted).select("object_type", "ocel_id", "attribute")


_query("v2_matched_violations", _matched, f"SELECT 'products' AS object_type, ocel_id, \"column\" AS attribute FROM ({base.ORACLES['v1_plant']}) AS t")


def _scored(log: Log) -> DataFrame:
    """A row for each arm and customer: the balance, wrong for some."""
    rows = repair.frame(log, "object_Customers").where("ocel_changed_field is null and acctbal is not null")

    def arm(name: str, off: Column) -> DataFrame:
        said = F.col("acctbal") * F.when(off, 2.0).otherwise(1.0)
        return rows.select(F.lit(name).alias("arm"), "ocel_id", F.when(F.col("row_id") % 4 == 0, "acctbal").otherwise("balance").alias("attribute"), said.cast("string").alias("proposed"), F.col("acctbal").cast("string").alias("true_value"))

    return evaluate.score(arm("with", F.col("row_id") % 6 == 0).unionAll(arm("without", F.col("row_id") % 10 == 0)))


_query(
    "v4_side_by_side",
    lambda log: evaluate.side_by_side(_scored(log), "with", "without").select("ocel_id", "attribute", "a_exact", "b_exact"),
    oracle(" SELECT ocel_id, CASE WHEN row_id % 4 = 0 THEN 'acctbal' ELSE 'balance' END AS attribute, row_id % 6 <> 0 OR acctbal = 0 AS a_exact, row_id % 10 <> 0 OR acctbal = 0 AS b_exact FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NOT NULL"),
)


def _across_runs(log: Log) -> DataFrame:
    folder = f"{shared_dir(log.spark)}/runs-{uuid.uuid4().hex}"
    _scored(log).write.json(f"{folder}/first")
    _scored(log).where("arm = 'with'").write.json(f"{folder}/second")
    return evaluate.across_runs(log.spark, f"{folder}/*")


_query(
    "v5_hits_across_runs",
    _across_runs,
    oracle(""", s AS (SELECT 'with' AS arm, row_id % 4 = 0 AS a, row_id % 6 <> 0 OR acctbal = 0 AS hit FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NOT NULL UNION ALL SELECT 'without', row_id % 4 = 0, row_id % 10 <> 0 OR acctbal = 0 FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NOT NULL)
 SELECT run, arm, count(*) FILTER (WHERE hit AND a) AS acctbal, count(*) FILTER (WHERE hit AND NOT a) AS balance FROM s, (VALUES ('first'), ('second')) AS r(run) WHERE run = 'first' OR arm = 'with' GROUP BY 1, 2"""),
)
_query(
    "z2_latest_flags",
    lambda log: repair.latest_flags(log.e2o.where("ocel_qualifier = 'user'").select(F.lit("incorrect_event_type").alias("issue"), F.col("ocel_object_id").alias("ocel_id"), F.lit("ocel_type").alias("attribute"), F.col("row_id").alias("at"), F.expr("CASE WHEN row_id % 3 = 0 THEN 'confirmed' ELSE 'dismissed' END").alias("state"))),
    oracle(" SELECT 'incorrect_event_type' AS issue, ocel_object_id AS ocel_id, 'ocel_type' AS attribute, max(row_id) AS at, CASE WHEN max(row_id) % 3 = 0 THEN 'confirmed' ELSE 'dismissed' END AS state FROM e2o WHERE ocel_qualifier = 'user' GROUP BY 2"),
)
