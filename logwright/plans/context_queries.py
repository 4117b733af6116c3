"""Queries for contexts, replies and dispatch, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwright.functions import replies
from logwright.log import Log
from logwright.operators import batch, context, detectors, dispatch, repair
from logwright.plans.bridge import load, oracle
from logwright.plans.queries import _SEED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make: Callable[[Log], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir))
    ORACLES[name] = oracle(sql)


def _replies(log: Log) -> DataFrame:
    """What a resolver may say of each product: fenced, plain, wrong or cut off."""
    said = F.concat(F.lit('{"value": "'), F.col("brand"), F.lit(' ", "sure": true, "confidence": 0.5, "names": ["a", " ", 3, " b "]}'))
    other = F.lit('{"value": 7, "sure": "yes", "confidence": "high"}')
    kinds = [F.concat(F.lit("```json\n"), said, F.lit("\n```")), F.concat(F.lit(" "), said, F.lit("\n")), other, F.substring(said, 1, 20)]
    reply = F.element_at(F.array(*kinds), (F.col("size") % 4 + 1).cast("int"))
    return repair.frame(log, "object_Products").select("ocel_id", "brand", reply.alias("reply"))


def _checked(log: Log) -> DataFrame:
    rows = _replies(log).withColumn("c", replies.checked(F.col("reply"), {"value": "string", "confidence": "double"}))
    return rows.select("ocel_id", F.try_variant_get("c.value", "$.confidence", "double").alias("confidence"), F.col("c.error").alias("error"))


_query(
    "f13_checked_replies",
    _checked,
    " SELECT ocel_id, CASE WHEN size % 4 < 2 THEN 0.5::double END AS confidence, CASE size % 4 WHEN 2 THEN 'value: no string; confidence: no double' WHEN 3 THEN 'reply is not valid JSON' END AS error FROM products",
)
_query(
    "f12_without_fences",
    lambda log: _replies(log).select("ocel_id", replies.strip_fences(F.col("reply")).alias("reply")),
    """ SELECT ocel_id, CASE size % 4 WHEN 2 THEN '{"value": 7, "sure": "yes", "confidence": "high"}' WHEN 3 THEN rtrim(left('{"value": "' || brand || ' ", "sure": true, "confidence": 0.5, "names": ["a", " ", 3, " b "]}', 20)) ELSE '{"value": "' || brand || ' ", "sure": true, "confidence": 0.5, "names": ["a", " ", 3, " b "]}' END AS reply FROM products""",
)


def _coerced(log: Log) -> DataFrame:
    rows = _replies(log).withColumn("v", replies.parsed(F.col("reply")))
    v = F.col("v")
    return rows.select(
        "ocel_id", replies.as_str(v, "$.value", "none").alias("value"), replies.as_bool(v, "$.sure").alias("sure"), replies.as_enum(v, "$.confidence", ["high"], "low").alias("level"), F.array_join(replies.as_str_list(v, "$.names"), "|").alias("names")
    )


_query(
    "f9_coerced_replies",
    _coerced,
    " SELECT ocel_id, CASE WHEN size % 4 < 2 THEN brand ELSE 'none' END AS value, size % 4 < 2 AS sure, CASE WHEN size % 4 = 2 THEN 'high' ELSE 'low' END AS level, CASE WHEN size % 4 < 2 THEN 'a|b' ELSE '' END AS names FROM products",
)


def _overrides(log: Log) -> DataFrame:
    size = F.col("size")
    typed = F.when(size % 5 == 0, " ").when(size % 5 == 1, size.cast("string")).when(size % 5 == 2, F.concat(F.lit(' {"a":'), size.cast("string"), F.lit("} "))).when(size % 5 == 3, F.concat(F.lit(" "), F.col("brand")))
    return repair.frame(log, "object_Products").withColumn("o", replies.parse_override(typed)).select("ocel_id", F.col("o.is_json").alias("is_json"), F.col("o.value").alias("value"))


_query(
    "f11_overrides",
    _overrides,
    """ SELECT ocel_id, size % 5 IN (1, 2) AS is_json, CASE size % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(size AS varchar) WHEN 2 THEN '{"a":' || size || '}' WHEN 3 THEN ' ' || brand END AS value FROM products""",
)


def _hashed(log: Log) -> DataFrame:
    rows = detectors.o2o_self_loop(log)
    return rows.select("ocel_source_id", replies.row_hash("o2o_self_loop", rows).alias("row_hash"))


_query(
    "f10_row_hashes",
    _hashed,
    """ SELECT ocel_source_id, left(sha256('{"k":"o2o_self_loop","r":{"ocel_qualifier":"' || ocel_qualifier || '","ocel_source_id":"' || ocel_source_id || '","ocel_target_id":"' || ocel_target_id || '"}}'), 16) AS row_hash FROM o2o WHERE ocel_source_id = ocel_target_id""",
)


def _candidates(log: Log) -> DataFrame:
    types = {"object": "products", "event": "ship item"}
    parts = [dispatch.candidates(log, i, types[dispatch.kind(i)]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("issue"), F.lit(dispatch.noun(i)).alias("noun"), F.lit(dispatch.kind(i)).alias("kind"), "n") for i in (*dispatch.JUDGED, "unknown")]
    return reduce(DataFrame.unionAll, parts)


_query(
    "g8_dispatch",
    _candidates,
    """ SELECT 'incorrect_object_type' AS issue, 'object' AS noun, 'object' AS kind, count(*) AS n FROM object WHERE ocel_type = 'products'
 UNION ALL SELECT 'incorrect_event_type', 'event', 'event', count(*) FROM event WHERE ocel_type = 'ship item'
 UNION ALL SELECT 'incorrect_event_time', 'event time', 'event', count(*) FROM ship
 UNION ALL SELECT 'incorrect_attribute_value', 'attribute value', 'object', count(*) FILTER (WHERE trim(name) <> '') + count(*) FILTER (WHERE trim(brand) <> '') + count(*) FILTER (WHERE trim(kind) <> '') + count(size) FROM products
 UNION ALL SELECT 'incorrect_event_attribute_value', 'event attribute value', 'event', count(quantity) FROM ship
 UNION ALL SELECT 'missing_object_attribute', 'type schema', 'object', 1 UNION ALL SELECT 'missing_event_attribute', 'event type schema', 'event', 1 UNION ALL SELECT 'unknown', 'candidate', 'object', 0""",
)
_query(
    "z4_shown_columns",
    lambda log: detectors.dangling_e2o_relationship(log).groupBy(F.array_join(dispatch.shown_columns("dangling_e2o_relationship"), ",").alias("shown")).agg(F.count(F.lit(1)).alias("n")),
    " SELECT CASE WHEN ocel_event_id NOT IN (SELECT ocel_id FROM event) AND ocel_object_id NOT IN (SELECT ocel_id FROM object) THEN 'ocel_event_id,ocel_object_id' WHEN ocel_event_id NOT IN (SELECT ocel_id FROM event) THEN 'ocel_event_id' ELSE 'ocel_object_id' END AS shown, count(*) AS n FROM e2o WHERE ocel_event_id NOT IN (SELECT ocel_id FROM event) OR ocel_object_id NOT IN (SELECT ocel_id FROM object) GROUP BY 1",
)
_query(
    "x11_routable_actions",
    lambda log: dispatch.routable(batch.plan_actions(log, "duplicate_objects_on_ids", detectors.duplicate_objects_on_ids(log))).groupBy("kind", "routable").agg(F.count(F.lit(1)).alias("n")),
    ", g AS ( SELECT ocel_id, coalesce(string_agg(DISTINCT ocel_type, ', '), '') AS types FROM object GROUP BY 1 HAVING count(*) > 1 ) SELECT CASE WHEN types = '' OR contains(types, ',') THEN 'noop' ELSE 'delete' END AS kind, NOT (types = '' OR contains(types, ',')) AS routable, count(*) AS n FROM g GROUP BY 1, 2",
)
_WINDOW = """, gone AS ( SELECT DISTINCT ocel_object_id, ocel_event_id AS excluded FROM e2o WHERE ocel_event_id NOT IN (SELECT ocel_id FROM event) ),
 v AS ( SELECT ocel_id, min(ocel_type) AS ocel_type FROM event GROUP BY 1 ), moments AS ( SELECT ocel_id, ocel_time FROM ( SELECT 0 AS o, row_id, ocel_id, ocel_time FROM place UNION ALL SELECT 1, row_id, ocel_id, ocel_time FROM ship UNION ALL SELECT 2, row_id, ocel_id, ocel_time FROM click ) AS t QUALIFY row_number() OVER (PARTITION BY ocel_id ORDER BY o, row_id DESC, ocel_time) = 1 ),
 own AS ( SELECT e2o.ocel_object_id, e2o.ocel_event_id, any_value(v.ocel_type) AS ocel_type, min(row_id) AS row_id, arg_min(ocel_qualifier, row_id) AS ocel_qualifier FROM e2o JOIN v ON ocel_event_id = v.ocel_id WHERE ocel_object_id IN (SELECT ocel_object_id FROM gone) GROUP BY 1, 2 ),
 w AS ( SELECT own.*, excluded, row_number() OVER (PARTITION BY own.ocel_object_id, excluded ORDER BY row_id, ocel_event_id) AS place FROM own JOIN gone USING (ocel_object_id) WHERE ocel_event_id <> excluded QUALIFY place <= 8 )"""


def _gone(log: Log) -> DataFrame:
    return detectors.missing_event(log).select("ocel_object_id", F.col("ocel_event_id").alias("excluded"))


_query("j14_lifecycle_window", lambda log: context.lifecycle_window(log, _gone(log)), _WINDOW + " SELECT ocel_object_id, excluded, ocel_event_id, ocel_type, ocel_time, ocel_qualifier, place FROM w LEFT JOIN moments ON ocel_event_id = ocel_id")
_query(
    "j19_events_in_sequence",
    lambda log: context.events_in_sequence(log, "place order", "ship item", "order"),
    " SELECT a.ocel_event_id AS first_id, b.ocel_event_id AS second_id, place.ocel_time AS first_time, ship.ocel_time AS second_time FROM place JOIN e2o AS a ON place.ocel_id = a.ocel_event_id JOIN e2o AS b ON a.ocel_object_id = b.ocel_object_id AND b.ocel_qualifier = 'order' JOIN ship ON b.ocel_event_id = ship.ocel_id",
)
_query(
    "r20_contexts_of_missing_events",
    lambda log: context.contexts(log, "missing_event", detectors.missing_event(log)).select("anchor", F.get_json_object("violation", "$.ocel_object_id").alias("object"), F.get_json_object("violation", "$.ocel_qualifier").alias("qualifier"), F.transform(F.col("events"), lambda x: x["ocel_event_id"]).alias("e")).select("anchor", "object", "qualifier", F.array_join("e", ",").alias("events")),
    _WINDOW + ", listed AS ( SELECT ocel_object_id, excluded, string_agg(ocel_event_id, ',' ORDER BY place) AS events FROM w GROUP BY 1, 2 ), d AS ( SELECT DISTINCT ocel_event_id, ocel_object_id, ocel_qualifier FROM e2o WHERE ocel_event_id NOT IN (SELECT ocel_id FROM event) ) SELECT ocel_event_id AS anchor, d.ocel_object_id AS object, ocel_qualifier AS qualifier, events FROM d LEFT JOIN listed ON d.ocel_object_id = listed.ocel_object_id AND ocel_event_id = excluded",
)
_query(
    "r11_contexts_of_dangling_relations",
    lambda log: context.contexts(log, "dangling_o2o_relationship", detectors.dangling_o2o_relationship(log)).groupBy("anchor_type", F.array_join("candidates", ",").alias("candidates")).agg(F.count(F.lit(1)).alias("n")),
    f""", k AS ( SELECT ocel_id, min(ocel_type) AS t FROM object GROUP BY 1 ), d AS ( SELECT DISTINCT x.t AS anchor_type, ocel_source_id, ocel_target_id, ocel_qualifier, split_part(CASE WHEN x.ocel_id IS NULL AND y.ocel_id IS NOT NULL THEN ocel_source_id ELSE ocel_target_id END, '-', 1) AS prefix FROM o2o LEFT JOIN k AS x ON ocel_source_id = x.ocel_id LEFT JOIN k AS y ON ocel_target_id = y.ocel_id WHERE x.ocel_id IS NULL OR y.ocel_id IS NULL ),
 p AS ( SELECT ocel_id, split_part(ocel_id, '-', 1) AS prefix, min(row_id) AS row_id FROM object WHERE ocel_id IS NOT NULL GROUP BY 1 ), f AS ( SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY row_id % 2147483647 * 2654435761 % 2147483647, row_id) AS place FROM p QUALIFY place <= 50 ), l AS ( SELECT prefix, string_agg(ocel_id, ',' ORDER BY place) AS candidates FROM f GROUP BY 1 )
 SELECT anchor_type, candidates, count(*) AS n FROM d LEFT JOIN l USING (prefix) GROUP BY 1, 2""",
)
_query(
    "r04_contexts_of_missing_cells",
    lambda log: context.contexts(log, "missing_attribute_value", detectors.missing_attribute_value(log)).select("anchor", F.get_json_object("violation", "$.attribute").alias("attribute"), "anchor_type", F.array_join("peers", ",").alias("peers")),
    f""", c AS ( SELECT ocel_id, row_id, 'acctbal' AS attribute FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NULL UNION ALL SELECT ocel_id, row_id, 'segment' FROM customers WHERE ocel_changed_field IS NULL AND (segment IS NULL OR trim(segment) = '') UNION ALL SELECT ocel_id, row_id, 'name' FROM customers WHERE ocel_changed_field IS NULL AND (name IS NULL OR trim(name) = '') ),
 a AS ( SELECT DISTINCT ocel_id AS anchor, {_SEED.format('ocel_id')} AS seed FROM c ), o AS ( SELECT anchor, ocel_id AS peer, row_number() OVER (PARTITION BY anchor ORDER BY (row_id % 2147483647 * 2654435761 % 2147483647 + seed) % 2147483647) AS k FROM a, customers WHERE ocel_changed_field IS NULL AND ocel_id <> anchor QUALIFY k <= 5 ), l AS ( SELECT anchor, string_agg(peer, ',' ORDER BY k) AS peers FROM o GROUP BY 1 )
 SELECT ocel_id AS anchor, attribute, 'customers' AS anchor_type, peers FROM c JOIN l ON ocel_id = anchor""",
)
