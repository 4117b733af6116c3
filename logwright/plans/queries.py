"""Queries over the log made of the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwright.functions import values
from logwright.log import Log
from logwright.operators import detectors, evaluate, profile, repair, sampling
from logwright.plans.bridge import load, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, make: Callable[[Log], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = oracle(sql)


def _detector(number: int, name: str, sql: str, columns: list[str] | None = None) -> None:
    make = detectors.DETECTORS[name]
    _query(f"d{number:02d}_{name}", lambda log: make(log).select(*columns) if columns else make(log), sql)


_BLANK = "({0} IS NULL OR trim({0}) = '')"
_detector(1, "missing_object_type", f" SELECT ocel_id, ocel_type, 'missing_object_type' AS issue FROM object WHERE {_BLANK.format('ocel_type')}")
_CELLS = """
 SELECT 'customers' AS object_type, ocel_id, a AS attribute, v AS actual_value, 'missing_attribute_value' AS issue FROM (
  SELECT ocel_id, 'name' AS a, name AS v FROM customers WHERE ocel_changed_field IS NULL
  UNION ALL SELECT ocel_id, 'acctbal', CASE WHEN acctbal IS NOT NULL THEN 'x' END FROM customers WHERE ocel_changed_field IS NULL
  UNION ALL SELECT ocel_id, 'segment', segment FROM customers WHERE ocel_changed_field IS NULL
 ) AS c WHERE v IS NULL OR trim(v) = ''"""
_detector(2, "missing_attribute_value", _CELLS)
_detector(3, "missing_event_attribute_value", " SELECT 'ship item' AS event_type, ocel_id, 'returnflag' AS attribute, returnflag AS actual_value, 'missing_event_attribute_value' AS issue FROM ship WHERE trim(returnflag) = ''")


def _repeated(table: str, issue: str) -> str:
    return f" SELECT ocel_id, coalesce(string_agg(DISTINCT ocel_type, ', ' ORDER BY ocel_type), '') AS ocel_types, CAST(count(*) AS varchar) AS count, '{issue}' AS issue FROM {table} GROUP BY ocel_id HAVING count(*) > 1"


_detector(4, "duplicate_objects_on_ids", _repeated("object", "duplicate_objects_on_ids"))
_D5 = " SELECT 'products' AS object_type, string_agg(ocel_id, ', ' ORDER BY row_id) AS ocel_ids, CAST(count(*) AS varchar) AS duplicate_count, 'duplicate_objects_on_attributes' AS issue FROM products GROUP BY name, brand, kind, size HAVING count(*) > 1"
_D5 += " UNION ALL SELECT 'orders', string_agg(ocel_id, ', ' ORDER BY row_id), CAST(count(*) AS varchar), 'duplicate_objects_on_attributes' FROM orders_t GROUP BY status, coalesce(price_text, CAST(price_number AS varchar)), priority HAVING count(*) > 1"
_detector(5, "duplicate_objects_on_attributes", _D5, ["object_type", "ocel_ids", "duplicate_count", "issue"])
_detector(6, "duplicate_events_on_ids", _repeated("event", "duplicate_events_on_ids"))
_query(
    "d07_duplicate_events_on_attributes",
    lambda log: detectors.duplicate_events_on_attributes(log).select("event_type", "duplicate_count", F.size(F.split("ocel_ids", ", ")).cast("long").alias("n_ids"), F.md5("ocel_ids").alias("ids_md5"), "issue"),
    " SELECT 'ship item' AS event_type, CAST(count(*) AS varchar) AS duplicate_count, count(*) AS n_ids, md5(string_agg(ocel_id, ', ' ORDER BY row_id, ocel_id)) AS ids_md5, 'duplicate_events_on_attributes' AS issue FROM ship GROUP BY quantity, returnflag HAVING count(*) > 1"
    " UNION ALL SELECT 'click', CAST(count(*) AS varchar), count(*), md5(string_agg(ocel_id, ', ' ORDER BY row_id, ocel_id)), 'duplicate_events_on_attributes' FROM click GROUP BY value HAVING count(*) > 1",
)


def _triples(table: str, a: str, b: str, issue: str) -> str:
    return f" SELECT {a}, {b}, ocel_qualifier, CAST(count(*) AS varchar) AS count, '{issue}' AS issue FROM {table} GROUP BY {a}, {b}, ocel_qualifier HAVING count(*) > 1"


_detector(8, "duplicate_o2o_relations", _triples("o2o", "ocel_source_id", "ocel_target_id", "duplicate_o2o_relations"))
_detector(9, "o2o_self_loop", " SELECT ocel_source_id, ocel_target_id, ocel_qualifier, 'o2o_self_loop' AS issue FROM o2o WHERE ocel_source_id = ocel_target_id")
_detector(10, "duplicate_e2o_relations", _triples("e2o", "ocel_event_id", "ocel_object_id", "duplicate_e2o_relations"))
_detector(11, "incorrect_attribute_datatype", " SELECT 'orders' AS object_type, ocel_id, 'price' AS attribute, 'REAL' AS expected_type, '''' || price_text || '''' AS actual_value, 'str' AS actual_python_type, 'incorrect_attribute_datatype' AS issue FROM orders_t WHERE price_text IS NOT NULL")
_detector(12, "incorrect_event_attribute_datatype", " SELECT 'ship item' AS event_type, ocel_id, 'returnflag' AS attribute, 'INTEGER' AS expected_type, '''' || returnflag || '''' AS actual_value, 'str' AS actual_python_type, 'incorrect_event_attribute_datatype' AS issue FROM ship WHERE trim(returnflag) <> ''")


def _dangling(table: str, a: str, b: str, left: str, right: str, side_a: str, side_b: str, issue: str) -> str:
    return f""" SELECT r.{a}, x.t AS {side_a}_type, r.{b}, y.t AS {side_b}_type, r.ocel_qualifier, CASE WHEN x.k IS NULL AND y.k IS NULL THEN 'both' WHEN x.k IS NULL THEN '{side_a}' ELSE '{side_b}' END AS missing_side, '{issue}' AS issue
 FROM {table} AS r LEFT JOIN (SELECT ocel_id AS k, min(ocel_type) AS t FROM {left} GROUP BY 1) AS x ON r.{a} = x.k LEFT JOIN (SELECT ocel_id AS k, min(ocel_type) AS t FROM {right} GROUP BY 1) AS y ON r.{b} = y.k WHERE x.k IS NULL OR y.k IS NULL"""


_detector(13, "dangling_o2o_relationship", _dangling("o2o", "ocel_source_id", "ocel_target_id", "object", "object", "source", "target", "dangling_o2o_relationship"))
_detector(14, "dangling_e2o_relationship", _dangling("e2o", "ocel_event_id", "ocel_object_id", "event", "object", "event", "object", "dangling_e2o_relationship"))
_detector(15, "missing_event_timestamp", " SELECT ocel_id, 'place order' AS event_type, 'event_PlaceOrder' AS target_table, ocel_time AS actual_value, 'missing_event_timestamp' AS issue FROM place WHERE ocel_time IS NULL OR ocel_time = ''")
_detector(16, "missing_event", " SELECT ocel_event_id, ocel_object_id, ocel_qualifier, 'missing_event' AS issue FROM e2o WHERE ocel_event_id NOT IN ( SELECT ocel_id FROM event )")
_detector(17, "missing_event_type", f" SELECT ocel_id, ocel_type, 'missing_event_type' AS issue FROM event WHERE {_BLANK.format('ocel_type')}")
_INFER = "CASE WHEN starts_with(ocel_object_id, 'orders:') THEN 'orders' WHEN ocel_qualifier IN ('customer', 'customers') THEN 'customers' WHEN ocel_qualifier IN ('order', 'orders') THEN 'orders' WHEN ocel_qualifier IN ('product', 'products') THEN 'products' WHEN ocel_qualifier IN ('supplier', 'suppliers') THEN 'suppliers' WHEN ocel_qualifier IN ('nation', 'nations') THEN 'nations' END"
_D18 = f" SELECT ocel_object_id, {_INFER} AS inferred_type_from_prefix, ocel_event_id, ocel_qualifier, 'missing_object' AS issue FROM e2o WHERE ocel_object_id NOT IN ( SELECT ocel_id FROM object ) AND {_INFER} IS NOT NULL"
_detector(18, "missing_object", _D18)


def _counts() -> str:
    parts = []
    for name in detectors.DETECTORS:
        key = next(k for k in ORACLES if k[4:] == name)
        parts.append(f"SELECT '{name}' AS issue, (SELECT count(*) FROM ({ORACLES[key]})) AS n")
    return " UNION ALL ".join(parts)


_query("d19_issue_counts", detectors.issue_counts, None)
ORACLES["d19_issue_counts"] = _counts()
_query("a14_issue_counts_by_relation", lambda log: detectors.issue_counts(log).where(F.col("issue").contains("relation")), None)
ORACLES["a14_issue_counts_by_relation"] = f"SELECT * FROM ({_counts()}) WHERE issue LIKE '%relation%'"
_query("a15_issue_grid", detectors.issue_grid, None)
ORACLES["a15_issue_grid"] = f"SELECT entity, category, CAST(sum(n) AS bigint) AS n FROM ({_counts()}) JOIN (VALUES {', '.join(f'({e!r}, {c!r}, {d!r})' for e, c, ds in detectors.GRID for d in ds)}) AS g(entity, category, issue) USING (issue) GROUP BY entity, category"
_query(
    "d20_type_correct_object_cells",
    lambda log: detectors.type_correct_cells(log, "object").groupBy("object_type", "attribute", "expected_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ocel_id").alias("ids")),
    """ SELECT 'customers' AS object_type, 'name' AS attribute, 'TEXT' AS expected_type, count(*) AS n, count(DISTINCT ocel_id) AS ids FROM customers WHERE trim(name) <> ''
 UNION ALL SELECT 'customers', 'acctbal', 'REAL', count(*), count(DISTINCT ocel_id) FROM customers WHERE acctbal IS NOT NULL
 UNION ALL SELECT 'customers', 'segment', 'TEXT', count(*), count(DISTINCT ocel_id) FROM customers WHERE trim(segment) <> ''
 UNION ALL SELECT 'orders', 'status', 'TEXT', count(*), count(DISTINCT ocel_id) FROM orders_t WHERE trim(status) <> ''
 UNION ALL SELECT 'orders', 'price', 'REAL', count(*), count(DISTINCT ocel_id) FROM orders_t WHERE price_text IS NULL
 UNION ALL SELECT 'orders', 'priority', 'TEXT', count(*), count(DISTINCT ocel_id) FROM orders_t WHERE trim(priority) <> ''
 UNION ALL SELECT 'products', 'name', 'TEXT', count(*), count(DISTINCT ocel_id) FROM products WHERE trim(name) <> ''
 UNION ALL SELECT 'products', 'brand', 'TEXT', count(*), count(DISTINCT ocel_id) FROM products WHERE trim(brand) <> ''
 UNION ALL SELECT 'products', 'kind', 'TEXT', count(*), count(DISTINCT ocel_id) FROM products WHERE trim(kind) <> ''
 UNION ALL SELECT 'products', 'size', 'INTEGER', count(*), count(DISTINCT ocel_id) FROM products WHERE size IS NOT NULL""",
)
_query(
    "d21_type_correct_event_cells",
    lambda log: detectors.type_correct_cells(log, "event").select("event_type", "ocel_id", "attribute", "expected_type", "issue"),
    " SELECT 'ship item' AS event_type, ocel_id, 'quantity' AS attribute, 'REAL' AS expected_type, 'incorrect_event_attribute_value' AS issue FROM ship WHERE quantity IS NOT NULL UNION ALL SELECT 'click', ocel_id, 'value', 'REAL', 'incorrect_event_attribute_value' FROM click WHERE value IS NOT NULL",
)

# profile

_BY_TYPE = " SELECT ocel_qualifier AS qualifier, ocel_type, count(*) AS n FROM e2o JOIN {0} AS x ON ocel_{0}_id = x.ocel_id WHERE ocel_qualifier IS NOT NULL AND ocel_type IS NOT NULL GROUP BY 1, 2"
_query("a05_e2o_qualifier_by_object_type", lambda log: profile.qualifier_by_type(log, "object"), _BY_TYPE.format("object"))
_query("a05_e2o_qualifier_by_event_type", lambda log: profile.qualifier_by_type(log, "event"), _BY_TYPE.format("event"))
_query("a05_o2o_qualifier_type_pairs", profile.o2o_type_pairs, " SELECT ocel_qualifier AS qualifier, a.ocel_type || ' -> ' || b.ocel_type AS pair, count(*) AS n FROM o2o JOIN object AS a ON ocel_source_id = a.ocel_id JOIN object AS b ON ocel_target_id = b.ocel_id WHERE a.ocel_type IS NOT NULL AND b.ocel_type IS NOT NULL GROUP BY 1, 2")
_query("a06_type_histogram", lambda log: profile.type_histogram(log, "object").select(F.lit("object").alias("kind"), "*").unionAll(profile.type_histogram(log, "event").select(F.lit("event"), "*")), " SELECT 'object' AS kind, ocel_type, count(*) AS n FROM object GROUP BY 2 UNION ALL SELECT 'event', ocel_type, count(*) FROM event GROUP BY 2")
_query("a07_qualifier_histogram", profile.qualifier_histogram, " SELECT 'e2o' AS relation, ocel_qualifier AS qualifier, count(*) AS n FROM e2o GROUP BY 2 UNION ALL SELECT 'o2o', ocel_qualifier, count(*) FROM o2o GROUP BY 2")
_query(
    "a08_qualifier_outliers",
    profile.qualifier_outliers,
    """, t AS ( SELECT ocel_qualifier AS qualifier, ocel_type, count(*) AS n FROM e2o JOIN object AS x ON ocel_object_id = x.ocel_id WHERE ocel_type IS NOT NULL GROUP BY 1, 2 ),
 r AS ( SELECT *, sum(n) OVER (PARTITION BY qualifier) AS total, max(n) OVER (PARTITION BY qualifier) AS top, first(ocel_type) OVER (PARTITION BY qualifier ORDER BY n DESC, ocel_type) AS dominant_type FROM t ),
 i AS ( SELECT DISTINCT r.qualifier, r.ocel_type, r.n, CAST(r.total AS bigint) AS total, r.dominant_type, ocel_object_id AS object_id FROM r JOIN e2o ON ocel_qualifier = r.qualifier JOIN object AS x ON ocel_object_id = x.ocel_id AND x.ocel_type = r.ocel_type WHERE top >= 0.8 * total AND r.ocel_type <> dominant_type )
 SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY qualifier, ocel_type ORDER BY object_id) <= 50""",
)
_IDS = "( SELECT DISTINCT ocel_type, ocel_id FROM object WHERE ocel_id IS NOT NULL AND ocel_type IS NOT NULL )"
_query("a09_id_buckets", profile.id_buckets, f" SELECT ocel_type, CASE WHEN regexp_matches(ocel_id, '^[a-zA-Z]+[-_:][0-9]+') THEN 'prefixed_id_like' ELSE 'opaque_token_like' END AS shape, count(*) AS n FROM {_IDS} GROUP BY 1, 2")
_query("a09_id_examples", profile.id_examples, f" SELECT ocel_type, 'prefixed_id_like' AS shape, ocel_id AS example FROM {_IDS} QUALIFY row_number() OVER (PARTITION BY ocel_type ORDER BY ocel_id) <= 8")
_query("a10_id_templates", profile.id_templates, f", t AS ( SELECT ocel_type, regexp_replace(ocel_id, '[0-9]', '#', 'g') AS template, count(*) AS n FROM {_IDS} GROUP BY 1, 2 ) SELECT ocel_type, template, n, CAST(sum(n) OVER (PARTITION BY ocel_type) AS bigint) AS total FROM t QUALIFY row_number() OVER (PARTITION BY ocel_type ORDER BY n DESC, template) <= 3")
_query(
    "e1_column_profile",
    lambda log: profile.column_profile(log, "object"),
    " SELECT t AS ocel_type, a AS attribute, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_null FROM ( SELECT 'customers' AS t, 'name' AS a, name AS v FROM customers UNION ALL SELECT 'customers', 'acctbal', CAST(acctbal AS varchar) FROM customers UNION ALL SELECT 'customers', 'segment', segment FROM customers"
    " UNION ALL SELECT 'orders', 'status', status FROM orders_t UNION ALL SELECT 'orders', 'price', coalesce(price_text, CAST(price_number AS varchar)) FROM orders_t UNION ALL SELECT 'orders', 'priority', priority FROM orders_t"
    " UNION ALL SELECT 'products', 'name', name FROM products UNION ALL SELECT 'products', 'brand', brand FROM products UNION ALL SELECT 'products', 'kind', kind FROM products UNION ALL SELECT 'products', 'size', CAST(size AS varchar) FROM products ) AS c GROUP BY t, a",
)
_query(
    "e1_column_samples",
    lambda log: profile.column_samples(log, "object").where("attribute not in ('acctbal', 'price')").select("ocel_type", "attribute", F.array_join("samples", "|").alias("samples"), "is_vocabulary"),
    """, v AS ( SELECT DISTINCT 'customers' AS ocel_type, 'segment' AS attribute, segment AS value FROM customers WHERE segment IS NOT NULL UNION SELECT 'customers', 'name', name FROM customers WHERE name IS NOT NULL UNION SELECT 'products', 'brand', brand FROM products WHERE brand IS NOT NULL UNION SELECT 'products', 'name', name FROM products WHERE name IS NOT NULL
 UNION SELECT 'products', 'kind', kind FROM products WHERE kind IS NOT NULL UNION SELECT 'products', 'size', CAST(size AS varchar) FROM products WHERE size IS NOT NULL UNION SELECT 'orders', 'status', status FROM orders_t WHERE status IS NOT NULL UNION SELECT 'orders', 'priority', priority FROM orders_t WHERE priority IS NOT NULL ),
 f AS ( SELECT *, row_number() OVER (PARTITION BY ocel_type, attribute ORDER BY value) AS k FROM v )
 SELECT ocel_type, attribute, string_agg(value, '|' ORDER BY k) AS samples, max(k) <= 10 AND attribute <> 'size' AS is_vocabulary FROM f WHERE k <= 15 GROUP BY 1, 2""",
)

# samples and context

_SEED = "list_reduce(list_concat([0::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 131 + c) & 2147483647)"


def _customers(log: Log) -> DataFrame:
    return log.object_tables[0].df.where("ocel_changed_field is null")


_query("w1_seeds", lambda log: log.object.select("ocel_id", values.seed_of(F.col("ocel_id")).alias("seed")).distinct(), f" SELECT DISTINCT ocel_id, {_SEED.format('ocel_id')} AS seed FROM object")
_query(
    "w3_peer_sample",
    lambda log: sampling.sample_peers(_customers(log).where("acctbal is null"), _customers(log), F.col("acctbal")),
    f""", a AS ( SELECT ocel_id AS anchor, {_SEED.format('ocel_id')} AS seed FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NULL ),
 o AS ( SELECT anchor, ocel_id AS peer_id, acctbal IS NOT NULL AS has, (row_id % 2147483647 * 2654435761 % 2147483647 + seed) % 2147483647 AS pos FROM a, customers WHERE ocel_changed_field IS NULL AND ocel_id <> anchor ),
 s AS ( SELECT *, row_number() OVER (PARTITION BY anchor, has ORDER BY pos) AS nth FROM o ),
 p AS ( SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY CASE WHEN has AND nth <= 2 THEN 0 ELSE 1 END, pos) AS place FROM s )
 SELECT anchor, peer_id, place FROM p WHERE place <= 5""",
)
_NEAR = ", anchors AS ( SELECT DISTINCT ocel_id AS anchor FROM event WHERE ocel_type IS NULL OR trim(ocel_type) = '' ), near AS ( SELECT DISTINCT a.ocel_event_id AS anchor, b.ocel_event_id AS neighbour FROM e2o AS a JOIN e2o AS b USING (ocel_object_id) WHERE a.ocel_event_id IN ( SELECT anchor FROM anchors ) AND a.ocel_event_id <> b.ocel_event_id )"
_TIMES = ", t0 AS ( SELECT 0 AS o, row_id, ocel_id, ocel_time FROM place UNION ALL SELECT 1, row_id, ocel_id, ocel_time FROM ship UNION ALL SELECT 2, row_id, ocel_id, ocel_time FROM click ), times AS ( SELECT ocel_id, ocel_time FROM t0 WHERE ocel_time <> '' QUALIFY row_number() OVER (PARTITION BY ocel_id ORDER BY o, row_id DESC, ocel_time) = 1 )"


def _anchors(log: Log) -> DataFrame:
    """Events that a detector flags."""
    return detectors.missing_event_type(log)


_query("j12_neighbor_events", lambda log: sampling.neighbours(log, _anchors(log)), _NEAR + " SELECT DISTINCT anchor, neighbour, ocel_type FROM near JOIN event ON neighbour = ocel_id")
_query(
    "w4_neighbor_window",
    lambda log: sampling.neighbour_window(log, _anchors(log)),
    _NEAR
    + _TIMES
    + """, n AS ( SELECT DISTINCT near.anchor, near.neighbour FROM near JOIN event ON neighbour = ocel_id ), j AS ( SELECT n.anchor, n.neighbour, x.ocel_time, y.ocel_time AS moment FROM n LEFT JOIN times AS x ON n.neighbour = x.ocel_id LEFT JOIN times AS y ON n.anchor = y.ocel_id ),
 s AS ( SELECT *, CASE WHEN moment IS NULL OR ocel_time IS NULL THEN 2 WHEN ocel_time <= moment THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY anchor ORDER BY ocel_time NULLS LAST, neighbour) AS k, count(*) OVER (PARTITION BY anchor) AS every FROM j ),
 d AS ( SELECT *, CASE side WHEN 0 THEN row_number() OVER (PARTITION BY anchor, side ORDER BY ocel_time DESC, neighbour DESC) WHEN 1 THEN row_number() OVER (PARTITION BY anchor, side ORDER BY ocel_time, neighbour) END AS close FROM s )
 SELECT anchor, neighbour, ocel_time FROM d QUALIFY every <= 10 OR row_number() OVER (PARTITION BY anchor ORDER BY CASE WHEN close <= 5 THEN 0 ELSE 1 END, k) <= 10""",
)
_query("j11_event_objects", lambda log: sampling.event_objects(log, log.event), ", o AS ( SELECT ocel_id, min(ocel_type) AS ocel_type FROM object GROUP BY 1 ) SELECT ocel_event_id, ocel_object_id, ocel_qualifier, ocel_type, row_number() OVER (PARTITION BY ocel_event_id ORDER BY row_id, ocel_object_id, ocel_qualifier) AS place FROM e2o LEFT JOIN o ON ocel_object_id = o.ocel_id WHERE ocel_event_id IN ( SELECT ocel_id FROM event ) QUALIFY place <= 8")
_query("j13_event_times", lambda log: sampling.event_time(log), _TIMES + " SELECT ocel_id, ocel_time FROM times")
_query("j14_object_events", lambda log: sampling.object_events(log, log.object), ", v AS ( SELECT ocel_id, min(ocel_type) AS ocel_type FROM event GROUP BY 1 ) SELECT ocel_object_id, ocel_event_id, ocel_type, row_number() OVER (PARTITION BY ocel_object_id ORDER BY row_id, ocel_event_id) AS place FROM e2o JOIN v ON ocel_event_id = v.ocel_id WHERE ocel_object_id IN ( SELECT ocel_id FROM object ) QUALIFY place <= 8")
_query("j18_events_with_neighbor", sampling.events_with_neighbour, ", s AS ( SELECT ocel_object_id FROM e2o GROUP BY 1 HAVING count(DISTINCT ocel_event_id) > 1 ) SELECT DISTINCT ocel_event_id FROM e2o WHERE ocel_object_id IN ( SELECT ocel_object_id FROM s )")
_POOL = " FROM ( SELECT ocel_id, min(row_id) AS row_id, min(ocel_type) AS ocel_type FROM object WHERE ocel_id IS NOT NULL GROUP BY 1 ) AS p"
_query("w5_candidate_pool", lambda log: sampling.candidate_pool(log.object, "c-97", "customer"), f", q AS ( SELECT ocel_id, 0 AS strand, row_number() OVER (ORDER BY (row_id % 2147483647 * 2654435761 + {_SEED.format(chr(39) + 'c-97' + chr(39))}) % 2147483647, row_id) AS place{_POOL} WHERE ocel_type = 'customers' ) SELECT * FROM q WHERE place <= 50")
_query("w5_candidate_pool_by_prefix", lambda log: sampling.candidate_pool(log.object, "s-99999"), f", q AS ( SELECT ocel_id, CASE WHEN ocel_id LIKE 's%' THEN 0 ELSE 1 END AS strand, (row_id % 2147483647 * 2654435761 + {_SEED.format(chr(39) + 's-99999' + chr(39))}) % 2147483647 AS pos, row_id{_POOL} ) SELECT ocel_id, strand, row_number() OVER (ORDER BY strand, pos, row_id) AS place FROM q QUALIFY place <= 200")
_query("w8_systematic_sample", lambda log: sampling.systematic_sample(log.object_tables[2].df, 12).select("ocel_id"), ", r AS ( SELECT ocel_id, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM products ) SELECT ocel_id FROM r WHERE k IN ( SELECT i * n // 12 FROM range(12) AS g(i) )")
_query("g1_type_candidates", lambda log: sampling.type_candidates(log, "object", "products"), " SELECT ocel_id, ocel_type FROM object WHERE ocel_type = 'products'")
_query("g2_event_type_candidates", lambda log: sampling.type_candidates(log, "event", "place order"), " SELECT ocel_id, ocel_type FROM event WHERE ocel_type = 'place order'")
_query("g3_event_time_candidates", lambda log: sampling.time_candidates(log, "place order"), " SELECT ocel_id, ocel_time, 'event_PlaceOrder' AS target_table FROM place")
_query("g6_schema_candidates", lambda log: sampling.schema_candidates(log, "object"), None)
ORACLES["g6_schema_candidates"] = "SELECT * FROM (VALUES ('customers', 'object_Customers', 'name TEXT, acctbal REAL, segment TEXT'), ('orders', 'object_Orders', 'status TEXT, price REAL, priority TEXT'), ('products', 'object_Products', 'name TEXT, brand TEXT, kind TEXT, size INTEGER'), ('suppliers', 'object_Suppliers', ''), ('nations', 'object_Nations', '')) AS t(ocel_type, \"table\", columns)"

# repairs

_query("x2_update", lambda log: repair.update(log, "object", {"ocel_type": None}, "ocel_type", "customers").object, " SELECT row_id, ocel_id, coalesce(ocel_type, 'customers') AS ocel_type FROM object")
_query("x3_dedupe_keep_min", lambda log: repair.dedupe_relations(log, "e2o").e2o, " SELECT min(row_id) AS row_id, ocel_event_id, ocel_object_id, ocel_qualifier FROM e2o GROUP BY 2, 3, 4")
_query("x3_dedupe_ids", lambda log: repair.dedupe_ids(log, "object").object, ", g AS ( SELECT ocel_id, count(DISTINCT CASE WHEN trim(ocel_type) <> '' THEN ocel_type END) AS types, count(*) AS n FROM object GROUP BY 1 ), k AS ( SELECT object.*, types, n, row_number() OVER (PARTITION BY object.ocel_id ORDER BY CASE WHEN trim(ocel_type) <> '' THEN 0 ELSE 1 END, row_id) AS place FROM object JOIN g USING (ocel_id) ) SELECT row_id, ocel_id, ocel_type FROM k WHERE n = 1 OR types <> 1 OR place = 1")
_query("x4_delete_all", lambda log: repair.drop_self_loops(log).o2o, " SELECT row_id, ocel_source_id, ocel_target_id, ocel_qualifier FROM o2o WHERE ocel_source_id <> ocel_target_id")


def _insert_missing(log: Log) -> DataFrame:
    gone = detectors.missing_object(log).select(F.col("ocel_object_id").alias("ocel_id"), F.col("inferred_type_from_prefix").alias("ocel_type"))
    first = gone.groupBy("ocel_id").agg(F.min("ocel_type").alias("ocel_type"))
    return log.object.select("ocel_id", "ocel_type").unionByName(first)


_query("x5_insert_missing", _insert_missing, f" SELECT ocel_id, ocel_type FROM object UNION ALL SELECT ocel_id, min(ocel_type) FROM ( SELECT ocel_object_id AS ocel_id, {_INFER} AS ocel_type FROM e2o WHERE ocel_object_id NOT IN ( SELECT ocel_id FROM object ) ) AS m WHERE ocel_type IS NOT NULL GROUP BY 1")
_query("x6_add_column", lambda log: repair.frame(repair.add_column(log, "object_products", "weight", "REAL"), "object_Products").select("ocel_id", "weight"), " SELECT ocel_id, CAST(NULL AS double) AS weight FROM products")
_query("r05_peer_mode", lambda log: repair.peer_mode(log, "customers", "segment"), ", m AS ( SELECT segment AS value FROM customers WHERE trim(segment) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1 ) SELECT ocel_id, value FROM customers, m WHERE segment IS NULL OR trim(segment) = ''")
_query(
    "r22_midpoint_timestamp",
    repair.midpoint_times,
    ", gone AS ( SELECT DISTINCT ocel_id FROM place WHERE ocel_time IS NULL OR ocel_time = '' )"
    + _TIMES
    + ", near AS ( SELECT DISTINCT a.ocel_event_id AS anchor, b.ocel_event_id AS neighbour FROM e2o AS a JOIN e2o AS b USING (ocel_object_id) WHERE a.ocel_event_id IN ( SELECT ocel_id FROM gone ) AND a.ocel_event_id <> b.ocel_event_id ), spans AS ( SELECT anchor, min(epoch(CAST(ocel_time AS timestamp)))::bigint AS lo, max(epoch(CAST(ocel_time AS timestamp)))::bigint AS hi FROM near JOIN times ON neighbour = ocel_id WHERE neighbour IN ( SELECT ocel_id FROM event ) GROUP BY 1 ) SELECT anchor AS ocel_id, strftime(make_timestamp((lo + hi) // 2 * 1000000), '%Y-%m-%d %H:%M:%S') AS proposed FROM spans",
)


def _scores(log: Log) -> DataFrame:
    rows = log.object_tables[0].df.where("ocel_changed_field is null and acctbal is not null")
    number = F.col("acctbal")
    made = rows.select(
        F.when(F.col("row_id") % 4 == 0, "with").otherwise("without").alias("arm"),
        F.lit("fixed").alias("kind"),
        F.lit(0.5).alias("confidence"),
        F.when(F.col("row_id") % 6 != 0, (number * F.when(F.col("row_id") % 8 == 0, 1.0).otherwise(1.05)).cast("string")).alias("proposed"),
        number.cast("string").alias("true_value"),
    )
    return evaluate.summarize(evaluate.score(made), "arm").select("arm", "n", "answered", "exact", "within_tol", "errors", "mean_confidence")


_query("v3_score_summary", _scores, " SELECT CASE WHEN row_id % 4 = 0 THEN 'with' ELSE 'without' END AS arm, count(*) AS n, count(*) FILTER (WHERE row_id % 6 <> 0) AS answered, count(*) FILTER (WHERE row_id % 6 <> 0 AND (row_id % 8 = 0 OR acctbal = 0)) AS exact, count(*) FILTER (WHERE row_id % 6 <> 0) AS within_tol, 0 AS errors, 0.5 AS mean_confidence FROM customers WHERE ocel_changed_field IS NULL AND acctbal IS NOT NULL GROUP BY 1")
_query("v1_plant", lambda log: evaluate.plant(log, "object_Products", "brand", 12)[1], ", r AS ( SELECT ocel_id, brand, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM products WHERE brand IS NOT NULL ) SELECT 'object_Products' AS \"table\", 'brand' AS \"column\", ocel_id, brand AS true_value FROM r WHERE k IN ( SELECT i * n // 12 FROM range(12) AS g(i) )")
_query(
    "z1_fanout",
    lambda log: repair.fan_out(sampling.schema_candidates(log, "object").select("ocel_type", F.split(F.col("columns"), ", ").alias("suggestions"))).where("suggestion <> ''"),
    None,
)
ORACLES["z1_fanout"] = "SELECT ocel_type, unnest(string_split(c, ', ')) AS suggestion FROM (VALUES ('customers', 'name TEXT, acctbal REAL, segment TEXT'), ('orders', 'status TEXT, price REAL, priority TEXT'), ('products', 'name TEXT, brand TEXT, kind TEXT, size INTEGER')) AS t(ocel_type, c)"
_query("s5_stale_fingerprint", lambda log: log.spark.createDataFrame([(profile.schema_fingerprint(log),)], "fingerprint string"), None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.duplicate_o2o_relations(load(spark, sf_dir))
