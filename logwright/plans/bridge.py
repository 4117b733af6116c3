"""An event log made of the star-schema test tables, with known defects.

The defects are pure arithmetic on keys, so that the same SQL text, but for
the names of two functions, makes the same log in any engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from logwright.log import Log, TypeTable
from logwright.session import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SPARK = {"time": "date_format({}, 'yyyy-MM-dd HH:mm:ss')", "str": "string"}
DUCKDB = {"time": "strftime({}, '%Y-%m-%d %H:%M:%S')", "str": "varchar"}

OBJECT = """
SELECT c_custkey * 16 AS row_id, 'c-' || c_custkey AS ocel_id, CASE WHEN c_custkey % 101 = 0 THEN CAST(NULL AS {str}) ELSE 'customers' END AS ocel_type FROM customer WHERE c_custkey % 97 <> 0
UNION ALL SELECT o_orderkey * 16 + 1, 'o-' || o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN '  ' ELSE 'orders' END FROM orders
UNION ALL SELECT o_orderkey * 16 + 6, 'o-' || o_orderkey, 'orders' FROM orders WHERE o_orderkey % 307 = 0
UNION ALL SELECT o_orderkey * 16 + 7, 'o-' || o_orderkey, 'products' FROM orders WHERE o_orderkey % 401 = 0
UNION ALL SELECT p_partkey * 16 + 2, 'p-' || p_partkey, 'products' FROM part
UNION ALL SELECT s_suppkey * 16 + 3, 's-' || s_suppkey, 'suppliers' FROM supplier
UNION ALL SELECT CAST(n_nationkey AS bigint) * 16 + 4, 'n-' || n_nationkey, 'nations' FROM nation
"""
EVENT = """
SELECT o_orderkey * 16 AS row_id, 'place-' || o_orderkey AS ocel_id, CASE WHEN o_orderkey % 109 = 0 THEN CAST(NULL AS {str}) WHEN o_orderkey % 113 = 0 THEN '' ELSE 'place order' END AS ocel_type FROM orders WHERE o_orderkey % 103 <> 0
UNION ALL SELECT l_orderkey * 16 + 1 + l_linenumber % 8, 'ship-' || l_orderkey || '-' || l_linenumber, 'ship item' FROM lineitem
UNION ALL SELECT event_id * 16 + 10, 'e-' || event_id, event_type FROM events
"""
E2O = """
SELECT o_orderkey * 64 AS row_id, 'place-' || o_orderkey AS ocel_event_id, 'o-' || o_orderkey AS ocel_object_id, 'order' AS ocel_qualifier FROM orders
UNION ALL SELECT o_orderkey * 64 + 1, 'place-' || o_orderkey, 'c-' || o_custkey, 'customer' FROM orders
UNION ALL SELECT o_orderkey * 64 + 2, 'place-' || o_orderkey, 'o-' || o_orderkey, 'order' FROM orders WHERE o_orderkey % 127 = 0
UNION ALL SELECT o_orderkey * 64 + 3, 'place-' || o_orderkey, 'orders:zz' || o_orderkey, 'misc' FROM orders WHERE o_orderkey % 131 = 0
UNION ALL SELECT o_orderkey * 64 + 4, 'place-' || o_orderkey, 'zz' || o_orderkey, 'product' FROM orders WHERE o_orderkey % 137 = 0
UNION ALL SELECT o_orderkey * 64 + 5, 'place-' || o_orderkey, 'zz' || o_orderkey, 'misc' FROM orders WHERE o_orderkey % 139 = 0
UNION ALL SELECT l_orderkey * 64 + 10 + 3 * (l_linenumber % 8), 'ship-' || l_orderkey || '-' || l_linenumber, 'o-' || l_orderkey, 'order' FROM lineitem
UNION ALL SELECT l_orderkey * 64 + 11 + 3 * (l_linenumber % 8), 'ship-' || l_orderkey || '-' || l_linenumber, 'p-' || l_partkey, 'product' FROM lineitem
UNION ALL SELECT l_orderkey * 64 + 12 + 3 * (l_linenumber % 8), 'ship-' || l_orderkey || '-' || l_linenumber, 's-' || l_suppkey, 'supplier' FROM lineitem
UNION ALL SELECT event_id * 64 + 50, 'e-' || event_id, 'c-' || user_id, 'user' FROM events
"""
O2O = """
SELECT l_orderkey * 16 + l_linenumber % 8 AS row_id, 'o-' || l_orderkey AS ocel_source_id, 'p-' || l_partkey AS ocel_target_id, 'comprises' AS ocel_qualifier FROM lineitem
UNION ALL SELECT o_orderkey * 16 + 8, 'c-' || o_custkey, 'o-' || o_orderkey, 'places' FROM orders
UNION ALL SELECT s_suppkey * 16 + 9, 's-' || s_suppkey, 'n-' || s_nationkey, 'located in' FROM supplier
UNION ALL SELECT o_orderkey * 16 + 10, 'o-' || o_orderkey, 'o-' || o_orderkey, 'contains' FROM orders WHERE o_orderkey % 149 = 0
"""
CUSTOMERS = """
SELECT c_custkey * 2 AS row_id, 'c-' || c_custkey AS ocel_id, '2024-01-01 00:00:00' AS ocel_time, CAST(NULL AS {str}) AS ocel_changed_field, c_name AS name, CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE c_acctbal END AS acctbal, CASE WHEN c_custkey % 83 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT c_custkey * 2 + 1, 'c-' || c_custkey, '2024-02-01 00:00:00', 'acctbal', CAST(NULL AS {str}), c_acctbal + 1, CAST(NULL AS {str}) FROM customer WHERE c_custkey % 10 = 0
"""
ORDERS = "SELECT o_orderkey AS row_id, 'o-' || o_orderkey AS ocel_id, {t_orderdate} AS ocel_time, CAST(NULL AS {str}) AS ocel_changed_field, o_orderstatus AS status, o_totalprice AS price_number, CASE WHEN o_orderkey % 151 = 0 THEN 'TBD' END AS price_text, o_orderpriority AS priority FROM orders"
PRODUCTS = "SELECT p_partkey AS row_id, 'p-' || p_partkey AS ocel_id, '2024-01-01 00:00:00' AS ocel_time, CAST(NULL AS {str}) AS ocel_changed_field, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size FROM part"
PLACE = "SELECT o_orderkey AS row_id, 'place-' || o_orderkey AS ocel_id, CASE WHEN o_orderkey % 157 = 0 THEN CAST(NULL AS {str}) WHEN o_orderkey % 167 = 0 THEN '' ELSE {t_orderdate} END AS ocel_time FROM orders"
SHIP = "SELECT l_orderkey * 8 + l_linenumber % 8 AS row_id, 'ship-' || l_orderkey || '-' || l_linenumber AS ocel_id, {t_shipdate} AS ocel_time, l_quantity AS quantity, CASE WHEN l_orderkey % 163 = 0 THEN ' ' ELSE l_returnflag END AS returnflag FROM lineitem"
CLICK = "SELECT event_id AS row_id, 'e-' || event_id AS ocel_id, {t_ts} AS ocel_time, value FROM events WHERE event_type = 'click'"


def sql(text: str, dialect: dict[str, str]) -> str:
    times = {f"t_{n}": dialect["time"].format(c) for n, c in (("orderdate", "o_orderdate"), ("shipdate", "l_shipdate"), ("ts", "ts"))}
    return text.format(str=dialect["str"], **times)


def oracle(body: str) -> str:
    """``body`` over the log's tables, as SQL for the oracle's engine."""
    parts = {"object": OBJECT, "event": EVENT, "e2o": E2O, "o2o": O2O, "customers": CUSTOMERS, "orders_t": ORDERS, "products": PRODUCTS, "place": PLACE, "ship": SHIP, "click": CLICK}
    words = set(re.findall(r"\w+", body))
    used = {n: q for n, q in parts.items() if n in words}
    return "WITH " + ", ".join(f"{n} AS ({sql(q, DUCKDB)})" for n, q in used.items()) + body if used else body


def load(spark: SparkSession, sf_dir: str) -> Log:
    """The log over the tables in ``sf_dir``; lazily, with pruned scans."""
    ship(spark)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def made(text: str) -> DataFrame:
        query = sql(text, SPARK)
        for t in TABLES:
            query = query.replace(f" FROM {t}", " FROM {" + t + "}")
        used = {t: f for t, f in frames.items() if "{" + t + "}" in query}
        return spark.sql(query, **used)

    priced = made(ORDERS).selectExpr(
        "row_id", "ocel_id", "ocel_time", "ocel_changed_field", "status",
        "named_struct('storage', if(price_text is null, 'real', 'text'), 'i', cast(null as bigint), 'd', if(price_text is null, price_number, null), 's', price_text, 'b', cast(null as binary)) as price",
        "priority",
    )
    none = spark.createDataFrame([], "row_id long, ocel_id string, ocel_time string, ocel_changed_field string")
    return Log(
        spark,
        made(OBJECT),
        made(EVENT),
        made(E2O),
        made(O2O),
        (
            TypeTable("customers", "object_Customers", made(CUSTOMERS), {"name": "TEXT", "acctbal": "REAL", "segment": "TEXT"}),
            TypeTable("orders", "object_Orders", priced, {"status": "TEXT", "price": "REAL", "priority": "TEXT"}),
            TypeTable("products", "object_Products", made(PRODUCTS), {"name": "TEXT", "brand": "TEXT", "kind": "TEXT", "size": "INTEGER"}),
            TypeTable("suppliers", "object_Suppliers", none, {}),
            TypeTable("nations", "object_Nations", none, {}),
        ),
        (
            TypeTable("place order", "event_PlaceOrder", made(PLACE), {}),
            TypeTable("ship item", "event_ShipItem", made(SHIP), {"quantity": "REAL", "returnflag": "INTEGER"}),
            TypeTable("click", "event_Click", made(CLICK), {"value": "REAL"}),
        ),
    )
