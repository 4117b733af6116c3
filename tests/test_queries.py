"""Every query with SQL against that SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest

from logwright.plans import context_queries, queries, repair_queries

QUERIES, ORACLES = queries.QUERIES | repair_queries.QUERIES | context_queries.QUERIES, queries.ORACLES | repair_queries.ORACLES | context_queries.ORACLES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    flat = lambda x: "" if x is None or x != x else str(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(flat, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sf, db):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.sql(ORACLES[name]).df())
    else:
        assert len(got) == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


_CHANGED = """ SELECT 'customers' AS object_type, string_agg(ocel_id, ', ' ORDER BY row_id) AS ocel_ids, CAST(count(*) AS varchar) AS duplicate_count, 'duplicate_objects_on_attributes' AS issue
 FROM customers GROUP BY name, acctbal, segment HAVING count(*) > 1"""


def test_customers_with_equal_changes_are_repeats(spark, sf, tmp_path):
    """Two customers whose balance changed to the same value: the SQL of d05
    names products and orders only; with customers added it is the detector's."""
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey IN (10, 20) THEN 7.5 ELSE c_acctbal END AS c_acctbal) FROM '{sf}/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for t in ("customer", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    name = "d05_duplicate_objects_on_attributes"
    changed = con.sql(queries.oracle(_CHANGED)).df()
    assert "c-10, c-20" in set(changed["ocel_ids"])
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == sorted(rows(con.sql(ORACLES[name]).df()) + rows(changed))
