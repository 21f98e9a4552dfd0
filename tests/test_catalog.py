import duckdb
import pytest

import __spark_entry__
from evidoc.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    relation = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == sorted(df.columns)
    want = duck.execute(f"SELECT {cols} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.filter("not valid").count() == 0


def test_every_query_has_a_name_and_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_no_plan_has_a_cross_join(spark):
    for name, query in catalog.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
