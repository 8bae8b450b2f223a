"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

import pairforge.plans.more_queries  # noqa: F401
import pairforge.plans.study_queries  # noqa: F401
from pairforge.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(got, df.columns) == ordered(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_columns_and_use_no_python(spark):
    plan = QUERIES["axis_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "l_orderkey" in x and "ReadSchema" in x)
    assert "l_comment" not in scan and "l_shipdate" not in scan
    assert "Python" not in plan and "Arrow" not in plan
