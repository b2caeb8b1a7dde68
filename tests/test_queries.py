"""Every registered query against its SQL, on the smallest data and on a skewed copy of it."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect
from weftline.sources.catalog import TABLES

SMALL = "/root/testdata/sf0.001"
KEYS = sorted(entry_points.queries())
# Queries whose input has a column that may be hot.
SKEW_KEYS = [k for k in KEYS if k[0] in "qv" or k.startswith(("d12", "e02", "e10", "d15", "r05", "r07", "r08", "p04"))]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of all rows share one customer, order, part, conversation, or vector."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    changed = {
        "orders": "o_custkey = CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END",
        "lineitem": "l_orderkey = CASE WHEN l_linenumber % 3 = 0 THEN 11 ELSE l_orderkey END, "
                    "l_partkey = CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE l_partkey END",
        "part": "p_type = CASE WHEN p_partkey % 3 = 0 THEN 'PROMO' ELSE p_type END",
        "events": "user_id = CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END",
        "embeddings": "embedding = CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM embeddings WHERE vec_id = 1) "
                      "ELSE embedding END",
    }
    for name in TABLES:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
        if name in changed:
            con.execute(f"UPDATE {name} SET {changed[name]}")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


def run(spark, folder, key):
    df = entry_points.queries()[key](spark, folder)
    sql = entry_points.oracle_sql().get(key)
    if sql is None:
        df.count()
        return None
    return compare(df, connect(folder), sql)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, key):
    assert run(spark, SMALL, key) is None


@pytest.mark.parametrize("key", SKEW_KEYS)
def test_query_matches_sql_on_skewed_data(spark, skewed, key):
    assert run(spark, skewed, key) is None


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["query_id", "rank", "example_id", "score"]


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(KEYS)
