"""Tables that repeat: many records at one place, many queries of one text. Results are held against the oracle."""

import duckdb
import pytest

from placebook.plans.queries import ORACLES, QUERIES

TABLES = {"customer": "c_custkey + 1000 * i as c_custkey", "orders": "o_orderkey + 6000 * i as o_orderkey, o_custkey + 1000 * (i % 3) as o_custkey", "events": "event_id + 1000 * i as event_id", "nation": None}


@pytest.fixture(scope="module")
def repeated(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    for name, keys in TABLES.items():
        rows = f"select t.* replace ({keys}) from '{sf}/{name}.parquet' t, range(5) r(i)" if keys else f"select * from '{sf}/{name}.parquet'"
        con.execute(f"copy ({rows}) to '{folder}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


def equal(spark, repeated, name):
    folder, con = repeated
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want) != []
    return got


@pytest.mark.parametrize("name", ["index_get", "sql_prefix_lookup"])
def test_queries_of_one_text_share_its_hits(spark, repeated, name):
    """each query was joined to the entries by itself."""
    got = equal(spark, repeated, name)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_run") < plan.index("Join")  # hits are given to queries last


def test_records_at_one_place(spark, repeated):
    """every record at a place met every point near it, to be sorted for its first three."""
    equal(spark, repeated, "sql_near_lookup")
    assert spark.table("records").groupBy("lon", "lat").count().agg({"count": "max"}).first()[0] == 3
