"""The driver contract, and a few queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, cell
from sluicebox.session import staging_root
from workload import registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_staging_is_in_a_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return settings.get(name, default)

    settings = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}
    assert staging_root(Session) == "hdfs://x/warehouse/_staged"
    settings["spark.checkpoint.dir"] = "hdfs://x/check/"
    assert staging_root(Session) == "hdfs://x/check"


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_id", "customer_name", "status", "amount", "order_date", "city", "state"]
    assert df.count() == 1500


@needs_data
@pytest.mark.parametrize("name", ["rulepack_contacts", "issues_orders", "keyed_diff", "fill_forward_by_user", "csv_round_trip", "plan_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want
