"""A query of this subpackage against its SQL on the smallest tables."""

import duckdb

from check_oracle import TABLES, cell
from sluicebox.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def compare(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall())
