from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sluicebox.session import build_session  # noqa: E402
from sluicebox.table import ROW_NO, from_frame  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests", shuffle_partitions=4,
        extra={
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """table(headers, rows): an upload-style table with column_1..n and row numbers."""

    def make(headers, rows):
        names = [f"c{i}" for i in range(len(headers))]
        schema = ", ".join(f"{n} string" for n in names) + f", {ROW_NO} bigint"
        df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)
        return from_frame(df, headers)

    return make


def column(df, name):
    """Values of a column in source order."""
    return [r[name] for r in df.orderBy(ROW_NO).select(name).collect()]
