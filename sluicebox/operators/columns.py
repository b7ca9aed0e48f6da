"""Column-level operators (CL-14, CL-15, CL-16, CL-20). Schema work only, apart from proving emptiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_action, not_applicable
from ..functions.headers import fold_header
from ..functions.text import is_missing
from ..table import ROW_NO, data_columns, display_names, dtype_of, require_columns, with_display_names


def rename_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """CL-14: rename the Spark column itself, keeping its place."""
    require_columns(df, [source])
    if target in df.columns:
        raise invalid_action(f"Column already exists: {target}")
    return df.withColumnRenamed(source, target)


def rename_header(df: DataFrame, column: str, new_name: str) -> DataFrame:
    """CL-15: change the display header; the stable id stays."""
    require_columns(df, [column])
    name = new_name.strip()
    if not name:
        raise invalid_action("A column name must not be blank.")
    headers = display_names(df)
    if headers[column] == name:
        raise not_applicable("The column has this name already.")
    if any(fold_header(h) == fold_header(name) for c, h in headers.items() if c != column):
        raise invalid_action("Another column has this name.")
    return with_display_names(df, {column: name})


def drop_empty_columns(df: DataFrame, columns: Sequence[str], proved: bool = False) -> DataFrame:
    """CL-16: drop columns that one pass proves empty, unless they are proved already."""
    require_columns(df, columns)
    if len(columns) >= len(data_columns(df)):
        raise invalid_action("A table keeps at least one column.")
    if proved:
        return df.drop(*columns)
    held = df.agg(
        *[F.count_if(~is_missing(F.col(f"`{c}`"), dtype_of(df, c))).alias(c) for c in columns]
    ).first()
    if any(held[c] for c in columns):
        raise invalid_action("A column with values cannot be dropped as empty.")
    return df.drop(*columns)


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL-20: exactly these columns in this order; absent ones are null."""
    present = set(df.columns)
    cols = [F.col(f"`{c}`") if c in present else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*cols, *([F.col(ROW_NO)] if ROW_NO in present else []))
