"""The table model: text columns, a row number carried as data, display headers in field metadata.

``_row_no`` is the 0-based source position, fixed at ingest. People see ``_row_no + 2``
(row 1 is the header). Headers may be blank or repeated, so they live beside the Spark
names ``column_1..n`` (SR-4, CL-15).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TableError

ROW_NO = "_row_no"
FIRST_ROW_NUMBER = 2
SCRATCH = "__"  # columns with this prefix belong to a running operator, never to the table
_DISPLAY = "display_name"


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name != ROW_NO and not name.startswith(SCRATCH)]


def text_columns(df: DataFrame) -> list[str]:
    return [name for name in data_columns(df) if isinstance(df.schema[name].dataType, T.StringType)]


def require_row_no(df: DataFrame, what: str) -> None:
    if ROW_NO not in df.columns:
        raise TableError("invalid_action", f"{what} depends on row order and needs a {ROW_NO} column.")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    present = data_columns(df)
    unknown = [name for name in names if name not in present]
    if unknown:
        raise TableError("invalid_action", f"Unknown column: {', '.join(unknown)}")
    if len(set(names)) != len(names):
        raise TableError("invalid_action", "A column is named twice.")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def display_names(df: DataFrame) -> dict[str, str]:
    """Spark name -> display header, in table order."""
    return {name: df.schema[name].metadata.get(_DISPLAY, name) for name in data_columns(df)}


def with_display_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Change display headers only; no data moves."""
    for name, header in names.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, _DISPLAY: header})
    return df


def from_frame(df: DataFrame, headers: Sequence[str] | None = None, row_no: Column | None = None) -> DataFrame:
    """SR-4: give any DataFrame stable ids ``column_1..n`` with its names (or ``headers``) on display."""
    names = data_columns(df)
    shown = list(headers) if headers is not None else names
    cols = [
        F.col(f"`{name}`").alias(f"column_{i + 1}", metadata={_DISPLAY: header})
        for i, (name, header) in enumerate(zip(names, shown, strict=True))
    ]
    if row_no is None and ROW_NO in df.columns:
        row_no = F.col(ROW_NO)
    if row_no is not None:
        cols.append(row_no.cast("bigint").alias(ROW_NO))
    return df.select(*cols)


def replace_columns(df: DataFrame, new: Mapping[str, Column], metadata: Mapping[str, dict] | None = None) -> DataFrame:
    """Swap in new expressions in one projection, keeping order and header metadata."""
    extra = metadata or {}
    return df.select(
        *[
            new[f.name].alias(f.name, metadata={**f.metadata, **extra.get(f.name, {})})
            if f.name in new
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def column_list(df: DataFrame) -> DataFrame:
    """The header sidecar as rows: id, name, position."""
    rows = [(name, header, i) for i, (name, header) in enumerate(display_names(df).items())]
    return df.sparkSession.createDataFrame(rows, "id string, name string, position int")


def preview(df: DataFrame, limit: int = 20) -> DataFrame:
    """SR-9: the first rows in source order with the row number people see."""
    require_row_no(df, "A preview")
    return (
        df.orderBy(ROW_NO)
        .limit(limit)
        .select((F.col(ROW_NO) + FIRST_ROW_NUMBER).alias("row_number"), *[F.col(f"`{c}`") for c in data_columns(df)])
    )
