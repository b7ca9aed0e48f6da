"""Row-local cleaning (CL-1..6, CL-12, CL-13): each builder returns new expressions per column.

Nothing here shuffles. Spark collapses any chain of these steps into the scan's projection,
and the same expressions serve a streaming DataFrame.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, invalid_action
from ..functions import dates, numbers, text
from ..session import stage
from ..table import dtype_of, replace_columns, require_columns, text_columns

Cells = dict[str, Column]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _texts(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is None:
        return text_columns(df)
    require_columns(df, columns)
    held = set(text_columns(df))
    return [c for c in columns if c in held]


def trimmed(df: DataFrame, columns: Sequence[str] | None = None) -> Cells:
    """CL-1 / CL-2."""
    return {c: text.strip(_col(c)) for c in _texts(df, columns)}


def cased(df: DataFrame, mode: str, columns: Sequence[str] | None = None) -> Cells:
    """CL-3."""
    return {c: text.change_case(_col(c), mode) for c in _texts(df, columns)}


def replaced(df: DataFrame, column: str, mapping: Mapping[str, str]) -> Cells:
    """CL-4 with the mapping as a literal of any size.

    The folded values are dealt into small maps by checksum, so a look-up costs the same however many there are.
    """
    if not mapping:
        raise invalid_action("Replacements are required.")
    if not _texts(df, [column]):
        return {}
    folded = {key.strip().lower(): value for key, value in mapping.items()}
    parts: list[dict[str, str]] = [{} for _ in range(1 + len(folded) // 4)]
    for key, value in folded.items():
        parts[zlib.crc32(key.encode()) % len(parts)][key] = value
    # One text, which the optimizer turns into one literal: the plan has as many nodes for a million entries as for one.
    maps = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    key = text.fold_key(_col(column))
    own = F.element_at(maps, (F.crc32(key.cast("binary")) % len(parts) + 1).cast("int"))
    return {column: F.coalesce(F.try_element_at(own, key), _col(column))}


def canonical_dates(df: DataFrame, columns: Mapping[str, bool]) -> Cells:
    """CL-5: unreadable cells stay as they are."""
    require_columns(df, list(columns))
    return {
        c: F.coalesce(dates.canonical_date(_col(c).cast("string"), with_time), _col(c).cast("string"))
        for c, with_time in columns.items()
    }


def free_dates(
    df: DataFrame, column: str, day_first: bool, output_format: str = "YYYY-MM-DD", two_digit_last_year: int = 2075
) -> Cells:
    """CL-6: unreadable cells stay as they are."""
    require_columns(df, [column])
    cell = _col(column).cast("string")
    return {column: F.coalesce(dates.format_free_date(cell, day_first, output_format, two_digit_last_year), cell)}


def fill_type(dtype: T.DataType, value: str) -> T.DataType:
    """What a column of ``dtype`` becomes when ``value`` goes into it: whole numbers widen to doubles, and text makes numbers text."""
    if not isinstance(dtype, T.NumericType):
        return dtype
    try:
        number = float(value)
    except ValueError:
        return T.StringType()
    whole = number.is_integer() and abs(number) < 2**63
    return dtype if isinstance(dtype, (T.FractionalType, T.DecimalType)) or whole else T.DoubleType()


def filled(df: DataFrame, columns: Sequence[str], value: Column | str) -> Cells:
    """CL-7: the same value into every missing cell. A column's type widens where a literal value asks for it."""
    require_columns(df, columns)
    out = {}
    for c in columns:
        dtype = dtype_of(df, c)
        if isinstance(value, Column):
            new, kept = value.cast(dtype), _col(c)
        else:
            kind = fill_type(dtype, value)
            number = isinstance(dtype, T.NumericType) and isinstance(kind, T.NumericType)
            plain = F.lit(int(Decimal(value)) if isinstance(kind, T.IntegralType) else float(value)) if number else F.lit(value)
            new = plain.cast(kind)
            kept = text.render_cell(_col(c), dtype) if kind != dtype and isinstance(kind, T.StringType) else _col(c).cast(kind)
        out[c] = F.when(text.is_missing(_col(c), dtype), new).otherwise(kept)
    return out


def fill_marks(df: DataFrame, columns: Sequence[str], value: Column | str) -> dict[str, dict]:
    """Header metadata of number columns that a fill turns to text."""
    if isinstance(value, Column):
        return {}
    text_now = [c for c in columns if isinstance(dtype_of(df, c), T.NumericType) and isinstance(fill_type(dtype_of(df, c), value), T.StringType)]
    return {c: {"converted": True} for c in text_now}


def cast_cells(df: DataFrame, column: str, dtype: str) -> Cells:
    """CL-12, lenient: a cell that is no number becomes null."""
    require_columns(df, [column])
    return {column: numbers.coerce_dtype(_col(column), dtype, dtype_of(df, column))}


def strict_cast_cells(df: DataFrame, column: str, dtype: str) -> Cells:
    """CL-12 as the reference semantics: one bad cell fails the whole action, when it runs."""
    kind = dtype_of(df, column)
    new = cast_cells(df, column, dtype)[column]
    message = F.concat(F.lit(f"Cannot cast a value of {column} to {dtype}: "), _col(column).cast("string"))
    result = {"string": "string", "float": "double", "int": "bigint"}[dtype]
    failed = F.when(~text.is_missing(_col(column), kind), F.raise_error(message).cast(result))
    return {column: F.coalesce(new, failed)}


# --- DataFrame forms -------------------------------------------------------------------


def trim_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return replace_columns(df, trimmed(df, columns))


def normalize_case(df: DataFrame, mode: str, columns: Sequence[str] | None = None) -> DataFrame:
    return replace_columns(df, cased(df, mode, columns))


def replace_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return replace_columns(df, replaced(df, column, mapping))


def replace_values_from(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """CL-4 with the mapping as a table.

    The mapping has one row per folded value and is staged, so that both sides of the join are plain shuffles: adaptive
    execution then broadcasts it if its bytes are few, and else splits a hot value of the left side over several tasks.
    """
    require_columns(df, [column])
    clean = (
        mapping.select(text.fold_key(F.col(key)).alias("__key"), F.col(value).alias("__value"))
        .groupBy("__key")
        .agg(F.max("__value").alias("__value"))
    )
    keyed = df.withColumn("__key", text.fold_key(_col(column)))
    joined = keyed.join(stage(clean, "mapping"), "__key", "left")
    return replace_columns(
        joined, {column: F.coalesce(F.col("__value"), _col(column))}
    ).select(*[_col(c) for c in df.columns])


def standardize_dates(df: DataFrame, columns: Mapping[str, bool]) -> DataFrame:
    return replace_columns(df, canonical_dates(df, columns))


def standardize_free_dates(
    df: DataFrame, column: str, day_first: bool, output_format: str = "YYYY-MM-DD", two_digit_last_year: int = 2075
) -> DataFrame:
    return replace_columns(df, free_dates(df, column, day_first, output_format, two_digit_last_year))


def fill_missing(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    return replace_columns(df, filled(df, columns, value), fill_marks(df, columns, value))


def cast_dtype(df: DataFrame, column: str, dtype: str, strict: bool = False) -> DataFrame:
    cells = strict_cast_cells if strict else cast_cells
    return replace_columns(df, cells(df, column, dtype))


def numeric_counts(df: DataFrame, column: str) -> DataFrame:
    """CL-13 facts in one pass: convertible, unresolved and fractional cells."""
    require_columns(df, [column])
    dtype = dtype_of(df, column)
    number = numbers.numeric_value(_col(column), dtype)
    present = ~text.is_missing(_col(column), dtype)
    return df.agg(
        F.count_if(number.isNotNull()).alias("convertible"),
        F.count_if(present & number.isNull()).alias("unresolved"),
        F.count_if(number != F.floor(number)).alias("fractional"),
    )


def converted(df: DataFrame, column: str, target: str, typed: bool) -> Cells:
    """CL-13 cells: a typed column when every cell converts, else number text beside what could not."""
    if target not in ("integer", "decimal"):
        raise invalid_action(f"Unknown target type: {target}")
    require_columns(df, [column])
    number = numbers.numeric_value(_col(column), dtype_of(df, column))
    kind = "bigint" if target == "integer" else "double"
    if typed:
        return {column: number.try_cast(kind)}
    as_text = number.try_cast("bigint").cast("string") if target == "integer" else text.render_double(number)
    return {column: F.coalesce(as_text, _col(column).cast("string"))}


def can_be_typed(df: DataFrame, column: str, target: str) -> bool:
    """Whether every present cell converts, by one counting pass; an error for fractions in an integer column."""
    facts = numeric_counts(df, column).first()
    if target == "integer" and facts["fractional"]:
        raise TableError(
            "invalid_action", f"Column {column} holds fractions and cannot become an integer column."
        )
    return facts["unresolved"] == 0


def convert_numeric(df: DataFrame, column: str, target: str, typed: bool | None = None) -> DataFrame:
    """CL-13. A counting pass decides whether the column can become a number column, unless ``typed`` says so."""
    if typed is None:
        typed = can_be_typed(df, column, target)
    marks = {} if typed else {column: {"converted": True}}
    return replace_columns(df, converted(df, column, target, typed), marks)


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(dtype_of(df, column), T.NumericType)


def has_target_type(df: DataFrame, column: str, target: str) -> bool:
    """The column already is what ``convert_numeric`` would make of it."""
    dtype = dtype_of(df, column)
    return isinstance(dtype, T.IntegralType) if target == "integer" else isinstance(dtype, T.FractionalType)
