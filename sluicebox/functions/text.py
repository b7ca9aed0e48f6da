"""Text cell expressions (FN-1..5, FN-11, FN-12, FN-14, FN-18)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points a full Unicode strip removes from both ends of a text.
WS = "".join(
    chr(point)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for point in range(first, last + 1)
)

# Fixed value: the address shape accepted as an email.
EMAIL_PATTERN = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"

# Fixed value: first characters a spreadsheet may read as a formula.
FORMULA_STARTS = ("=", "+", "-", "@")

_LETTERS = r"[\p{Lu}\p{Ll}\p{Lt}]"


def strip(c: Column) -> Column:
    """FN-2 / FN-18: remove leading and trailing whitespace of every kind."""
    return F.btrim(c, F.lit(WS))


def is_blank(c: Column) -> Column:
    """Missing text: null, empty, or whitespace only. Never null itself."""
    return c.isNull() | (strip(c) == "")


def is_missing(c: Column, dtype: T.DataType | None = None) -> Column:
    """FN-1: missing for a column of the given type (text when none is given)."""
    if dtype is None or isinstance(dtype, T.StringType):
        return is_blank(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_padded(c: Column) -> Column:
    """True when strip would change the text; null counts as unpadded."""
    return F.coalesce(c != strip(c), F.lit(False))


def fold_key(c: Column) -> Column:
    """Comparison form of a label: stripped and lower-cased."""
    return F.lower(strip(c))


def title_case(c: Column) -> Column:
    """FN-12: upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"{_LETTERS}+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647))),
        "",
    )


def change_case(c: Column, mode: str) -> Column:
    """Strip, then lower / upper / title."""
    forms = {"lower": F.lower, "upper": F.upper, "title": title_case}
    if mode not in forms:
        raise ValueError(f"Unknown case mode: {mode}")
    return forms[mode](strip(c))


def stringify(c: Column, dtype: T.DataType | None = None) -> Column:
    """FN-3: null as '', floats with at most two decimals and no trailing zeros."""
    if dtype is None or isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        fixed = c.cast("string").try_cast("decimal(38,2)").cast("string")
        return F.coalesce(
            F.when(F.abs(c) < F.lit(1e35), F.regexp_replace(fixed, r"\.?0+$", "")),
            F.lower(F.regexp_replace(c.cast("string"), "Infinity", "inf")),
            F.lit(""),
        )
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def stable_json(fields: Iterable[tuple[str, Column]]) -> Column:
    """FN-4: compact JSON of the fields in name order, nulls kept."""
    ordered = sorted(fields, key=lambda item: item[0])
    return F.to_json(F.struct(*[c.alias(name) for name, c in ordered]), {"ignoreNullFields": "false"})


def canonical_key(fields: Sequence[tuple[Column, T.DataType | None]]) -> Column:
    """FN-5: the key fields as text, as one struct."""
    return F.struct(*[stringify(c, dtype).alias(f"k{i}") for i, (c, dtype) in enumerate(fields)])


def looks_like_email(c: Column) -> Column:
    """FN-11; a null is not an email."""
    return F.coalesce(strip(c).rlike(EMAIL_PATTERN), F.lit(False))


def looks_like_formula(c: Column) -> Column:
    """PR-18 predicate: the raw text starts with a formula character."""
    return F.coalesce(F.substring(c, 1, 1).isin(*FORMULA_STARTS), F.lit(False))


def count_present(columns: Sequence[tuple[Column, T.DataType | None]]) -> Column:
    """FN-14: how many of the columns hold a value in this row."""
    flags = [F.when(is_missing(c, dtype), 0).otherwise(1) for c, dtype in columns]
    return reduce(lambda a, b: a + b, flags, F.lit(0))


def render_double(c: Column) -> Column:
    """Shortest digits of a double, plain between 1e-4 and 1e16 (Spark itself turns to E-notation at 1e7)."""
    short = c.cast("string")
    plain = short.try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*[1-9])0+$", "$1"), r"\.0+$", ".0")
    wide = (F.abs(c) >= 1e7) & (F.abs(c) < 1e16) | (F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4)
    return F.when(wide, plain).otherwise(short)


def render_cell(c: Column, dtype: T.DataType) -> Column:
    """FN-16: text of a cell for CSV and JSON outputs; timestamps in ISO form, missing as null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), render_double(c))
    return c.cast("string")
