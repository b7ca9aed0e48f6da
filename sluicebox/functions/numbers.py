"""Number expressions over text cells (FN-9, FN-13, FN-15, FN-19).

A pattern guards every cast: Spark's own text-to-double cast also reads '1.5d' and 'NaN'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import is_blank, strip

# Number shapes.
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
LEADING_ZERO_PATTERN = r"^[+-]?0[0-9]+$"
FLOAT_PATTERN = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$"
GOLD_INTEGER_PATTERN = r"^-?[0-9]+$"
GOLD_FLOAT_PATTERN = r"^-?[0-9]+\.[0-9]+$"


def without_money_signs(c: Column) -> Column:
    """Stripped text without thousands commas and dollar signs."""
    return F.translate(strip(c), ",$", "")


def numeric_text(c: Column) -> Column:
    """FN-9: the plain decimal text of a number-like cell (one trailing % dropped), else null."""
    bare = F.regexp_replace(without_money_signs(c), "%$", "")
    return F.when(bare.rlike(DECIMAL_PATTERN), bare)


def numeric_value(c: Column, dtype: T.DataType | None = None) -> Column:
    """FN-9 as a number; a column that already holds numbers is taken as it is."""
    if isinstance(dtype, T.NumericType):
        number = c.cast("double")
        return F.when(~F.isnan(number), number)
    return numeric_text(c if dtype is None or isinstance(dtype, T.StringType) else c.cast("string")).try_cast("double")


def is_numeric_looking(c: Column) -> Column:
    """PR-6 form: every trailing % is ignored."""
    bare = F.regexp_replace(without_money_signs(c), "%+$", "")
    return F.coalesce(bare.rlike(DECIMAL_PATTERN), F.lit(False))


def has_leading_zero(c: Column) -> Column:
    return F.coalesce(without_money_signs(c).rlike(LEADING_ZERO_PATTERN), F.lit(False))


def round_text(text: Column, places: int = 2) -> Column:
    """Round decimal text half up; falls back to the double for very long or exponent forms."""
    exact = F.round(text.try_cast("decimal(38,18)"), places).cast("double")
    return F.coalesce(exact, F.round(text.try_cast("double"), places))


def coerce_float(c: Column) -> Column:
    """FN-13 float: drop $ and commas, round to two decimals; null when not a number."""
    bare = without_money_signs(c)
    return F.when(bare.rlike(FLOAT_PATTERN), round_text(bare))


def coerce_int(c: Column) -> Column:
    """FN-13 int: drop commas, truncate toward zero; null when not a number."""
    bare = F.translate(strip(c), ",", "")
    exact = bare.try_cast("decimal(38,18)")
    whole = F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).try_cast("bigint")
    return F.when(bare.rlike(FLOAT_PATTERN), F.coalesce(whole, bare.try_cast("double").try_cast("bigint")))


def coerce_dtype(c: Column, dtype: str, source: T.DataType | None = None) -> Column:
    """FN-13: cast a cell to string, float or int; missing becomes null."""
    text = c if source is None or isinstance(source, T.StringType) else c.cast("string")
    forms = {"string": lambda t: F.nullif(strip(t), F.lit("")), "float": coerce_float, "int": coerce_int}
    if dtype not in forms:
        raise ValueError(f"Unsupported dtype: {dtype}")
    return forms[dtype](text)


def grading_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """FN-19: the number a cell is compared as, else null."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return c.cast("double")
    bare = without_money_signs(c)
    return F.when(bare.rlike(FLOAT_PATTERN), bare.try_cast("double"))


def format_calculated(d: Column) -> Column:
    """FN-15: whole numbers as integers, others with 15 significant digits."""
    # try_cast to decimal also refuses NaN and infinities.
    whole = d.try_cast("decimal(38,0)")
    digits = F.regexp_replace(F.format_string("%.15g", d), r"^([^e]*?)\.?0+(e.*)?$", "$1$2")
    return F.when(whole.cast("double") == d, whole.cast("string")).otherwise(digits)


def infer_gold_text(c: Column) -> Column:
    """SR-8: text of a cell after per-cell number inference, as FN-3 would print it."""
    bare = strip(c)
    as_int = bare.try_cast("decimal(38,0)").cast("string")
    as_float = F.regexp_replace(F.round(bare.try_cast("decimal(38,18)"), 2).cast("string"), r"\.?0+$", "")
    return (
        F.when(is_blank(c), F.lit(""))
        .when(bare.rlike(GOLD_INTEGER_PATTERN), F.coalesce(as_int, bare))
        .when(bare.rlike(GOLD_FLOAT_PATTERN), F.coalesce(as_float, bare))
        .otherwise(c)
    )
