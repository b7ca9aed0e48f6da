"""Calculated and carried fills (CL-8..11, GEN-2)."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid_action
from ..functions.numbers import format_calculated, numeric_value
from ..functions.text import is_missing
from ..session import stage
from ..table import ROW_NO, dtype_of, replace_columns, require_columns, require_row_no
from .cells import fill_marks, filled

STRATEGIES = ("explicit", "mean", "median", "most_common")
_NOT_NUMERIC = "A mean or median fill needs a column of numbers."
#: Bits of an ordered number that one scan of the median search settles.
DIGIT_BITS = 16
_BELOW_SIGN = (1 << 63) - 1
FILL_BLOCK_ROWS = 1 << 18


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _numeric_stats(df: DataFrame, column: str) -> DataFrame:
    cell = _col(column)
    dtype = dtype_of(df, column)
    present = ~is_missing(cell, dtype)
    return df.select(
        F.when(present, numeric_value(cell, dtype)).alias("v"),
        present.alias("present"),
    )


def mean_value(df: DataFrame, column: str) -> DataFrame:
    """CL-8 as one row ``fill``: the mean as text; an error if a present cell is no number."""
    facts = _numeric_stats(df, column).agg(
        F.avg("v").alias("m"), F.count("v").alias("n"), F.count_if(F.col("present")).alias("present")
    )
    wrong = (F.col("n") == 0) | (F.col("n") != F.col("present"))
    message = F.lit(_NOT_NUMERIC)
    return facts.select(F.when(wrong, F.raise_error(message).cast("string")).otherwise(format_calculated(F.col("m"))).alias("fill"))


def most_common_value(df: DataFrame, column: str) -> DataFrame:
    """CL-10 as one row ``fill``: highest count, tie to the value seen first; raw values compared."""
    require_row_no(df, "A most-common fill")
    cell = _col(column)
    counts = (
        df.where(~is_missing(cell, dtype_of(df, column)))
        .groupBy(cell.alias("v"))
        .agg(F.count("*").alias("n"), F.min(ROW_NO).alias("first"))
    )
    return counts.agg(F.max_by("v", F.struct("n", -F.col("first"))).alias("fill"))


def ordered_bits(number: Column) -> Column:
    """A double as a long of the same order: its bits, turned over below the sign where it is negative. Both zeros are one number."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), number + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_BELOW_SIGN)))


def _number_of(ordered: int) -> float:
    return struct.unpack("<d", struct.pack("<q", ordered if ordered >= 0 else ordered ^ _BELOW_SIGN))[0]


def exact_median(df: DataFrame, column: str) -> float | None:
    """CL-9: the exact median of the numbers in a column, by histograms of constant size.

    The numbers are staged once as longs of the same order, 8 bytes a row. A scan counts 2^16 values of the next 16 bits among the numbers that
    begin as the wanted one does, so four scans settle all 64 bits, whatever the numbers are. Where the two middle numbers part, one scan finds both.
    """
    values = _numeric_stats(df, column)
    ordered = stage(values.where("present").select(F.when(F.col("v").isNotNull(), ordered_bits(F.col("v"))).alias("k")), "median")
    inside, ranks = ordered, None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("k", shift)
        counts = dict(inside.groupBy(digit.alias("digit")).count().collect())
        if ranks is None:
            if not counts or None in counts:
                raise invalid_action(_NOT_NUMERIC)
            n = sum(counts.values())
            ranks = ((n - 1) // 2, n // 2)
        digits, skipped = sorted(counts), list(accumulate([0, *(counts[d] for d in sorted(counts))]))
        low, high = (bisect_right(skipped, r) - 1 for r in ranks)
        if low != high:
            ends = inside.agg(
                F.max(F.when(digit == digits[low], F.col("k"))).alias("low"), F.min(F.when(digit == digits[high], F.col("k"))).alias("high")
            ).first()
            return (_number_of(ends["low"]) + _number_of(ends["high"])) / 2
        ranks = tuple(r - skipped[low] for r in ranks)
        inside = ordered.where(digit == digits[low])
    return _number_of(digits[low])


def fill_value(df: DataFrame, column: str, strategy: str, value: str | None = None) -> Column | str:
    """The replacement for CL-7..10. It is a lazy scalar subquery for a mean or most common value of text, and a literal text where
    the type of a number column depends on it."""
    require_columns(df, [column])
    if strategy not in STRATEGIES:
        raise invalid_action(f"Unknown fill strategy: {strategy}")
    if strategy == "explicit":
        if value is None or not str(value).strip():
            raise invalid_action("The fill value must not be blank.")
        return str(value)
    if strategy == "median":
        found = df.sparkSession.range(1).select(format_calculated(F.lit(exact_median(df, column))))
        return found.first()[0]
    if strategy == "most_common":
        return most_common_value(df, column).scalar()
    mean = mean_value(df, column)
    return mean.first()["fill"] if isinstance(dtype_of(df, column), T.NumericType) else mean.scalar()


def fill_text(df: DataFrame, column: str, strategy: str) -> str | None:
    """The mean, median or most common value as text, by a job now; None where there is no value."""
    if strategy == "most_common":
        require_columns(df, [column])
        found = most_common_value(df, column).first()
        return None if found is None or found["fill"] is None else str(found["fill"])
    new = fill_value(df, column, strategy)
    return new if isinstance(new, str) else mean_value(df, column).first()["fill"]


def fill_missing_with(df: DataFrame, column: str, strategy: str, value: str | None = None) -> DataFrame:
    new = fill_value(df, column, strategy, value)
    return replace_columns(df, filled(df, [column], new), fill_marks(df, [column], new))


def fill_forward(
    df: DataFrame,
    columns: Sequence[str],
    partition_by: Sequence[str] = (),
    block_rows: int = FILL_BLOCK_ROWS,
) -> DataFrame:
    """CL-11: each missing cell takes the last present value above it in source order.

    The order is global, and a plain ordered window would pull the table into one task.
    Rows are cut into blocks of ``block_rows`` consecutive row numbers instead. A block's
    last present value is an aggregate; carrying it over blocks happens in groups of
    ``block_rows`` blocks, and those groups (rows / block_rows**2 of them) are the only
    thing ordered in one place. The table itself is shuffled once, by block, so neither a
    long key nor a long gap can fill a task.
    """
    require_row_no(df, "A forward fill")
    require_columns(df, [*columns, *partition_by])
    keys = [f"`{k}`" for k in partition_by]
    held = {
        c: F.when(~is_missing(_col(c), dtype_of(df, c)), _col(c)) for c in columns
    }
    blocked = df.withColumn("__block", F.floor(F.col(ROW_NO) / F.lit(block_rows)))

    lasts = blocked.groupBy(*keys, "__block").agg(
        *[
            F.max(F.when(~is_missing(_col(c), dtype_of(df, c)), F.struct(ROW_NO, _col(c).alias("v")))).getField("v").alias(f"__last{i}")
            for i, c in enumerate(columns)
        ]
    ).withColumn("__group", F.floor(F.col("__block") / F.lit(block_rows)))
    before = Window.partitionBy(*keys, "__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    groups = lasts.groupBy(*keys, "__group").agg(
        *[
            F.max_by(F.col(f"__last{i}"), F.when(F.col(f"__last{i}").isNotNull(), F.col("__block"))).alias(f"__glast{i}")
            for i in range(len(columns))
        ]
    )
    # Without keys this window sees rows / block_rows**2 rows: about fifteen for 10**12 rows.
    group_order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    group_order = group_order.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    group_carry = groups.select(
        *keys, "__group", *[F.last(f"__glast{i}", ignorenulls=True).over(group_order).alias(f"__gcarry{i}") for i in range(len(columns))]
    )
    group_on = [*partition_by, "__group"]
    carry = _null_safe_join(
        lasts.select(*keys, "__group", "__block", *[F.last(f"__last{i}", ignorenulls=True).over(before).alias(f"__in{i}") for i in range(len(columns))]),
        group_carry,
        group_on,
    ).select(
        *keys, "__block", *[F.coalesce(F.col(f"__in{i}"), F.col(f"__gcarry{i}")).alias(f"__carry{i}") for i in range(len(columns))]
    )
    upto = Window.partitionBy(*keys, "__block").orderBy(ROW_NO).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _null_safe_join(blocked, carry, [*partition_by, "__block"])
    new = {
        c: F.coalesce(F.last(held[c], ignorenulls=True).over(upto), F.col(f"__carry{i}"), _col(c))
        for i, c in enumerate(columns)
    }
    return replace_columns(joined, new).select(*[_col(c) for c in df.columns])


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that treats null keys as equal and keeps one copy of the keys."""
    if len(on) == 1:
        return left.join(right, on[0], "left")
    renamed = right.select(*[_col(k).alias(f"__r{i}") for i, k in enumerate(on)], *[_col(c) for c in right.columns if c not in on])
    match = None
    for i, k in enumerate(on):
        test = left[f"`{k}`"].eqNullSafe(renamed[f"__r{i}"])
        match = test if match is None else match & test
    return left.join(renamed, match, "left").drop(*[f"__r{i}" for i in range(len(on))])
