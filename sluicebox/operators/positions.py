"""Global row positions without a one-task sort (GEN-1)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ..table import ROW_NO

POSITION = "__pos"
_SLOT_BITS = 33
_SLOT_MASK = (1 << _SLOT_BITS) - 1


def with_position(
    df: DataFrame, order: Sequence[Column], ascending: Sequence[bool] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """``columns`` (all, unless named) and ``__pos``: 0-based position of every row under ``order`` (nulls first going up, last going down).

    The rows are range-partitioned and sorted by the order plus a row tie-break, so even a
    run of equal keys spreads over tasks. ``monotonically_increasing_id`` then encodes
    (partition, place in partition). The result is staged durably once; per-partition
    counts (one number per shuffle partition, never per row) become the start offsets.
    """
    spark = df.sparkSession
    tie = F.col(ROW_NO) if ROW_NO in df.columns else F.monotonically_increasing_id()
    names = [f"__o{i}" for i in range(len(order))]
    kept = df.columns if columns is None else list(columns)
    keyed = df.select(*[f"`{c}`" for c in kept], *[c.alias(n) for c, n in zip(order, names, strict=True)], tie.alias("__tie"))
    up = ascending or [True] * len(order)
    sort_by = [*[F.col(n).asc() if a else F.col(n).desc() for n, a in zip(names, up, strict=True)], F.col("__tie").asc()]
    ordered = (
        keyed.repartitionByRange(*sort_by)
        .sortWithinPartitions(*sort_by)
        .select(*[f"`{c}`" for c in kept], F.monotonically_increasing_id().alias("__slot"))
    )
    staged = stage(ordered, "positions")
    part = F.shiftright("__slot", _SLOT_BITS)
    sizes = sorted((r["part"], r["n"]) for r in staged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame(
        [(p, start) for (p, _), start in zip(sizes, starts)], "__part bigint, __start bigint"
    )
    # One row per shuffle partition: its size is fixed by spark.sql.shuffle.partitions.
    return (
        staged.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(POSITION, F.col("__start") + F.col("__slot").bitwiseAND(F.lit(_SLOT_MASK)))
        .select(*[f"`{c}`" for c in kept], POSITION)
    )


def source_position(df: DataFrame) -> DataFrame:
    """Add ``__pos``: 0-based position of every row by its row number, which no two rows share.

    ``df`` is read twice, so pass a staged table. Row numbers without gaps are positions but for their start, so nothing is sorted or moved;
    where rows have gone the rows are sorted.
    """
    facts = df.agg(F.count("*").alias("n"), F.min(ROW_NO).alias("low"), F.max(ROW_NO).alias("high")).first()
    if facts["n"] and facts["high"] - facts["low"] + 1 == facts["n"]:
        return df.withColumn(POSITION, F.col(ROW_NO).cast("bigint") - F.lit(facts["low"]))
    return with_position(df, [F.col(ROW_NO)])
