"""Reconciliation: positional grading, footprints and keyed diffs (CM-1..6, CM-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import grading_number
from ..functions.text import stable_json, stringify
from ..session import stage
from ..table import ROW_NO, data_columns, dtype_of, require_row_no
from .columns import align_columns
from .positions import POSITION, source_position, with_position
from .rows import key_columns, split_by_repeats

# Bounds of a published score and the numeric tolerance of a match.
SCORE_MIN, SCORE_MAX = 0.01, 0.99
NUMERIC_TOLERANCE = 1e-6
#: Rows of a block of positions whose digests are compared, as a power of two.
BLOCK_BITS = 10


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def canonical_order(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """CM-1: key texts, then the text of the whole row."""
    return [*key_columns(df, keys), stable_json([(c, _col(c)) for c in data_columns(df)])]


def canonical_sort(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CM-1 as a sorted table."""
    aligned = align_columns(df, columns)
    return aligned.orderBy(*canonical_order(aligned, keys))


def cells_match(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType, numeric: bool) -> Column:
    """CM-3: numbers within the tolerance where both sides are numbers, else equal text."""
    same_text = stringify(left, left_type) == stringify(right, right_type)
    if not numeric:
        return same_text
    a, b = grading_number(left, left_type), grading_number(right, right_type)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= NUMERIC_TOLERANCE).otherwise(same_text)


def _positioned(df: DataFrame, columns: Sequence[str], order: Sequence[Column] | None) -> DataFrame:
    """``columns`` of every row with its position under ``order``, or by row number where that is None.

    The columns and the values of the order are staged first, so what made ``df`` runs once, although a sort samples its input before it
    reads it.
    """
    if order is None:
        require_row_no(df, "Positional comparison in source order")
    keys = {f"__k{i}": c for i, c in enumerate(order or [])}
    tie = [ROW_NO] if ROW_NO in df.columns else []
    staged = stage(df.select(*[_col(c) for c in columns], *tie, *[c.alias(k) for k, c in keys.items()]), "compared")
    if order is None:
        return source_position(staged)
    return with_position(staged, [F.col(k) for k in keys], columns=columns)


def _block() -> Column:
    return F.shiftright(POSITION, BLOCK_BITS).alias("__block")


def _block_digests(df: DataFrame, cells: Sequence[Column], never: Column, tag: str) -> DataFrame:
    """Per block of positions its rows and 128 bits that stand for its cells and their places; ``never`` marks rows that equal none."""
    parts = [F.col(POSITION), *cells, *[c.isNull() for c in cells]]
    return df.groupBy(_block()).agg(
        F.struct(
            F.bit_xor(F.xxhash64(*parts)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("d2"), F.count("*").alias("n")
        ).alias(f"__digest_{tag}"),
        F.count("*").alias(f"__rows_{tag}"),
        F.coalesce(F.bool_or(never), F.lit(False)).alias(f"__never_{tag}"),
    )


def differing_rows(left: DataFrame, right: DataFrame, left_cells: Sequence[Column], right_cells: Sequence[Column], never: Sequence[Column] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The rows of both sides in blocks of positions that differ, and the number of rows in all other blocks, which agree cell by cell.

    Both sides are staged and hold ``__pos``. A block of 1,024 positions is one digest a side, folded before the shuffle; only these meet.
    Rows themselves are read again for differing blocks alone, so equal tables shuffle no row. ``never`` marks, for each side, rows that equal no row.
    """
    no = never or [F.lit(False), F.lit(False)]
    met = _block_digests(left, left_cells, no[0], "a").join(_block_digests(right, right_cells, no[1], "b"), "__block", "full_outer")
    same = (F.col("__digest_a") == F.col("__digest_b")) & ~F.col("__never_a") & ~F.col("__never_b")
    blocks = stage(met.select("__block", F.coalesce(same, F.lit(False)).alias("__same"), F.col("__rows_a").alias("__rows")), "blocks")
    agreed = blocks.agg(F.sum(F.when(F.col("__same"), F.col("__rows")))).first()[0] or 0
    unequal = blocks.where(~F.col("__same")).select("__block")
    left, right = (side.withColumn("__block", _block()).join(unequal, "__block", "left_semi").drop("__block") for side in (left, right))
    return left, right, agreed


def match_ratio(
    current: DataFrame,
    expected: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] | None,
    numeric: Sequence[str] = (),
) -> DataFrame:
    """CM-2: share of equal cells after lining both tables up by position; one row.

    ``keys`` is the canonical sort key, or None to keep source order. Positions are unique,
    so the outer join cannot be skewed; a row without a partner meets blanks. Blocks of positions whose digests agree are counted without their rows.
    """
    sides = []
    for df in (current, expected):
        aligned = align_columns(df, columns)
        sides.append(_positioned(aligned, columns, None if keys is None else canonical_order(aligned, keys)))
    texts = [[stringify(_col(c), dtype_of(side, c)) for c in columns] for side in sides]
    left, right, agreed = differing_rows(*sides, *texts, [_not_finite(side, numeric) for side in sides])
    left, right = (
        side.select(POSITION, F.lit(True).alias(f"__in_{tag}"), *[_col(c).alias(f"{tag}_{i}") for i, c in enumerate(columns)])
        for side, tag in ((left, "a"), (right, "b"))
    )
    per_row = F.lit(0)
    for i, c in enumerate(columns):
        hit = cells_match(_col(f"a_{i}"), dtype_of(left, f"a_{i}"), _col(f"b_{i}"), dtype_of(right, f"b_{i}"), c in numeric)
        per_row = per_row + hit.cast("int")
    joined = left.join(right, POSITION, "full_outer")
    out = joined.agg(
        (F.coalesce(F.sum(per_row), F.lit(0)) + agreed * len(columns)).cast("bigint").alias("matches"),
        (F.greatest(F.count("*") + agreed, F.lit(1)) * len(columns)).cast("bigint").alias("cells"),
        (F.count("__in_a") + agreed).alias("current_rows"),
        (F.count("__in_b") + agreed).alias("expected_rows"),
    )
    # An empty comparison is one blank row against another: every cell matches.
    matches = F.when(F.greatest("current_rows", "expected_rows") == 0, F.col("cells")).otherwise(F.col("matches"))
    return out.withColumn("matches", matches).withColumn("ratio", F.col("matches") / F.col("cells"))


def _not_finite(df: DataFrame, numeric: Sequence[str]) -> Column:
    """Rows with a number that equals no number, itself included: their texts may be equal, and the cells still differ."""
    odd = F.lit(False)
    for c in numeric:
        number = grading_number(_col(c), dtype_of(df, c))
        odd = odd | F.coalesce(F.isnan(number - number), F.lit(False))
    return odd


def clamp_score(ratio: Column) -> Column:
    """CM-4 / CM-8."""
    return F.round(F.least(F.greatest(ratio, F.lit(SCORE_MIN)), F.lit(SCORE_MAX)), 6)


def change_footprint(
    before: DataFrame,
    after: DataFrame,
    before_order: Sequence[Column] | None = None,
    after_order: Sequence[Column] | None = None,
    by_row: bool = False,
) -> DataFrame:
    """CM-5: changed rows, exact changed-cell counts per column, and the wide column set; one row.

    Rows pair by position, or by source row number with ``by_row`` (no sort needed, for plans
    that never reorder). By position, blocks of rows whose digests agree are passed over. ``columns`` lists every column of both tables as soon as one row
    changed; ``changed_cells`` counts per column exactly.
    """
    names = list(dict.fromkeys([*data_columns(before), *data_columns(after)]))
    key = ROW_NO if by_row else POSITION

    def cells(df: DataFrame) -> list[Column]:
        return [stringify(_col(c), dtype_of(df, c)) if _is_float(df, c) else _col(c).cast("string") for c in names if c in df.columns]

    if not by_row:
        sides = [_positioned(df, data_columns(df), order) for df, order in ((before, before_order), (after, after_order))]
        before, after = sides
        # Tables of other columns differ in every row.
        if set(data_columns(before)) == set(data_columns(after)):
            before, after, _ = differing_rows(*sides, *[cells(side) for side in sides])

    def side(df: DataFrame, tag: str) -> DataFrame:
        held = [i for i, c in enumerate(names) if c in df.columns]
        texts = [c.alias(f"{tag}_{i}") for i, c in zip(held, cells(df), strict=True)]
        return df.select(key, F.lit(True).alias(f"__in_{tag}"), *texts)

    left, right = side(before, "a"), side(after, "b")
    joined = left.join(right, key, "full_outer")
    diffs: list[Column] = []
    for i in range(len(names)):
        a = _col(f"a_{i}") if f"a_{i}" in left.columns else None
        b = _col(f"b_{i}") if f"b_{i}" in right.columns else None
        if a is not None and b is not None:
            diffs.append(~a.eqNullSafe(b))
        else:
            diffs.append((a if a is not None else b).isNotNull())
    unpaired = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    any_diff = unpaired | F.lit(set(data_columns(before)) != set(data_columns(after)))
    for d in diffs:
        any_diff = any_diff | d
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"__d{i}").alias("cells")) for i, c in enumerate(names)]
    return joined.agg(
        F.count_if(any_diff).alias("row_count"), *[F.count_if(d).alias(f"__d{i}") for i, d in enumerate(diffs)]
    ).select(
        "row_count",
        F.when(F.col("row_count") > 0, F.array(*[F.lit(c) for c in sorted(names)]))
        .otherwise(F.array().cast("array<string>"))
        .alias("columns"),
        F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, n: n > 0).alias("changed_cells"),
    )


def _is_float(df: DataFrame, column: str) -> bool:
    return isinstance(dtype_of(df, column), (T.DoubleType, T.FloatType))


def keyed_diff(current: DataFrame, baseline: DataFrame, keys: Sequence[str], removed: bool = True) -> DataFrame:
    """CM-6: each current row against the baseline row of the same key.

    Result: the key columns as text, ``status`` (new, changed, unchanged, removed) and the
    changed columns. The baseline is staged, reduced to its last row per key, which only repeated keys are ranked for, and staged again, so the join is
    many-to-one between two plain shuffles, and adaptive execution splits a hot key of ``current``. Removed
    keys come from an anti join of the staged keys; for them ``current`` is staged too, so that what made it runs once
    and only its keys are read again.
    """
    columns = data_columns(current)
    shared = [c for c in columns if c in data_columns(baseline)]

    def keyed(df: DataFrame, names: Sequence[str], tag: str) -> DataFrame:
        cells = [stringify(_col(c), dtype_of(df, c)).alias(f"{tag}_{i}") for i, c in enumerate(names)]
        ks = [k.alias(f"__k{i}") for i, k in enumerate(key_columns(df, keys))]
        order = [F.col(ROW_NO)] if ROW_NO in df.columns else []
        return df.select(*ks, *cells, *order)

    names = [f"__k{i}" for i in range(len(keys))]
    left = keyed(current, columns, "a").drop(ROW_NO)
    if removed:
        left = stage(left, "current")
    base = keyed(baseline, shared, "b")
    row = F.struct(*[f"b_{i}" for i in range(len(shared))])
    pick = F.max_by(row, F.col(ROW_NO)) if ROW_NO in base.columns else F.max(row)
    alone, contested = split_by_repeats(stage(base, "baseline"), [F.col(n) for n in names])
    one = alone.select(*names, row.alias("__base")).unionByName(contested.groupBy(*names).agg(pick.alias("__base")))
    base = stage(one, "baseline-by-key")
    joined = left.join(base, names, "left")
    tests = []
    for i, c in enumerate(columns):
        other = F.col("__base").getField(f"b_{shared.index(c)}") if c in shared else F.lit("")
        tests.append(F.when(F.col(f"a_{i}") != other, F.lit(c)))
    changed = F.filter(F.array(*tests), lambda x: x.isNotNull())
    is_new = F.col("__base").isNull()
    out = joined.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
        F.when(is_new, "new").when(F.size(changed) > 0, "changed").otherwise("unchanged").alias("status"),
        F.when(is_new, F.array(*[F.lit(c) for c in columns])).otherwise(changed).alias("changed_columns"),
    )
    if not removed:
        return out
    gone = base.select(*names).join(left.select(*names).distinct(), names, "left_anti")
    return out.unionByName(
        gone.select(
            *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
            F.lit("removed").alias("status"),
            F.array().cast("array<string>").alias("changed_columns"),
        )
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Rows per status."""
    return diff.groupBy("status").agg(F.count("*").alias("rows"))


def graded(ratio_row: DataFrame) -> DataFrame:
    return ratio_row.withColumn("score", clamp_score(F.col("ratio")))


