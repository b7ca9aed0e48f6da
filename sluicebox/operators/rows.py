"""Row-set operators: exact de-duplication, survivorship, sorting (CL-17, CL-18, CL-19)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_action
from ..functions.dates import canonical_date
from ..functions.text import count_present, render_cell, stable_json, stringify
from ..session import stage
from ..table import ROW_NO, data_columns, dtype_of, require_columns, require_row_no


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_duplicates(df: DataFrame, keep: str = "first") -> DataFrame:
    """CL-17: one row per distinct content, the first or last by source row.

    A plain aggregate: the map side folds copies before the shuffle, so content shared by a
    third of the table costs one row per map task.
    """
    if keep not in ("first", "last"):
        raise invalid_action(f"Unknown keep rule: {keep}")
    require_row_no(df, "Dropping duplicates")
    pick = F.min if keep == "first" else F.max
    kept = df.groupBy(*[_col(c) for c in data_columns(df)]).agg(pick(ROW_NO).alias(ROW_NO))
    return kept.select(*[_col(f.name).alias(f.name, metadata=f.metadata) for f in df.schema.fields])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Distinct contents with their number of copies and first row."""
    aggs = [F.count("*").alias("__copies")]
    if ROW_NO in df.columns:
        aggs.append(F.min(ROW_NO).alias("__first"))
    return df.groupBy(*[_col(c) for c in data_columns(df)]).agg(*aggs)


def with_digest(df: DataFrame) -> DataFrame:
    """``df`` with 128 bits that stand for a row's content; rows of equal content have equal ones. Nulls count by their place."""
    cells = [_col(c) for c in data_columns(df)]
    parts = [*cells, *[c.isNull() for c in cells]]
    return df.withColumns({"__d1": F.xxhash64(*parts), "__d2": F.xxhash64(F.lit(1), *parts)})


def repeated_rows(df: DataFrame) -> DataFrame | None:
    """The rows whose digest others share, staged; None where there are none. Every repeat is among them, and next to nothing else.

    Only digests are grouped, so 16 bytes a row are shuffled. The digests that repeat are staged first: their size is known when the rows are
    read again, so few of them are broadcast and many are joined by a shuffle.
    """
    marked = with_digest(df)
    again = stage(marked.groupBy("__d1", "__d2").count().where("count > 1").select("__d1", "__d2"), "repeats")
    if again.isEmpty():
        return None
    return stage(marked.join(again, ["__d1", "__d2"], "left_semi").select(*[_col(c) for c in df.columns]), "repeated")


def split_by_repeats(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key no other row has, and the rest; a few single rows may be among the rest.

    Digests of keys are counted, 24 bytes a row and folded before the shuffle. An aggregate that picks whole rows sorts each task's rows,
    so the rows that need no picking are kept out of it. Both parts read one shuffle of the rows by digest, in which a hot key is split.
    """
    digests = ["__d1", "__d2"]
    marked = df.withColumns({"__d1": F.xxhash64(*keys), "__d2": F.xxhash64(F.lit(1), *keys)})
    again = marked.groupBy(*digests).agg(F.count("*").alias("__n")).where("__n > 1").select(*digests)
    alone, contested = (marked.join(again, digests, how).select(*[_col(c) for c in df.columns]) for how in ("left_anti", "left_semi"))
    return alone, contested


def key_columns(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    require_columns(df, keys)
    return [stringify(_col(k), dtype_of(df, k)) for k in keys]


def counted_by_key(df: DataFrame, keys: Sequence[str], counters: Mapping[str, Column]) -> DataFrame:
    """One row: the named counts over the table, ``rows``, and ``repeats``, the rows beyond the first of each key (PR-15).

    Counts of each key are added up, so the table is read once for both.
    """
    groups = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(key_columns(df, keys))]).agg(
        F.count("*").alias("__n"), *[c.alias(n) for n, c in counters.items()]
    )
    sums = {"rows": F.sum("__n"), "repeats": F.sum(F.col("__n") - 1), **{n: F.sum(n) for n in counters}}
    return groups.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()])


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PR-15: rows beyond the first of each business key."""
    groups = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(key_columns(df, keys))]).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


def keep_best(
    df: DataFrame, keys: Sequence[str], completeness: Sequence[str], latest: str | None = None
) -> DataFrame:
    """CL-18: one survivor per business key.

    Ranked by filled completeness fields, then by the canonical timestamp to the minute
    (missing ranks lowest), then by row text. The maximum has a map-side stage, so a key held
    by a third of the rows shrinks to one row per map task before the shuffle. ``max`` of one
    struct evaluates the ranking once per row; ``max_by`` would evaluate it several times.
    """
    fields = data_columns(df)
    rank: list[Column] = [count_present([(_col(c), dtype_of(df, c)) for c in completeness])]
    if latest is not None:
        rank.append(F.coalesce(canonical_date(_col(latest).cast("string"), True), F.lit("")))
    rank.append(stable_json([(c, _col(c)) for c in fields]))
    if ROW_NO in df.columns:
        rank.append(-F.col(ROW_NO))
    best = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(key_columns(df, keys))]).agg(
        F.max(F.struct(*rank, F.struct(*[_col(c) for c in df.columns]).alias("row"))).alias("__best")
    )
    return best.select(
        *[F.col("__best.row").getField(f.name).alias(f.name, metadata=f.metadata) for f in df.schema.fields]
    )


def sort_rows(df: DataFrame, columns: Sequence[str], ascending: bool = True) -> DataFrame:
    """CL-19: by the text of the values, missing as ''; equal rows keep source order both ways.

    The row number also spreads a run of equal keys over several range partitions.
    """
    require_columns(df, columns)
    texts = [F.coalesce(render_cell(_col(c), dtype_of(df, c)), F.lit("")) for c in columns]
    order = [t.asc() if ascending else t.desc() for t in texts]
    if ROW_NO in df.columns:
        order.append(F.col(ROW_NO).asc())
    return df.orderBy(*order)
