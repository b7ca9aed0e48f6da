"""Profiling and issue detection (PR-1..18, GEN-3, GEN-4).

One fused pass counts everything every detector and the type inference need. It groups by
(block of source rows, column), which costs nothing extra and tells which blocks hold the
first hits; the pass that fetches example rows then reads those few blocks only, through a
row-number predicate the file format can prune on. What reaches the driver is a few numbers
per column, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers as H
from ..functions import numbers, text
from ..functions.dates import LAYOUTS, date_layout
from ..table import (
    FIRST_ROW_NUMBER,
    ROW_NO,
    data_columns,
    display_names,
    dtype_of,
    require_columns,
    text_columns,
)
from .rows import counted_by_key, duplicate_groups, key_columns, repeated_rows

EXAMPLES = 5
BLOCK_ROWS = 1 << 16

# Words read as booleans.
BOOLEAN_WORDS = ("true", "false", "yes", "no")

ISSUE_SCHEMA = (
    "type string, title string, message string, affected_count bigint, affected_unit string, "
    "affected_columns array<string>, example_rows array<bigint>"
)
COLUMN_SCHEMA = "id string, name string, position int, inferred_type string"

_COUNTERS = (
    "rows", "missing", "padded", "boolean", "numeric", "integer", "loose_numeric", "leading_zero", "dated",
    "timed", "formula", *LAYOUTS,
)
# Hits an example row is wanted for, with the counter that totals them.
_HITS = {"missing": "missing", "padded": "padded", "loose_numeric": "loose_numeric", "dated": "dated"}


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _cells_long(df: DataFrame, names: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """One row per cell: column name, text, and the kind of type the column has."""
    texts = set(text_columns(df))
    entries = [
        F.struct(
            F.lit(c).alias("name"),
            F.when(~text.is_missing(_col(c), dtype_of(df, c)), text.render_cell(_col(c), dtype_of(df, c))).alias("v")
            if c not in texts
            else _col(c).alias("v"),
            F.lit(_native_kind(dtype_of(df, c))).alias("kind"),
        )
        for c in names
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def _native_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "decimal"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "native"
    return "text"


def _prepared(cells: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Strip and unformat each cell once; as columns of their own they are not recomputed per test."""
    stripped = cells.select(*keep, "v", "kind", F.coalesce(text.strip(F.col("v")), F.lit("")).alias("s"))
    return stripped.select("*", F.translate("s", ",$", "").alias("bare"), (F.col("kind") == "text").alias("is_text"))


def _flags() -> dict[str, Column]:
    """Tests on a prepared cell."""
    s, bare, kind, is_text = F.col("s"), F.col("bare"), F.col("kind"), F.col("is_text")
    native_number = kind.isin("integer", "decimal") & (s != "")
    return {
        "missing": s == "",
        "padded": is_text & F.coalesce(F.col("v") != s, F.lit(False)),
        "boolean": is_text & F.lower(s).isin(*BOOLEAN_WORDS),
        "numeric": (is_text & bare.rlike(numbers.DECIMAL_PATTERN.replace("$", "%?$"))) | native_number,
        "integer": bare.rlike(numbers.INTEGER_PATTERN.replace("$", "%?$")) & (is_text | native_number),
        "loose_numeric": is_text & bare.rlike(numbers.DECIMAL_PATTERN.replace("$", "%*$")),
        "leading_zero": is_text & bare.rlike(numbers.LEADING_ZERO_PATTERN),
        "layout": F.when(is_text, date_layout(s, stripped=True)).when(
            kind.isin("date", "datetime") & (s != ""), F.concat(F.lit("native_"), kind)
        ),
        "formula": is_text & text.looks_like_formula(F.col("v")),
    }


def _counter_columns() -> list[Column]:
    layout = F.col("layout")
    counts = {
        "rows": F.count("*"),
        "missing": F.count_if("missing"),
        "padded": F.count_if("padded"),
        "boolean": F.count_if("boolean"),
        "numeric": F.count_if("numeric"),
        "integer": F.count_if("integer"),
        "loose_numeric": F.count_if("loose_numeric"),
        "leading_zero": F.count_if("leading_zero"),
        "dated": F.count("layout"),
        "timed": F.count_if(layout.isin("iso_datetime", "native_datetime")),
        "formula": F.count_if("formula"),
        **{name: F.count_if(layout == name) for name in LAYOUTS},
    }
    return [counts[name].alias(name) for name in _COUNTERS]


def block_counters(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """GEN-3: every counter per (block of source rows, column)."""
    block = F.floor(F.col(ROW_NO) / F.lit(block_rows)) if ROW_NO in df.columns else F.lit(0).cast("bigint")
    cells = _cells_long(df, data_columns(df), [block.alias("block")])
    return (
        _prepared(cells, ["block", "name"])
        .select("block", "name", *[c.alias(n) for n, c in _flags().items()])
        .groupBy("block", "name")
        .agg(*_counter_columns())
    )


def column_counters(df: DataFrame) -> DataFrame:
    """Every counter per column."""
    return block_counters(df).groupBy("name").agg(*[F.sum(c).alias(c) for c in _COUNTERS])


def _inferred_type(c: Mapping[str, int]) -> str:
    """PR-1: the order of the tests matters."""
    present = c["rows"] - c["missing"]
    if not present:
        return "empty"
    if c["boolean"] == present:
        return "boolean"
    if c["dated"] == present:
        return "datetime" if c["timed"] else "date"
    if c["numeric"] == present:
        return "integer" if c["integer"] == present else "decimal"
    return "mixed" if c["numeric"] else "text"


@dataclass
class Profile:
    """Numbers per column plus the issues they amount to; ``columns()`` and ``issues()`` are DataFrames."""

    source: DataFrame
    headers: dict[str, str]
    counters: dict[str, dict[str, int]]
    pure_text: dict[str, bool]
    duplicate_count: int = 0
    duplicate_examples: list[int] = field(default_factory=list)
    examples: dict[tuple[str, str], list[int]] = field(default_factory=dict)

    @property
    def inferred(self) -> dict[str, str]:
        return {c: _inferred_type(n) for c, n in self.counters.items()}

    @property
    def formula_count(self) -> int:
        return sum(n["formula"] for n in self.counters.values())

    def missing(self, column: str) -> int:
        return self.counters[column]["missing"]

    def example_rows(self, hit: str, columns: Iterable[str]) -> list[int]:
        """PR-10: first five per column, columns in order, repeats dropped, first five kept."""
        rows = [r for c in columns for r in self.examples.get((c, hit), [])]
        return list(dict.fromkeys(rows))[:EXAMPLES]

    # Which columns each detector flags.
    def columns_with(self, counter: str) -> list[str]:
        return [c for c, n in self.counters.items() if n[counter]]

    def numeric_text_columns(self) -> list[str]:
        out = []
        for c, n in self.counters.items():
            present = n["rows"] - n["missing"]
            header = self.headers[c]
            if H.is_identifier_like(header) or H.is_date_like(header) or not self.pure_text[c]:
                continue
            if present >= 2 and not n["leading_zero"] and n["loose_numeric"] / present >= 0.8:
                out.append(c)
        return out

    def empty_columns(self) -> list[str]:
        return [c for c, n in self.counters.items() if n["missing"] == n["rows"]]

    def inconsistent_date_columns(self) -> list[str]:
        out = []
        for c, n in self.counters.items():
            present = n["rows"] - n["missing"]
            if present < 2 or not (H.is_date_like(self.headers[c]) or n["dated"] / present >= 0.8):
                continue
            if sum(1 for name in LAYOUTS if n[name]) >= 2:
                out.append(c)
        return out

    def messy_columns(self) -> list[str]:
        ids = list(self.headers)
        return [ids[i] for i in H.messy_positions(list(self.headers.values()))]

    def issue_rows(self) -> list[tuple]:
        """PR-2..8 in their fixed order."""
        rows = []

        def total(counter: str, columns: Sequence[str]) -> int:
            return sum(self.counters[c][counter] for c in columns)

        def add(kind, title, message, count, unit, columns, examples) -> None:
            if count:
                rows.append((kind, title, message, count, unit, list(columns), list(examples)))

        missing = self.columns_with("missing")
        n = total("missing", missing)
        add("missing_values", "Empty cells", f"{n} cells in {len(missing)} columns hold no value.",
            n, "cells", missing, self.example_rows("missing", missing))
        n = self.duplicate_count
        add("duplicate_rows", "Repeated rows", f"{n} rows are exact copies of an earlier one.",
            n, "rows", [], self.duplicate_examples)
        padded = self.columns_with("padded")
        n = total("padded", padded)
        add("whitespace", "Padded text", f"{n} values start or end with spaces.",
            n, "values", padded, self.example_rows("padded", padded))
        messy = self.messy_columns()
        add("messy_column_names", "Untidy column names",
            f"{len(messy)} headers are blank, padded, repeated or unnamed.", len(messy), "columns", messy, [])
        numeric = self.numeric_text_columns()
        add("numeric_text", "Numbers held as text",
            f"{len(numeric)} text columns read almost entirely as numbers.",
            total("loose_numeric", numeric), "values", numeric, self.example_rows("loose_numeric", numeric))
        empty = self.empty_columns()
        add("empty_columns", "Columns without values", f"{len(empty)} columns are empty throughout.",
            len(empty), "columns", empty, [])
        dated = self.inconsistent_date_columns()
        add("inconsistent_dates", "Mixed date layouts",
            f"{len(dated)} columns write their dates in several layouts.",
            total("dated", dated), "values", dated, self.example_rows("dated", dated))
        return rows

    def issues(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(self.issue_rows(), ISSUE_SCHEMA)

    def columns(self) -> DataFrame:
        kinds = self.inferred
        rows = [(c, h, i, kinds[c]) for i, (c, h) in enumerate(self.headers.items())]
        return self.source.sparkSession.createDataFrame(rows, COLUMN_SCHEMA)

    def download_warnings(self) -> DataFrame:
        """PR-18 as rows: none when nothing looks like a formula."""
        n = self.formula_count
        rows = [(
            "formula_like_values", "Text that may run as a formula",
            f"{n} values start with a formula character; they are exported as they are.", n,
        )] if n else []
        return self.source.sparkSession.createDataFrame(rows, "code string, title string, message string, affected_count bigint")


def profile_table(
    df: DataFrame, block_rows: int = BLOCK_ROWS, with_duplicates: bool = True, with_examples: bool = True
) -> Profile:
    """PR-9: descriptors and all issues of a table; the flags leave out the passes behind PR-3 and PR-10."""
    names = data_columns(df)
    blocks = block_counters(df, block_rows).persist()
    try:
        zero = {c: 0 for c in _COUNTERS}
        totals = blocks.groupBy("name").agg(*[F.sum(c).alias(c) for c in _COUNTERS]).collect()
        found = {r["name"]: {c: r[c] for c in _COUNTERS} for r in totals}
        profile = Profile(
            source=df,
            headers=display_names(df),
            counters={c: found.get(c, zero) for c in names},
            pure_text={
                c: isinstance(dtype_of(df, c), T.StringType) and not df.schema[c].metadata.get("converted", False)
                for c in names
            },
        )
        wanted = {
            "missing": profile.columns_with("missing"),
            "padded": profile.columns_with("padded"),
            "loose_numeric": profile.numeric_text_columns(),
            "dated": profile.inconsistent_date_columns(),
        }
        pairs = [(c, hit) for hit, columns in wanted.items() for c in columns]
        if with_examples and ROW_NO in df.columns and pairs:
            profile.examples = _examples(df, pairs, _first_blocks(blocks, pairs), block_rows)
    finally:
        blocks.unpersist()
    if with_duplicates:
        profile.duplicate_count, profile.duplicate_examples = _duplicates(df, with_examples)
    return profile


def _first_blocks(blocks: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[int]:
    """The few blocks that hold the first five hits of each (column, kind of hit)."""
    by_hit: dict[str, list[str]] = {}
    for c, hit in pairs:
        by_hit.setdefault(hit, []).append(c)
    hits = F.array(*[
        F.struct(F.lit(hit).alias("hit"), F.when(F.col("name").isin(columns), F.col(_HITS[hit])).alias("n"))
        for hit, columns in by_hit.items()
    ])
    order = Window.partitionBy("name", "hit").orderBy("block")
    rows = (
        blocks.select("block", "name", F.inline(hits))
        .where("n > 0")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= EXAMPLES)
        .select("name", "hit", "block", "n")
        .collect()
    )
    needed: set[int] = set()
    seen: dict[tuple[str, str], int] = {}
    for r in sorted(rows, key=lambda r: r["block"]):
        pair = (r["name"], r["hit"])
        if seen.get(pair, 0) < EXAMPLES:
            needed.add(r["block"])
            seen[pair] = seen.get(pair, 0) + r["n"]
    return sorted(needed)


def _in_blocks(blocks: Sequence[int], block_rows: int) -> Column:
    """A row-number predicate the scan can prune on: merged ranges, at most five blocks for each column and kind of hit."""
    ranges: list[list[int]] = []
    for b in blocks:
        if ranges and ranges[-1][1] == b - 1:
            ranges[-1][1] = b
        else:
            ranges.append([b, b])
    row = F.col(ROW_NO)
    test = F.lit(False)
    for first, last in ranges:
        test = test | row.between(first * block_rows, (last + 1) * block_rows - 1)
    return test


def _examples(
    df: DataFrame, pairs: Sequence[tuple[str, str]], blocks: Sequence[int], block_rows: int
) -> dict[tuple[str, str], list[int]]:
    """GEN-4: first five row numbers per (column, kind of hit), from the given blocks."""
    if not blocks:
        return {}
    columns = list(dict.fromkeys(c for c, _ in pairs))
    chosen = {hit: [c for c, h in pairs if h == hit] for hit in dict.fromkeys(h for _, h in pairs)}
    flags = _flags()
    flags["dated"] = flags["layout"].isNotNull()
    cells = _cells_long(df.where(_in_blocks(blocks, block_rows)), columns, [F.col(ROW_NO)])
    hits = F.array(*[
        F.struct(F.lit(hit).alias("hit"), (F.col("name").isin(names) & flags[hit]).alias("is_hit"))
        for hit, names in chosen.items()
    ])
    order = Window.partitionBy("name", "hit").orderBy(ROW_NO)
    rows = (
        _prepared(cells, [ROW_NO, "name"])
        .select(ROW_NO, "name", F.inline(hits))
        .where("is_hit")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= EXAMPLES)
        .select("name", "hit", ROW_NO)
        .collect()
    )
    out: dict[tuple[str, str], list[int]] = {}
    for r in sorted(rows, key=lambda r: r[ROW_NO]):
        out.setdefault((r["name"], r["hit"]), []).append(r[ROW_NO] + FIRST_ROW_NUMBER)
    return out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """PR-3 count: exact repeats of an earlier row."""
    return duplicate_groups(df).agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


def repeated_row_numbers(df: DataFrame) -> DataFrame:
    """Row numbers of exact repeats. Joins row numbers only, and those are unique: no group is ever collected."""
    firsts = duplicate_groups(df).select(F.col("__first").alias(ROW_NO))
    return df.select(ROW_NO).join(firsts, ROW_NO, "left_anti")


def _duplicates(df: DataFrame, with_examples: bool) -> tuple[int, list[int]]:
    """How many rows repeat an earlier one, and the first of them. Whole rows are compared only where digests repeat."""
    repeated = repeated_rows(df)
    if repeated is None:
        return 0, []
    count = duplicate_rows(repeated).first()["duplicate_count"]
    if not count or not with_examples or ROW_NO not in df.columns:
        return count, []
    first = repeated_row_numbers(repeated).orderBy(ROW_NO).limit(EXAMPLES).collect()
    return count, [r[ROW_NO] + FIRST_ROW_NUMBER for r in first]


# --- Single measures ---------------------------------------------------------------------


def formula_like_count(df: DataFrame) -> DataFrame:
    """PR-18: text cells starting like a formula."""
    per_row = F.lit(0)
    for c in text_columns(df):
        per_row = per_row + text.looks_like_formula(_col(c)).cast("int")
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("affected_count"))


def inspect_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PR-11: rows, columns, missing per column, repeated keys; one row."""
    names = data_columns(df)
    missing = [F.count_if(text.is_missing(_col(c), dtype_of(df, c))).alias(f"__m{i}") for i, c in enumerate(names)]
    counted = df.agg(F.count("*").alias("row_count"), *missing)
    repeats = _repeats(df, keys)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("missing")) for i, c in enumerate(names)]
    return counted.select(
        "row_count",
        F.lit(len(names)).cast("bigint").alias("column_count"),
        F.map_from_entries(F.array(*pairs)).alias("missing_by_column"),
        repeats.alias("duplicate_key_count"),
    )


def _repeats(df: DataFrame, keys: Sequence[str]) -> Column:
    if not keys:
        return F.lit(0).cast("bigint")
    groups = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(key_columns(df, keys))]).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint")).scalar()


def inspect_column(df: DataFrame, column: str) -> DataFrame:
    """PR-12: missing, distinct, and the first five distinct values in row order; one row.

    One grouping by value serves all three; the sample is a top-five, not a collected group.
    """
    require_columns(df, [column])
    dtype = dtype_of(df, column)
    first = F.min(ROW_NO) if ROW_NO in df.columns else F.lit(0)
    values = df.groupBy(_col(column).alias("v")).agg(F.count("*").alias("n"), first.alias("first"))
    sample = (
        values.orderBy("first", "v").limit(EXAMPLES)
        .agg(F.array_sort(F.collect_list(F.struct("first", "v"))).alias("s"))
        .select(F.transform("s", lambda x: text.stringify(x["v"], dtype)))
        .scalar()
    )
    return values.agg(
        F.coalesce(F.sum(F.when(text.is_missing(F.col("v"), dtype), F.col("n"))), F.lit(0)).cast("bigint").alias("missing_count"),
        F.count("*").alias("distinct_count"),
    ).select(F.lit(column).alias("column"), "missing_count", "distinct_count", sample.alias("unique_sample"))


def table_summary(df: DataFrame, required: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """PR-16: rows, columns, missing required cells, repeated keys; one row."""
    present = [c for c in required if c in df.columns]
    missing = F.lit(0).cast("bigint")
    for c in present:
        missing = missing + F.count_if(text.is_missing(_col(c), dtype_of(df, c)))
    if keys:
        counted = counted_by_key(df, keys, {"missing": missing})
    else:
        counted = df.agg(F.count("*").alias("rows"), missing.alias("missing"), F.lit(0).cast("bigint").alias("repeats"))
    return counted.select(
        F.col("rows").alias("row_count"),
        F.lit(len(data_columns(df))).cast("bigint").alias("column_count"),
        F.col("missing").alias("missing_required_cells"),
        F.col("repeats").alias("duplicate_count"),
    )


def completeness_score(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """PR-17: filled required cells over all required cells; 1 for an empty table."""
    cells = [(_col(c), dtype_of(df, c)) for c in required if c in df.columns]
    filled = F.sum(text.count_present(cells)) if cells else F.lit(0)
    total = F.count("*") * F.lit(len(required))
    return df.agg(F.when(total == 0, F.lit(1.0)).otherwise(filled / total).alias("completeness"))


