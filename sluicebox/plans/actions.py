"""Typed cleaning actions. An action is data; applying it gives a lazy DataFrame.

A row-local action offers new cell expressions and per-row counts, so previews and audits of
a whole chain of such actions are one projection and one aggregate, with no join between
"before" and "after".
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import not_applicable
from ..functions import dates, numbers, text
from ..operators import cells as cell_ops
from ..operators import columns as column_ops
from ..operators import fills, rows
from ..operators.profile import duplicate_rows, repeated_row_numbers
from ..table import FIRST_ROW_NUMBER, ROW_NO, data_columns, display_names, dtype_of, replace_columns, text_columns

SAMPLES = 5
METRICS_SCHEMA = (
    "action_type string, summary string, risk string, affected_count bigint, affected_unit string, "
    "unresolved_count bigint, changed_rows bigint, column_ids array<string>"
)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


Learned = tuple | None


def _learned():
    """A field for a fact about the data that an action has looked up; no part of what the action is."""
    return field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Action:
    kind: ClassVar[str] = ""
    unit: ClassVar[str] = "values"
    risk: ClassVar[str] = "low"

    def columns(self, df: DataFrame) -> list[str]:
        """Columns the action names."""
        return []

    def summary(self) -> str:
        return self.kind.replace("_", " ")

    def resolved(self, df: DataFrame) -> Action:
        """The action with what it must learn from ``df`` written down, so that replaying it runs no job."""
        return self

    def cells(self, df: DataFrame) -> dict[str, Column] | None:
        """New cell expressions of a row-local action; None for any other."""
        return None

    def apply(self, df: DataFrame) -> DataFrame:
        new = self.cells(df)
        if new is None:
            raise NotImplementedError
        return replace_columns(df, new)

    def row_counts(self, df: DataFrame) -> tuple[Column, Column]:
        """Affected and unresolved cells of one row."""
        new = self.cells(df) or {}
        return _add([(~_col(c).eqNullSafe(e)).cast("int") for c, e in new.items()]), F.lit(0)

    def metrics(self, df: DataFrame) -> DataFrame:
        """One row of METRICS_SCHEMA for a step that is not row-local."""
        affected, unresolved = self.row_counts(df)
        counted = df.agg(
            F.coalesce(F.sum(affected), F.lit(0)).cast("bigint").alias("a"),
            F.coalesce(F.sum(unresolved), F.lit(0)).cast("bigint").alias("u"),
            F.count_if(affected > 0).alias("r"),
        )
        return counted.select(self.metrics_struct(df, F.col("a"), F.col("u"), F.col("r")).alias("m")).select("m.*")

    def metrics_struct(self, df: DataFrame, affected: Column, unresolved: Column, changed_rows: Column) -> Column:
        ids = self.columns(df)
        return F.struct(
            F.lit(self.kind).alias("action_type"),
            F.lit(self.summary()).alias("summary"),
            F.lit(self.risk).alias("risk"),
            affected.cast("bigint").alias("affected_count"),
            F.lit(self.unit).alias("affected_unit"),
            unresolved.cast("bigint").alias("unresolved_count"),
            changed_rows.cast("bigint").alias("changed_rows"),
            (F.array(*[F.lit(c) for c in ids]) if ids else F.array().cast("array<string>")).alias("column_ids"),
        )

    def samples(self, df: DataFrame) -> DataFrame:
        """Up to five changes: row number, cells before, cells after."""
        new = self.cells(df)
        if not new:
            return df.sparkSession.createDataFrame([], "row_number bigint, before map<string,string>, after map<string,string>")
        changes = F.filter(
            F.array(*[
                F.struct(
                    F.lit(i).alias("place"),
                    F.lit(c).alias("column"),
                    text.render_cell(_col(c), dtype_of(df, c)).alias("old"),
                    e.cast("string").alias("new"),
                    (~_col(c).eqNullSafe(e)).alias("hit"),
                )
                for i, (c, e) in enumerate(new.items())
            ]),
            lambda x: x["hit"],
        )
        return (
            df.select(F.col(ROW_NO), F.inline(changes))
            .orderBy("place", ROW_NO)
            .limit(SAMPLES)
            .select(
                (F.col(ROW_NO) + FIRST_ROW_NUMBER).alias("row_number"),
                F.create_map("column", "old").alias("before"),
                F.create_map("column", "new").alias("after"),
            )
        )

    def to_dict(self) -> dict:
        return {"type": self.kind, **{k: v for k, v in asdict(self).items() if k != "learned"}}


def _constant_metrics(action: Action, df: DataFrame, affected: int) -> DataFrame:
    row = (action.kind, action.summary(), action.risk, affected, action.unit, 0, 0, action.columns(df))
    return df.sparkSession.createDataFrame([row], METRICS_SCHEMA)


# --- Actions on uploaded tables -----------------------------------------------------------


@dataclass(frozen=True)
class TrimWhitespace(Action):
    """CL-1."""

    kind: ClassVar[str] = "trim_whitespace"
    column_ids: tuple[str, ...] = ()

    def columns(self, df):
        return list(self.column_ids)

    def cells(self, df):
        return cell_ops.trimmed(df, list(self.column_ids))


@dataclass(frozen=True)
class RenameColumn(Action):
    """CL-15."""

    kind: ClassVar[str] = "rename_column"
    unit: ClassVar[str] = "column"
    risk: ClassVar[str] = "high"
    column_id: str = ""
    new_name: str = ""

    def columns(self, df):
        return [self.column_id]

    def apply(self, df):
        return column_ops.rename_header(df, self.column_id, self.new_name)

    def metrics(self, df):
        return _constant_metrics(self, df, 1)

    def samples(self, df):
        row = (None, {self.column_id: display_names(df)[self.column_id]}, {self.column_id: self.new_name.strip()})
        return df.sparkSession.createDataFrame([row], "row_number bigint, before map<string,string>, after map<string,string>")


@dataclass(frozen=True)
class FillMissing(Action):
    """CL-7..10."""

    kind: ClassVar[str] = "fill_missing"
    unit: ClassVar[str] = "cells"
    risk: ClassVar[str] = "high"
    column_id: str = ""
    strategy: str = "explicit"
    value: str | None = None
    learned: Learned = _learned()

    def columns(self, df):
        return [self.column_id]

    def resolved(self, df):
        if self.strategy == "explicit" or self.learned is not None:
            return self
        return replace(self, learned=(fills.fill_text(df, self.column_id, self.strategy),))

    def _fill(self, df):
        if self.learned is None:
            return fills.fill_value(df, self.column_id, self.strategy, self.value)
        return F.lit(None) if self.learned[0] is None else self.learned[0]

    def cells(self, df):
        return cell_ops.filled(df, [self.column_id], self._fill(df))

    def apply(self, df):
        new = self._fill(df)
        return replace_columns(df, cell_ops.filled(df, [self.column_id], new), cell_ops.fill_marks(df, [self.column_id], new))

    def row_counts(self, df):
        return text.is_missing(_col(self.column_id), dtype_of(df, self.column_id)).cast("int"), F.lit(0)


@dataclass(frozen=True)
class DropDuplicates(Action):
    """CL-17."""

    kind: ClassVar[str] = "drop_duplicates"
    unit: ClassVar[str] = "rows"
    risk: ClassVar[str] = "high"
    keep: str = "first"

    def apply(self, df):
        return rows.drop_duplicates(df, self.keep)

    def metrics(self, df):
        n = F.col("duplicate_count")
        return duplicate_rows(df).select(self.metrics_struct(df, n, F.lit(0), n).alias("m")).select("m.*")

    def samples(self, df):
        if self.keep == "first":
            gone = repeated_row_numbers(df)
        else:
            gone = df.select(ROW_NO).join(self.apply(df).select(ROW_NO), ROW_NO, "left_anti")
        first = gone.orderBy(ROW_NO).limit(SAMPLES)
        cells = [x for c in data_columns(df) for x in (F.lit(c), text.render_cell(_col(c), dtype_of(df, c)))]
        # At most five row numbers: the side is bounded by SAMPLES.
        return df.join(F.broadcast(first), ROW_NO, "left_semi").orderBy(ROW_NO).select(
            (F.col(ROW_NO) + FIRST_ROW_NUMBER).alias("row_number"),
            F.create_map(*cells).alias("before"),
            F.create_map().cast("map<string,string>").alias("after"),
        )


@dataclass(frozen=True)
class ConvertNumeric(Action):
    """CL-13."""

    kind: ClassVar[str] = "convert_numeric"
    risk: ClassVar[str] = "high"
    column_id: str = ""
    target_type: str = "decimal"
    learned: Learned = _learned()

    def columns(self, df):
        return [self.column_id]

    def resolved(self, df):
        return self if self.learned is not None else replace(self, learned=(cell_ops.can_be_typed(df, self.column_id, self.target_type),))

    def cells(self, df):
        return None

    def apply(self, df):
        return cell_ops.convert_numeric(df, self.column_id, self.target_type, None if self.learned is None else self.learned[0])

    def row_counts(self, df):
        cell, dtype = _col(self.column_id), dtype_of(df, self.column_id)
        number = numbers.numeric_value(cell, dtype)
        done = cell_ops.has_target_type(df, self.column_id, self.target_type)
        changed = F.lit(0) if done else number.isNotNull().cast("int")
        return changed, (~text.is_missing(cell, dtype) & number.isNull()).cast("int")

    def samples(self, df):
        number = numbers.numeric_value(_col(self.column_id), dtype_of(df, self.column_id))
        shown = number.try_cast("bigint").cast("string") if self.target_type == "integer" else text.render_double(number)
        return (
            df.where(number.isNotNull())
            .orderBy(ROW_NO)
            .limit(SAMPLES)
            .select(
                (F.col(ROW_NO) + FIRST_ROW_NUMBER).alias("row_number"),
                F.create_map(F.lit(self.column_id), _col(self.column_id).cast("string")).alias("before"),
                F.create_map(F.lit(self.column_id), shown).alias("after"),
            )
        )


@dataclass(frozen=True)
class DropEmptyColumns(Action):
    """CL-16."""

    kind: ClassVar[str] = "drop_empty_columns"
    unit: ClassVar[str] = "columns"
    risk: ClassVar[str] = "high"
    column_ids: tuple[str, ...] = ()
    learned: Learned = _learned()

    def columns(self, df):
        return list(self.column_ids)

    def resolved(self, df):
        if self.learned is None:
            column_ops.drop_empty_columns(df, list(self.column_ids))  # proves that they are empty
        return replace(self, learned=(True,))

    def apply(self, df):
        return column_ops.drop_empty_columns(df, list(self.column_ids), proved=self.learned is not None)

    def metrics(self, df):
        return _constant_metrics(self, df, len(self.column_ids))

    def samples(self, df):
        headers = display_names(df)
        row = (None, {c: headers[c] for c in self.column_ids}, {})
        return df.sparkSession.createDataFrame([row], "row_number bigint, before map<string,string>, after map<string,string>")


@dataclass(frozen=True)
class StandardizeDate(Action):
    """CL-6; the affected count is the number of recognised dates."""

    kind: ClassVar[str] = "standardize_date"
    risk: ClassVar[str] = "high"
    column_id: str = ""
    date_order: str = "day_first"
    output_format: str = "YYYY-MM-DD"

    def columns(self, df):
        return [self.column_id]

    @property
    def day_first(self) -> bool:
        return self.date_order == "day_first"

    def cells(self, df):
        return cell_ops.free_dates(df, self.column_id, self.day_first, self.output_format)

    def row_counts(self, df):
        cell = _col(self.column_id).cast("string")
        read = dates.parse_free_date(cell, self.day_first).isNotNull()
        return read.cast("int"), (~text.is_blank(cell) & ~read).cast("int")


# --- Actions of rule packs ----------------------------------------------------------------


@dataclass(frozen=True)
class StripColumns(Action):
    """CL-2."""

    kind: ClassVar[str] = "strip_whitespace"
    column: str | None = None

    def columns(self, df):
        return [self.column] if self.column else text_columns(df)

    def cells(self, df):
        return cell_ops.trimmed(df, self.columns(df))


@dataclass(frozen=True)
class NormalizeCase(Action):
    """CL-3."""

    kind: ClassVar[str] = "normalize_case"
    mode: str = "lower"
    column: str | None = None

    def columns(self, df):
        return [self.column] if self.column else text_columns(df)

    def cells(self, df):
        return cell_ops.cased(df, self.mode, self.columns(df))


@dataclass(frozen=True)
class ReplaceValues(Action):
    """CL-4."""

    kind: ClassVar[str] = "replace_values"
    column: str = ""
    mapping: Mapping[str, str] = field(default_factory=dict)

    def columns(self, df):
        return [self.column]

    def cells(self, df):
        return cell_ops.replaced(df, self.column, self.mapping)


@dataclass(frozen=True)
class CanonicalDates(Action):
    """CL-5."""

    kind: ClassVar[str] = "standardize_date"
    date_columns: Mapping[str, bool] = field(default_factory=dict)

    def columns(self, df):
        return list(self.date_columns)

    def cells(self, df):
        return cell_ops.canonical_dates(df, self.date_columns)


@dataclass(frozen=True)
class FillValue(Action):
    """CL-7, one value into one or several columns."""

    kind: ClassVar[str] = "fill_missing"
    unit: ClassVar[str] = "cells"
    risk: ClassVar[str] = "medium"
    fill_columns: tuple[str, ...] = ()
    value: str = ""

    def columns(self, df):
        return list(self.fill_columns)

    def cells(self, df):
        return cell_ops.filled(df, list(self.fill_columns), self.value)


@dataclass(frozen=True)
class FillForward(Action):
    """CL-11."""

    kind: ClassVar[str] = "fill_forward"
    unit: ClassVar[str] = "cells"
    risk: ClassVar[str] = "medium"
    fill_columns: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    def columns(self, df):
        return list(self.fill_columns)

    def apply(self, df):
        return fills.fill_forward(df, list(self.fill_columns), list(self.partition_by))

    def metrics(self, df):
        """Filled cells are the missing ones that are missing no more."""

        def gaps(t: DataFrame) -> Column:
            return _add([text.is_missing(_col(c), dtype_of(t, c)).cast("int") for c in self.fill_columns])

        after = self.apply(df)
        left = after.agg(
            F.coalesce(F.sum(gaps(after)), F.lit(0)).alias("n"), F.count_if(gaps(after) > 0).alias("r")
        ).select(F.struct("n", "r")).scalar()
        counted = df.agg(
            F.coalesce(F.sum(gaps(df)), F.lit(0)).alias("n"), F.count_if(gaps(df) > 0).alias("r")
        ).select("n", "r", left.alias("after"))
        affected = F.col("n") - F.col("after.n")
        return counted.select(
            self.metrics_struct(df, affected, F.lit(0), affected if len(self.fill_columns) == 1 else F.col("r") - F.col("after.r")).alias("m")
        ).select("m.*")


@dataclass(frozen=True)
class CastColumn(Action):
    """CL-12; strict: a cell that cannot be cast stops the job."""

    kind: ClassVar[str] = "cast_dtype"
    risk: ClassVar[str] = "medium"
    column: str = ""
    dtype: str = "float"
    strict: bool = True

    def columns(self, df):
        return [self.column]

    def cells(self, df):
        cast = cell_ops.strict_cast_cells if self.strict else cell_ops.cast_cells
        return cast(df, self.column, self.dtype)

    def row_counts(self, df):
        cell = _col(self.column).cast("string")
        new = cell_ops.cast_cells(df, self.column, self.dtype)[self.column]
        same = self.dtype == "string" and not cell_ops.is_number(df, self.column)
        changed = ~cell.eqNullSafe(new) if same else cell.isNotNull()
        return changed.cast("int"), (~text.is_blank(cell) & new.isNull()).cast("int")


@dataclass(frozen=True)
class KeepBest(Action):
    """CL-18."""

    kind: ClassVar[str] = "drop_duplicates"
    unit: ClassVar[str] = "rows"
    risk: ClassVar[str] = "high"
    key_fields: tuple[str, ...] = ()
    completeness_fields: tuple[str, ...] = ()
    latest_timestamp_field: str | None = None

    def columns(self, df):
        return list(self.key_fields)

    def apply(self, df):
        return rows.keep_best(df, list(self.key_fields), list(self.completeness_fields), self.latest_timestamp_field)

    def metrics(self, df):
        n = F.col("duplicate_count")
        return rows.duplicate_key_count(df, list(self.key_fields)).select(
            self.metrics_struct(df, n, F.lit(0), n).alias("m")
        ).select("m.*")


@dataclass(frozen=True)
class SortRows(Action):
    """CL-19."""

    kind: ClassVar[str] = "sort_rows"
    unit: ClassVar[str] = "rows"
    sort_by: tuple[str, ...] = ()
    ascending: bool = True

    def columns(self, df):
        return list(self.sort_by)

    def apply(self, df):
        return rows.sort_rows(df, list(self.sort_by), self.ascending)

    def metrics(self, df):
        return _constant_metrics(self, df, 0)


@dataclass(frozen=True)
class RenameField(Action):
    """CL-14."""

    kind: ClassVar[str] = "rename_column"
    unit: ClassVar[str] = "column"
    risk: ClassVar[str] = "high"
    source: str = ""
    target: str = ""

    def columns(self, df):
        return [self.source]

    def apply(self, df):
        return column_ops.rename_column(df, self.source, self.target)

    def metrics(self, df):
        return _constant_metrics(self, df, 1)


# --- Running actions ----------------------------------------------------------------------


def preview_change(df: DataFrame, action: Action) -> DataFrame:
    """CM-7 numbers without changing anything: the metrics row plus a warning text."""
    note = F.concat(F.col("unresolved_count").cast("string"), F.lit(" values could not be read and stay as they are."))
    return action.metrics(df).withColumn("warning", F.when(F.col("unresolved_count") > 0, note))


def run_action(df: DataFrame, action: Action) -> DataFrame:
    """Apply with the strict rule: nothing to change is an error."""
    if not action.metrics(df).first()["affected_count"]:
        raise not_applicable(f"Nothing to change: {action.summary()}.")
    return action.apply(df)


def apply_plan(df: DataFrame, plan: list[Action] | tuple[Action, ...]) -> DataFrame:
    """GV-6: fold the actions over the untouched source; lazily, with no snapshots."""
    return reduce(lambda table, action: action.apply(table), plan, df)
