"""Replayable plans and their audit table (GV-6, GV-8)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import not_applicable
from ..operators.compare import change_footprint
from ..operators.profile import table_summary
from ..table import replace_columns
from .actions import Action, apply_plan

AUDIT_LIMIT = 200


@dataclass(frozen=True)
class TablePlan:
    """A source table and the actions on it. Every change is a new plan with a higher revision."""

    source: DataFrame
    actions: tuple[Action, ...] = ()
    revision: int = 1

    def current(self) -> DataFrame:
        return apply_plan(self.source, self.actions)

    def at(self, steps: int) -> DataFrame:
        return apply_plan(self.source, self.actions[:steps])

    def add(self, action: Action) -> TablePlan:
        """A plan with one more step. What the step must learn from the data is learned here, once: replays and audits
        build their tables without running a job."""
        return TablePlan(self.source, (*self.actions, action.resolved(self.current())), self.revision + 1)

    def undo(self) -> TablePlan:
        if not self.actions:
            raise not_applicable("No step to undo.")
        return TablePlan(self.source, self.actions[:-1], self.revision + 1)

    def reset(self) -> TablePlan:
        if not self.actions:
            raise not_applicable("The table is untouched already.")
        return TablePlan(self.source, (), self.revision + 1)

    def metrics(self) -> DataFrame:
        return plan_metrics(self.source, self.actions)

    def audit(self, applied_at: datetime | None = None) -> DataFrame:
        return audit_rows(self.metrics(), applied_at)


def plan_metrics(df: DataFrame, plan: tuple[Action, ...] | list[Action]) -> DataFrame:
    """One metrics row per step.

    Consecutive row-local steps are measured together: each adds its per-row counts to the
    projection and one aggregate sums them all, so a chain of them costs one scan.
    """
    table = df
    parts: list[DataFrame] = []
    open_steps: list[tuple[int, Action, DataFrame]] = []

    def flush() -> None:
        nonlocal table
        if not open_steps:
            return
        sums = []
        for i, _, _ in open_steps:
            sums += [
                F.coalesce(F.sum(f"__a{i}"), F.lit(0)).alias(f"a{i}"),
                F.coalesce(F.sum(f"__u{i}"), F.lit(0)).alias(f"u{i}"),
                F.count_if(F.col(f"__a{i}") > 0).alias(f"r{i}"),
            ]
        entries = [
            F.struct(F.lit(i).alias("step"), action.metrics_struct(at, F.col(f"a{i}"), F.col(f"u{i}"), F.col(f"r{i}")).alias("m"))
            for i, action, at in open_steps
        ]
        parts.append(table.agg(*sums).select(F.inline(F.array(*entries))).select("step", "m.*"))
        table = table.drop(*[name for i, _, _ in open_steps for name in (f"__a{i}", f"__u{i}")])
        open_steps.clear()

    for i, action in enumerate(plan):
        new = action.cells(table)
        if new is None:
            flush()
            parts.append(action.metrics(table).select(F.lit(i).alias("step"), "*"))
            table = action.apply(table)
        else:
            affected, unresolved = action.row_counts(table)
            open_steps.append((i, action, table))
            table = replace_columns(table.withColumns({f"__a{i}": affected, f"__u{i}": unresolved}), new)
    flush()
    return reduce(DataFrame.unionByName, parts)


def audit_rows(metrics: DataFrame, applied_at: datetime | None = None, status: str = "applied", first_revision: int = 2) -> DataFrame:
    """GV-8: audit entries from metrics rows."""
    when = applied_at or datetime.now(timezone.utc)
    return metrics.select(
        F.concat(F.lit("chg-"), F.lpad((F.col("step") + 1).cast("string"), 3, "0")).alias("change_id"),
        "action_type", "summary", "risk", F.lit(status).alias("status"),
        "affected_count", "affected_unit", "column_ids",
        F.lit(when).cast("timestamp").alias("timestamp"),
        (F.col("step") + first_revision).cast("int").alias("revision"),
    )


def append_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").parquet(path)


def latest_audit(audit: DataFrame, limit: int = AUDIT_LIMIT) -> DataFrame:
    """Retention: the newest entries; a top-k, never a full sort."""
    return audit.orderBy(F.col("timestamp").desc(), F.col("revision").desc()).limit(limit)


def step_reports(df: DataFrame, plan: tuple[Action, ...] | list[Action], required: list[str], keys: list[str]) -> DataFrame:
    """Rule-pack audit: per step the table summary before and after, and the change footprint.

    Rows pair by source row number, which every step keeps, so no step needs a sort.
    """
    reports = []
    table = df
    for i, action in enumerate(plan):
        after = action.apply(table)
        before_summary = table_summary(table, required, keys).select(F.struct("*")).scalar()
        after_summary = table_summary(after, required, keys).select(F.struct("*")).scalar()
        reports.append(
            change_footprint(table, after, by_row=True).select(
                F.lit(i).alias("step"),
                F.lit(action.kind).alias("action_type"),
                F.lit(action.risk).alias("risk"),
                F.col("row_count").alias("affected_row_count"),
                F.col("columns").alias("affected_columns"),
                before_summary.alias("before_summary"),
                after_summary.alias("after_summary"),
            )
        )
        table = after
    return reduce(DataFrame.unionByName, reports)
