"""Checks of an uploaded table (VA-11..15), read off its profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..errors import TableError
from .profile import EXAMPLES, Profile

CHECK_SCHEMA = (
    "check_id string, title string, status string, severity string, message string, affected_count bigint, "
    "affected_columns array<string>, example_rows array<bigint>"
)


@dataclass(frozen=True)
class Validation:
    """The outcome for one revision of a table."""

    source: DataFrame
    revision: int
    required: tuple[str, ...]
    rows: tuple[tuple, ...]
    ran_at: datetime

    @property
    def status(self) -> str:
        return "failed" if any(r[2] == "failed" and r[3] == "error" for r in self.rows) else "passed"

    def checks(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(list(self.rows), CHECK_SCHEMA)

    def rollup(self) -> DataFrame:
        """VA-15: one row."""
        errors = sum(r[2] == "failed" and r[3] == "error" for r in self.rows)
        warnings = sum(r[2] == "warning" for r in self.rows)
        passed = sum(r[2] == "passed" for r in self.rows)
        row = (self.status, self.revision, list(self.required), self.ran_at, errors, warnings, passed)
        return self.source.sparkSession.createDataFrame(
            [row],
            "status string, revision int, required_columns array<string>, ran_at timestamp, "
            "errors bigint, warnings bigint, passed bigint",
        )


def _distinct(items) -> list:
    return list(dict.fromkeys(items))


def validate_table(profile: Profile, required: Sequence[str] = (), revision: int = 1, ran_at: datetime | None = None) -> Validation:
    """Required columns are errors; remaining issues and formula-like text are warnings."""
    wanted = _distinct(required)
    unknown = [c for c in wanted if c not in profile.headers]
    if unknown:
        raise TableError("unknown_column", f"Required column not in the table: {', '.join(unknown)}")

    short = [c for c in wanted if profile.missing(c)]
    blank = sum(profile.missing(c) for c in short)
    rows = [
        ("required_columns", "Required columns", "failed", "error", f"{blank} required cells are blank.", blank, short,
         profile.example_rows("missing", short))
        if blank
        else ("required_columns", "Required columns", "passed", "info", "No required cell is blank.", 0, wanted, [])
    ]
    issues = profile.issue_rows()
    rows.append(
        ("remaining_issues", "Remaining issues", "warning", "warning", f"{len(issues)} kinds of issue remain.", len(issues),
         _distinct(c for i in issues for c in i[5]), _distinct(r for i in issues for r in i[6])[:EXAMPLES])
        if issues
        else ("remaining_issues", "Remaining issues", "passed", "info", "No issue remains.", 0, [], [])
    )
    n = profile.formula_count
    rows.append(
        ("download_warnings", "Download warnings", "warning", "warning", f"{n} cells may run as a formula.", n, [], [])
        if n
        else ("download_warnings", "Download warnings", "passed", "info", "No cell may run as a formula.", 0, [], [])
    )
    return Validation(profile.source, revision, tuple(wanted), tuple(rows), ran_at or datetime.now(timezone.utc))
