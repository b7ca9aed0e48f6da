"""GV-3: turn detected issues into typed actions, by one rule for each type of issue."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.headers import clean_header, fold_header
from ..operators.profile import Profile
from .actions import (
    Action,
    ConvertNumeric,
    DropDuplicates,
    DropEmptyColumns,
    FillMissing,
    RenameColumn,
    StandardizeDate,
    TrimWhitespace,
)

SUGGESTION_SCHEMA = (
    "suggestion_id string, issue_type string, confidence string, action_type string, action string, title string, rationale string"
)


@dataclass(frozen=True)
class Suggestion:
    issue_type: str
    action: Action
    confidence: str
    title: str
    rationale: str

    @property
    def action_json(self) -> str:
        return json.dumps(self.action.to_dict(), sort_keys=True)

    @property
    def suggestion_id(self) -> str:
        """A digest of what is suggested, equal wherever the same is suggested."""
        return hashlib.sha256(f"{self.issue_type}\n{self.action_json}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Rule:
    """How an issue type is answered: the actions for its columns, and what a reader is told."""

    actions: Callable[[Profile, list[str]], Iterator[Action]]
    confidence: str
    title: str
    rationale: str


def _fill(profile: Profile, columns: list[str]) -> Iterator[Action]:
    held = [(c, profile.inferred[c]) for c in columns if profile.inferred[c] != "empty"]
    for column, kind in held[:1]:
        yield FillMissing(column, "median" if kind in ("integer", "decimal") else "most_common")


def _rename(profile: Profile, columns: list[str]) -> Iterator[Action]:
    """The first header whose clean form differs; other headers' names are taken."""
    names = list(profile.headers)
    for c in columns:
        own = fold_header(profile.headers[c])
        taken = {fold_header(h) for h in profile.headers.values()} - {own, ""}
        new = clean_header(profile.headers[c], names.index(c), taken)
        if new != profile.headers[c]:
            yield RenameColumn(c, new)
            return


RULES = {
    "whitespace": Rule(lambda p, c: iter([TrimWhitespace(tuple(c))]), "high", "Trim white space", "Padding makes equal values differ."),
    "duplicate_rows": Rule(lambda p, c: iter([DropDuplicates("first")]), "high", "Drop repeated rows", "Whole rows occur more than once; the first of each stays."),
    "numeric_text": Rule(lambda p, c: (ConvertNumeric(x, "decimal") for x in c), "high", "Convert to numbers", "Every present cell reads as a number."),
    "empty_columns": Rule(lambda p, c: iter([DropEmptyColumns(tuple(c))]), "high", "Drop empty columns", "No row has a value there."),
    "inconsistent_dates": Rule(lambda p, c: iter([StandardizeDate(c[0])]), "medium", "Use one date layout", "Dates of one column are written in several layouts."),
    "missing_values": Rule(_fill, "medium", "Fill missing cells", "The median suits numbers, the most common value suits text."),
    "messy_column_names": Rule(_rename, "medium", "Rename the column", "Its name is blank, padded, repeated or unreadable."),
}


def suggest(profile: Profile) -> list[Suggestion]:
    """What the rules answer to the profile's issues, from its counters alone: no further pass over the data."""
    return [
        Suggestion(kind, action, rule.confidence, rule.title, rule.rationale)
        for kind, *_, columns, _ in profile.issue_rows()
        if (rule := RULES.get(kind))
        for action in rule.actions(profile, list(columns))
    ]


def suggestions(profile: Profile) -> DataFrame:
    rows = [(s.suggestion_id, s.issue_type, s.confidence, s.action.kind, s.action_json, s.title, s.rationale) for s in suggest(profile)]
    return profile.source.sparkSession.createDataFrame(rows, SUGGESTION_SCHEMA)
