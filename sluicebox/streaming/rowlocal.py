"""The row-local actions on a streaming DataFrame: the same expressions, no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import invalid_action
from ..plans.actions import (
    Action,
    CanonicalDates,
    CastColumn,
    FillMissing,
    FillValue,
    NormalizeCase,
    RenameColumn,
    RenameField,
    ReplaceValues,
    StandardizeDate,
    StripColumns,
    TrimWhitespace,
    apply_plan,
)

_STATELESS = (
    TrimWhitespace, StripColumns, NormalizeCase, ReplaceValues, CanonicalDates, StandardizeDate, FillValue, CastColumn,
    RenameColumn, RenameField,
)


def clean_stream(stream: DataFrame, actions: Sequence[Action]) -> DataFrame:
    """Apply row-local actions to a stream; anything that needs other rows is refused."""
    for action in actions:
        explicit_fill = isinstance(action, FillMissing) and action.strategy == "explicit"
        if not isinstance(action, _STATELESS) and not explicit_fill:
            raise invalid_action(f"{action.kind} looks at other rows and cannot run on a stream.")
    return apply_plan(stream, list(actions))
