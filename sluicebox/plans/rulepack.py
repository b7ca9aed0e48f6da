"""Declarative rule packs: the plan they compile to, the checks they run, the issues they see."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..operators.compare import graded, match_ratio
from ..operators.profile import inspect_column, table_summary
from ..operators.rows import counted_by_key, duplicate_key_count
from ..table import data_columns, dtype_of, text_columns
from .actions import (
    Action,
    CanonicalDates,
    CastColumn,
    FillForward,
    FillValue,
    KeepBest,
    NormalizeCase,
    RenameField,
    ReplaceValues,
    StripColumns,
    apply_plan,
)

CHECK_SCHEMA = "check_id string, description string, status string, severity string, detail string, failed_count bigint"


@dataclass(frozen=True)
class DuplicateRule:
    key_fields: tuple[str, ...]
    completeness_fields: tuple[str, ...]
    latest_timestamp_field: str | None = None


@dataclass(frozen=True)
class RulePack:
    """What a clean table of one source system looks like."""

    name: str
    source_system: str
    expected_columns: tuple[str, ...]
    required_columns: tuple[str, ...]
    primary_key: tuple[str, ...]
    date_columns: Mapping[str, bool] = field(default_factory=dict)
    rename_map: Mapping[str, str] = field(default_factory=dict)
    value_maps: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    fill_defaults: Mapping[str, str] = field(default_factory=dict)
    fill_forward_columns: tuple[str, ...] = ()
    cast_columns: Mapping[str, str] = field(default_factory=dict)
    case_columns: Mapping[str, str] = field(default_factory=dict)
    validation_rules: Mapping[str, str] = field(default_factory=dict)
    grade_columns: tuple[str, ...] = ()
    sort_columns: tuple[str, ...] = ()
    sort_for_grading: bool = True
    export_destination: str = "cleaned_table"
    duplicate_rule: DuplicateRule | None = None

    @property
    def graded_columns(self) -> tuple[str, ...]:
        return self.grade_columns or self.expected_columns

    @property
    def key_fields(self) -> tuple[str, ...]:
        return self.duplicate_rule.key_fields if self.duplicate_rule else ()

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(payload: str) -> RulePack:
        raw = json.loads(payload)
        rule = raw.pop("duplicate_rule", None)
        cooked = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
        if rule:
            rule = DuplicateRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in rule.items()})
        return RulePack(**cooked, duplicate_rule=rule)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def compile_pack(pack: RulePack, columns: Sequence[str]) -> list[Action]:
    """GV-5 as a list of actions for a table with these columns.

    A step whose input is already clean changes no value, so only renaming looks at the
    schema; everything else is simply part of the one lazy plan.
    """
    names = list(columns)
    steps: list[Action] = []
    if names != list(pack.expected_columns):
        for source, target in pack.rename_map.items():
            if source in names and target not in names:
                steps.append(RenameField(source, target))
                names[names.index(source)] = target
    held = set(names)
    steps.append(StripColumns())
    steps += [NormalizeCase(mode, c) for c, mode in pack.case_columns.items() if c in held]
    steps += [ReplaceValues(c, dict(m)) for c, m in pack.value_maps.items() if c in held]
    dated = {c: with_time for c, with_time in pack.date_columns.items() if c in held}
    if dated:
        steps.append(CanonicalDates(dated))
    fills = {c: v for c, v in pack.fill_defaults.items() if c in held}
    if len(fills) > 1 and len(set(fills.values())) == 1:
        steps.append(FillValue(tuple(fills), next(iter(fills.values()))))
    else:
        steps += [FillValue((c,), v) for c, v in fills.items()]
    steps += [FillForward((c,)) for c in pack.fill_forward_columns if c in held]
    steps += [CastColumn(c, dtype) for c, dtype in pack.cast_columns.items() if c in held]
    if pack.duplicate_rule:
        rule = pack.duplicate_rule
        steps.append(KeepBest(rule.key_fields, rule.completeness_fields, rule.latest_timestamp_field))
    return steps


def clean(df: DataFrame, pack: RulePack) -> DataFrame:
    """GV-5: the whole cleaning pipeline of a pack as one lazy DataFrame."""
    return apply_plan(df, compile_pack(pack, data_columns(df)))


def grade(df: DataFrame, expected: DataFrame, pack: RulePack) -> DataFrame:
    """CM-2 with the pack's columns and keys, plus the clamped score (CM-8)."""
    keys = list(pack.sort_columns or pack.primary_key or pack.graded_columns) if pack.sort_for_grading else None
    return graded(match_ratio(df, expected, list(pack.graded_columns), keys, list(pack.cast_columns)))


# --- Checks (VA-1..10) --------------------------------------------------------------------


def _not_canonical(c: Column, with_time: bool) -> Column:
    canonical = dates.canonical_date(c, with_time)
    return ~text.is_blank(c) & (canonical.isNull() | (c != canonical))


def _bad_number(df: DataFrame, column: str) -> Column:
    """Failing cells of a number column: every row unless the column is number-typed."""
    if column not in df.columns or not isinstance(dtype_of(df, column), T.NumericType):
        return F.count("*")
    return F.count_if(_col(column).isNull() | (_col(column) < 0))


def _check_count(df: DataFrame, pack: RulePack, rule: str, subject: str | None) -> tuple[Column, str] | None:
    """Failing cells of a rule as an aggregate and what is wrong with them; None for an unknown rule."""
    held = set(df.columns)
    total = F.lit(0).cast("bigint")
    if rule == "required_fields_present":
        for c in pack.required_columns:
            if c in held:
                total = total + F.count_if(text.is_missing(_col(c), dtype_of(df, c)))
        return total, "required cells are missing"
    if rule in ("dates_canonical", "timestamps_canonical"):
        for c, with_time in pack.date_columns.items():
            if c in held:
                total = total + F.count_if(_not_canonical(_col(c).cast("string"), with_time))
        return total, "dates are not canonical"
    if rule == "emails_valid":
        c = subject or "email"
        return (F.count_if(~text.looks_like_email(_col(c))) if c in held else F.count("*")), "emails are invalid"
    if rule == "amounts_numeric_non_negative":
        return _bad_number(df, subject or "amount"), "amounts are invalid"
    if rule in ("technician_assignments_valid", "populated"):
        c = subject or "technician"
        return (F.count_if(text.is_missing(_col(c), dtype_of(df, c))) if c in held else F.count("*")), "cells are blank"
    if rule == "cast_columns_numeric_non_negative":
        for c, dtype in pack.cast_columns.items():
            if dtype in ("float", "int") and c in held:
                total = total + _bad_number(df, c)
        return total, "number cells are invalid"
    return None


def run_checks(df: DataFrame, pack: RulePack) -> DataFrame:
    """VA-1..9: one row per rule; all counters come from one pass, grouped by key first where a rule counts repeated keys.

    A rule id may carry a column, as in ``emails_valid:contact_email``.
    """
    by_key = "duplicates_resolved" in {r.partition(":")[0] for r in pack.validation_rules} and bool(pack.key_fields)
    counters: dict[str, Column] = {}
    entries: list[Column] = []
    for i, (rule_id, description) in enumerate(pack.validation_rules.items()):
        rule, _, subject = rule_id.partition(":")
        name = f"n{i}"
        if rule == "duplicates_resolved":
            failed = F.col("repeats") if by_key else F.lit(0)
            problem, severity = "duplicate rows remain", "error"
        elif rule == "schema_matches":
            failed = F.lit(int(data_columns(df) != list(pack.expected_columns)))
            problem, severity = "schema difference found", "error"
        elif (found := _check_count(df, pack, rule, subject or None)) is not None:
            counters[name] = found[0]
            failed, problem, severity = F.col(name), found[1], "error"
        else:
            failed, problem, severity = F.lit(0), "", "info"
        good = "Passed." if severity == "error" else "Unknown rule; treated as passed."
        entries.append(
            F.struct(
                F.lit(rule_id).alias("check_id"),
                F.lit(description).alias("description"),
                F.when(failed == 0, "passed").otherwise("failed").alias("status"),
                F.lit(severity).alias("severity"),
                F.when(failed == 0, F.lit(good)).otherwise(F.concat(failed.cast("string"), F.lit(f" {problem}."))).alias("detail"),
                failed.cast("bigint").alias("failed_count"),
            )
        )
    if by_key:
        base = counted_by_key(df, list(pack.key_fields), counters)
    else:
        base = df.agg(*[c.alias(n) for n, c in counters.items()], F.count("*").alias("rows"))
    return base.select(F.inline(F.array(*entries)))


def rollup(checks: DataFrame) -> DataFrame:
    """VA-10: one row; passed only when every check passed."""
    ok = F.coalesce(F.bool_and(F.col("status") == "passed"), F.lit(True))
    return checks.agg(
        F.when(ok, "passed").otherwise("failed").alias("validation_status"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        ok.alias("export_ready"),
    )


# --- Issues and suggestions (PR-13, PR-14, GV-4) -------------------------------------------


def _padded_columns(df: DataFrame) -> list[tuple[str, Column]]:
    return [(c, F.count_if(text.is_padded(_col(c)))) for c in text_columns(df)]


def _unmapped(df: DataFrame, column: str, mapping: Mapping[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    wanted = F.try_element_at(lookup, text.fold_key(_col(column)))
    return F.count_if(wanted.isNotNull() & (wanted != _col(column)))


def issues_summary(df: DataFrame, pack: RulePack) -> DataFrame:
    """PR-14: what still has to be cleaned, in order; one fused aggregate plus one key grouping."""
    held = set(df.columns)
    padded = _padded_columns(df)
    dated = sorted((c, t) for c, t in pack.date_columns.items() if c in held)
    mapped = [(c, m) for c, m in pack.value_maps.items() if c in held and c in text_columns(df)]
    missing = F.lit(0).cast("bigint")
    for c in pack.required_columns:
        if c in held:
            missing = missing + F.count_if(text.is_missing(_col(c), dtype_of(df, c)))
    base = df.agg(
        missing.alias("missing"),
        *[e.alias(f"p{i}") for i, (_, e) in enumerate(padded)],
        *[F.count_if(_not_canonical(_col(c).cast("string"), t)).alias(f"d{i}") for i, (c, t) in enumerate(dated)],
        *[_unmapped(df, c, m).alias(f"m{i}") for i, (c, m) in enumerate(mapped)],
    )

    def named(prefix: str, names: Sequence[str]) -> Column:
        flags = [F.when(F.col(f"{prefix}{i}") > 0, F.lit(c)) for i, c in enumerate(names)]
        return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")

    repeats = duplicate_key_count(df, list(pack.key_fields)).scalar() if pack.key_fields else F.lit(0)
    pads, bad_dates, unmapped = named("p", [c for c, _ in padded]), named("d", [c for c, _ in dated]), named("m", [c for c, _ in mapped])
    lines = F.array(
        F.when(F.lit(data_columns(df) != list(pack.expected_columns)), F.lit("schema: columns differ from the expected ones")),
        F.when(F.size(pads) > 0, F.concat(F.lit("whitespace: "), F.array_join(F.slice(pads, 1, 3), ", "))),
        F.when(F.col("missing") > 0, F.concat(F.lit("required: "), F.col("missing").cast("string"), F.lit(" cells missing"))),
        F.when(repeats > 0, F.lit("duplicates: business keys repeat")),
        F.when(F.size(bad_dates) > 0, F.concat(F.lit("dates: "), F.array_join(bad_dates, ", "))),
        F.when(F.size(unmapped) > 0, F.concat(F.lit("values: "), F.element_at(unmapped, 1))),
    )
    return base.select(F.posexplode(lines).alias("position", "issue")).where("issue IS NOT NULL")


def suggest_pack_steps(df: DataFrame, pack: RulePack) -> DataFrame:
    """GV-4: the steps worth running, split into safe and risky."""
    held = set(df.columns)
    names = data_columns(df)
    padded = F.lit(0)
    for _, e in _padded_columns(df):
        padded = padded + e
    gaps = [(c, F.count_if(text.is_missing(_col(c), dtype_of(df, c)))) for c in pack.fill_forward_columns if c in held]
    base = df.agg(padded.cast("bigint").alias("padded"), *[e.alias(f"g{i}") for i, (_, e) in enumerate(gaps)])
    repeats = duplicate_key_count(df, list(pack.key_fields)).scalar() if pack.key_fields else F.lit(0)
    drifts = names != list(pack.expected_columns) and any(
        s in held and t not in held for s, t in pack.rename_map.items()
    )

    def step(wanted: Column | bool, group: str, label: str) -> Column:
        test = F.lit(wanted) if isinstance(wanted, bool) else wanted
        return F.when(test, F.struct(F.lit(group).alias("group"), F.lit(label).alias("step")))

    steps = [
        step(F.col("padded") > 0, "safe", "strip_whitespace"),
        *[step(c in held, "safe", f"normalize_case:{c}") for c in pack.case_columns],
        *[step(c in held, "safe", f"replace_values:{c}") for c in pack.value_maps],
        step(bool(pack.date_columns), "safe", "standardize_date"),
        step(drifts, "risky", "rename_column"),
        *[step(c in held, "risky", f"fill_missing:{c}") for c in pack.fill_defaults],
        *[step(F.col(f"g{i}") > 0, "risky", f"fill_forward:{c}") for i, (c, _) in enumerate(gaps)],
        *[step(c in held, "risky", f"cast_dtype:{c}") for c in pack.cast_columns],
        step(repeats > 0, "risky", "drop_duplicates"),
    ]
    return base.select(F.posexplode(F.array(*steps)).alias("position", "s")).where("s IS NOT NULL").select("position", "s.group", "s.step")


def profile_pack(df: DataFrame, pack: RulePack) -> DataFrame:
    """PR-13: one row with the counts, the first four issues, suggested steps and the rules."""
    issues = issues_summary(df, pack).where("position < 6").agg(F.array_sort(F.collect_list(F.struct("position", "issue"))).alias("a"))
    steps = suggest_pack_steps(df, pack).agg(F.array_sort(F.collect_list(F.struct("position", "group", "step"))).alias("a"))

    def of(group: str) -> Column:
        return F.transform(F.filter(F.col("steps"), lambda s: s["group"] == group), lambda s: s["step"])

    rules = [F.struct(F.lit(k).alias("check_id"), F.lit(v).alias("description")) for k, v in pack.validation_rules.items()]
    return table_summary(df, list(pack.required_columns), list(pack.key_fields)).select(
        F.lit(pack.source_system).alias("source_system"),
        F.lit(pack.name).alias("rule_pack"),
        "row_count", "column_count",
        issues.scalar().alias("issues"),
        steps.scalar().alias("steps"),
    ).select(
        "source_system", "rule_pack", "row_count", "column_count",
        F.slice(F.transform("issues", lambda x: x["issue"]), 1, 4).alias("issues_summary"),
        of("safe").alias("safe_steps"), of("risky").alias("risky_steps"),
        F.array(*rules).alias("validation_rules"),
    )


def inspect_pack_column(df: DataFrame, pack: RulePack, column: str) -> DataFrame:
    """PR-12 with what the pack says about the column."""
    hints = pack.value_maps.get(column, {})
    pairs = [F.lit(x) for pair in hints.items() for x in pair]
    return inspect_column(df, column).select(
        "*",
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("value_map"),
        F.lit(pack.fill_defaults.get(column)).cast("string").alias("recommended_fill"),
        F.lit(pack.case_columns.get(column)).cast("string").alias("recommended_case"),
        F.lit(pack.cast_columns.get(column)).cast("string").alias("expected_dtype"),
        F.lit(column in pack.date_columns).alias("canonical_datetime"),
    )
