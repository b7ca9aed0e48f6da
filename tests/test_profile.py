import pytest
from pyspark.sql import functions as F

from sluicebox.errors import TableError
from sluicebox.operators import profile as P
from sluicebox.operators.validate import validate_table
from sluicebox.plans import actions as A
from sluicebox.plans.suggest import suggest, suggestions
from sluicebox.table import ROW_NO


def issues(profile):
    return {r["type"]: r for r in profile.issues().collect()}


def test_types(table):
    t = table(
        ["e", "i", "d", "b", "day", "ts", "t", "m"],
        [
            ("", "1", "1.5", "yes", "2024-01-01", "2024-01-01", "abc", "1"),
            (None, "$2,000", "2%", "No", "31/12/2024", "2024-01-01T10:00", "x", "z"),
        ],
    )
    assert list(P.profile_table(t).inferred.values()) == ["empty", "integer", "decimal", "boolean", "date", "datetime", "text", "mixed"]


def test_all_issues(table):
    t = table(
        ["", "Name", " name", "amount", "start date", "gap"],
        [("a", " x", "k", "$1,200", "2024-01-05", ""), ("b", "y", "k", "30.5", "01/06/2024", None),
         ("a", " x", "k", "$1,200", "2024-01-05", ""), (None, "z ", "", "7", "05-06-2024", " ")],
    )
    p = P.profile_table(t)
    got = issues(p)
    assert list(got) == [
        "missing_values", "duplicate_rows", "whitespace", "messy_column_names", "numeric_text", "empty_columns", "inconsistent_dates",
    ]
    assert got["missing_values"]["affected_count"] == 6
    assert got["missing_values"]["affected_columns"] == ["column_1", "column_3", "column_6"]
    assert got["missing_values"]["example_rows"] == [5, 2, 3, 4]
    assert (got["duplicate_rows"]["affected_count"], got["duplicate_rows"]["example_rows"]) == (1, [4])
    assert got["whitespace"]["affected_columns"] == ["column_2", "column_6"] and got["whitespace"]["affected_count"] == 4
    assert got["messy_column_names"]["affected_columns"] == ["column_1", "column_2", "column_3"]
    assert (got["numeric_text"]["affected_columns"], got["numeric_text"]["affected_count"]) == (["column_4"], 4)
    assert got["empty_columns"]["affected_columns"] == ["column_6"]
    assert got["inconsistent_dates"]["affected_columns"] == ["column_5"]
    kinds = [(s.issue_type, s.action.kind, s.action.columns(t)) for s in suggest(p)]
    assert kinds == [
        ("missing_values", "fill_missing", ["column_1"]), ("duplicate_rows", "drop_duplicates", []),
        ("whitespace", "trim_whitespace", ["column_2", "column_6"]), ("messy_column_names", "rename_column", ["column_1"]),
        ("numeric_text", "convert_numeric", ["column_4"]), ("empty_columns", "drop_empty_columns", ["column_6"]),
        ("inconsistent_dates", "standardize_date", ["column_5"]),
    ]
    assert suggestions(p).count() == 7
    assert next(s for s in suggest(p) if s.issue_type == "messy_column_names").action.new_name == "Column 1"


def test_numeric_negatives(table):
    t = table(["customer_id", "postal_code", "code", "quantity"], [("1", "00501", "012", "4"), ("2", "00502", "x", "5")])
    assert P.profile_table(t).numeric_text_columns() == ["column_4"]


def test_date_negative_needs_evidence(table):
    t = table(["notes"], [("2024-01-05",), ("01/06/2024",), ("see above",)])
    assert P.profile_table(t).inconsistent_date_columns() == []
    t = table(["updated"], [("2024-01-05",), ("01/06/2024",), ("see above",)])
    assert P.profile_table(t).inconsistent_date_columns() == ["column_1"]


def test_examples_come_from_the_first_blocks(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 4001 == 4000, "").otherwise("v").alias("rare"),
        F.when(F.col("id") % 2 == 0, " p").otherwise("q").alias("dense"),
        F.col("id").alias(ROW_NO),
    )
    p = P.profile_table(df, block_rows=100)
    got = issues(p)
    assert got["missing_values"]["example_rows"] == [4002, 8003, 12004, 16005]
    assert got["whitespace"]["example_rows"] == [2, 4, 6, 8, 10]
    assert P._first_blocks(P.block_counters(df, 100), [("dense", "padded")]) == [0]


def test_duplicate_examples_with_a_hot_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"), F.col("id").alias(ROW_NO))
    p = P.profile_table(df)
    assert (p.duplicate_count, p.duplicate_examples) == (999, [5, 8, 11, 14, 17])


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 1.5, True, 0), (None, float("nan"), None, 1)], f"i bigint, d double, b boolean, {ROW_NO} bigint")
    df = df.withColumn("t", F.lit(None).cast("timestamp")).withColumn("day", F.to_date(F.lit("2024-01-01")))
    p = P.profile_table(df)
    assert p.inferred == {"i": "integer", "d": "decimal", "b": "text", "t": "empty", "day": "date"}
    assert [p.missing(c) for c in ("i", "d", "b", "t", "day")] == [1, 1, 1, 2, 0]
    assert p.numeric_text_columns() == []


def test_validation(table):
    t = table(["name", "email"], [("a", "a@b.co"), ("b", ""), ("c", "=1+1")])
    p = P.profile_table(t)
    v = validate_table(p, ["column_1"], revision=4)
    checks = {r["check_id"]: r for r in v.checks().collect()}
    assert v.status == "passed" and checks["required_columns"]["status"] == "passed"
    assert checks["download_warnings"]["affected_count"] == 1
    v = validate_table(p, ["column_2"], revision=4)
    checks = {r["check_id"]: r for r in v.checks().collect()}
    assert v.status == "failed" and checks["required_columns"]["example_rows"] == [3]
    roll = v.rollup().first()
    assert (roll["errors"], roll["warnings"], roll["passed"], roll["revision"]) == (1, 2, 0, 4)
    with pytest.raises(TableError):
        validate_table(p, ["nope"])


def test_inspect(table):
    t = table(["v"], [("b",), ("a",), ("b",), (None,), ("",), ("c",), ("d",)])
    r = P.inspect_column(t, "column_1").first()
    assert (r["missing_count"], r["distinct_count"], r["unique_sample"]) == (2, 6, ["b", "a", "", "", "c"])
    s = P.table_summary(t, ["column_1"], ["column_1"]).first()
    assert tuple(s) == (7, 1, 2, 2)  # null and '' are one key as text
    assert P.completeness_score(t, ["column_1"]).first()[0] == pytest.approx(5 / 7)
    assert P.completeness_score(t.limit(0), ["column_1"]).first()[0] == 1.0
    assert P.formula_like_count(table(["x"], [("=1",), (" =1",), ("@a",)])).first()[0] == 2


def test_converted_column_is_not_flagged_again(table):
    t = table(["amount"], [("1",), ("2",), ("3",), ("4",), ("x",)])
    assert P.profile_table(t).numeric_text_columns() == ["column_1"]
    assert P.profile_table(A.ConvertNumeric("column_1").apply(t)).numeric_text_columns() == []
