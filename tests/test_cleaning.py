import statistics

import pytest
from pyspark.sql import functions as F

from sluicebox.errors import TableError
from sluicebox.operators import cells, columns, compare, fills, rows
from sluicebox.operators.positions import POSITION, with_position
from sluicebox.plans import actions as A
from sluicebox.session import stage
from sluicebox.table import ROW_NO, display_names, preview

from .conftest import column


def test_trim_counts_samples_and_keeps_headers(table):
    t = table([" Name", "City"], [(" Ann ", "Oslo"), ("Bo", "Rome "), (None, "")])
    action = A.TrimWhitespace(("column_1", "column_2"))
    out = action.apply(t)
    assert column(out, "column_1") == ["Ann", "Bo", None]
    assert display_names(out) == {"column_1": " Name", "column_2": "City"}
    m = action.metrics(t).first()
    assert (m["affected_count"], m["affected_unit"], m["risk"], m["changed_rows"]) == (2, "values", "low", 2)
    s = action.samples(t).collect()
    assert [(r["row_number"], r["before"], r["after"]) for r in s] == [
        (2, {"column_1": " Ann "}, {"column_1": "Ann"}), (3, {"column_2": "Rome "}, {"column_2": "Rome"}),
    ]
    with pytest.raises(TableError) as e:
        A.run_action(out, action)
    assert e.value.code == "action_not_applicable"


@pytest.mark.parametrize(("strategy", "want"), [("mean", "20"), ("median", "20"), ("most_common", "10")])
def test_fills(table, strategy, want):
    t = table(["amount"], [("10",), ("",), ("30",), ("20",)])
    assert column(fills.fill_missing_with(t, "column_1", strategy), "column_1") == ["10", want, "30", "20"]


def test_fill_errors(table):
    t = table(["amount"], [("a",), ("",)])
    with pytest.raises(Exception, match="column of numbers"):
        fills.fill_missing_with(t, "column_1", "mean").collect()
    with pytest.raises(TableError):
        fills.fill_missing_with(t, "column_1", "median")
    with pytest.raises(TableError):
        fills.fill_missing_with(t, "column_1", "explicit", "  ")


def test_forward_fill_equals_global_window(spark):
    n = 3000
    rows_ = [(str(i) if i % 7 == 3 and not 500 < i < 1900 else ("" if i % 2 else None), f"k{i % 3}", i) for i in range(n)]
    df = spark.createDataFrame(rows_, f"v string, k string, {ROW_NO} bigint").repartition(5)
    last, want = None, []
    for v, _, _ in rows_:
        last = v if v else last
        want.append(last if not v and last else v)
    assert column(fills.fill_forward(df, ["v"], block_rows=16), "v") == want
    seen, grouped = {}, []
    for v, k, _ in rows_:
        seen[k] = v if v else seen.get(k)
        grouped.append(seen[k] if not v and seen[k] else v)
    assert column(fills.fill_forward(df, ["v"], ["k"], block_rows=16), "v") == grouped


def test_forward_fill_keeps_rows_out_of_one_task(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("v"), F.col("id").alias(ROW_NO))
    plan = fills.fill_forward(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("__block" in w or "__group" in w for w in windows)


def test_duplicates_keep_first_and_last(table):
    t = table(["name", "region"], [("A", "x"), ("B", "y"), ("A", "x")])
    assert column(rows.drop_duplicates(t, "first"), ROW_NO) == [0, 1]
    assert column(rows.drop_duplicates(t, "last"), ROW_NO) == [1, 2]
    m = A.DropDuplicates("first").metrics(t).first()
    assert (m["affected_count"], m["affected_unit"]) == (1, "rows")
    assert A.DropDuplicates("first").samples(t).first()["row_number"] == 4
    assert A.DropDuplicates("last").samples(t).first()["row_number"] == 2


def test_survivor_prefers_complete_then_latest(spark):
    data = [
        ("1", "a", "", "2024-01-03", 0), ("1", "a", "x", "2024-01-01", 1),
        ("2", "b", "y", "2024/01/05 10:00", 2), ("2", "c", "z", "01/04/2024", 3),
        ("3", "d", "q", None, 4), ("3", "e", "q", "2020-01-01", 5),
    ]
    df = spark.createDataFrame(data, f"id string, n string, m string, at string, {ROW_NO} bigint")
    assert sorted(column(rows.keep_best(df, ["id"], ["n", "m"], "at"), ROW_NO)) == [1, 2, 5]


def test_convert_numeric(table):
    t = table(["amount"], [("1,200",), ("oops",), ("30.5",), ("",)])
    action = A.ConvertNumeric("column_1", "decimal")
    out = action.apply(t)
    assert column(out, "column_1") == ["1200.0", "oops", "30.5", ""]
    assert out.schema["column_1"].metadata["converted"] is True
    m = A.preview_change(t, action).first()
    assert (m["affected_count"], m["unresolved_count"]) == (2, 1) and "1 values" in m["warning"]
    with pytest.raises(TableError):
        A.ConvertNumeric("column_1", "integer").apply(t)
    whole = table(["n"], [("12%",), ("$3",), (None,)])
    assert column(cells.convert_numeric(whole, "column_1", "integer"), "column_1") == [12, 3, None]


def test_convert_number_columns(spark):
    df = spark.createDataFrame([(12345678.5, 3, 0), (None, None, 1)], f"d double, i bigint, {ROW_NO} bigint")
    assert column(A.ConvertNumeric("d").apply(df), "d") == [12345678.5, None]
    assert A.ConvertNumeric("d").metrics(df).first()["affected_count"] == 0
    assert column(A.ConvertNumeric("i").apply(df), "i") == [3.0, None]
    assert A.ConvertNumeric("i").metrics(df).first()["affected_count"] == 1
    assert column(fills.fill_missing_with(df, "d", "median"), "d") == [12345678.5, 12345678.5]
    with pytest.raises(TableError):
        A.ConvertNumeric("d", "integer").apply(df)


def test_release_staged(spark):
    from sluicebox import release_staged

    release_staged(spark)
    placed = with_position(spark.range(5).toDF("n"), [F.col("n")])
    assert placed.count() == 5 and release_staged(spark) == 1
    with pytest.raises(Exception, match="(?i)not|exist"):
        placed.count()


def test_standardize_dates(table):
    t = table(["d"], [("03/04/2026",), ("2026-05-06",), ("later",), ("",)])
    action = A.StandardizeDate("column_1", "day_first")
    assert column(action.apply(t), "column_1") == ["2026-04-03", "2026-05-06", "later", ""]
    m = action.metrics(t).first()
    assert (m["affected_count"], m["unresolved_count"]) == (2, 1)
    assert column(A.StandardizeDate("column_1", "month_first", "DD/MM/YYYY").apply(t), "column_1")[0] == "04/03/2026"


def test_drop_empty_columns(table):
    t = table(["name", "x", "y"], [("a", "", None), ("b", " ", None)])
    assert display_names(columns.drop_empty_columns(t, ["column_2", "column_3"])) == {"column_1": "name"}
    for bad in (["column_1"], ["column_1", "column_2", "column_3"], ["nope"]):
        with pytest.raises(TableError):
            columns.drop_empty_columns(t, bad)


def test_renames(table):
    t = table(["a", "b"], [("1", "2")])
    assert display_names(columns.rename_header(t, "column_1", " New ")) == {"column_1": "New", "column_2": "b"}
    for bad in (" ", "B"):
        with pytest.raises(TableError):
            columns.rename_header(t, "column_1", bad)
    assert columns.rename_column(t, "column_2", "z").columns == ["column_1", "z", ROW_NO]
    with pytest.raises(TableError):
        columns.rename_column(t, "column_1", "column_2")


def test_replace_values(spark, table):
    t = table(["s"], [(" VIP ",), ("vip",), (" other ",), (None,)])
    assert column(cells.replace_values(t, "column_1", {" Vip": "V"}), "column_1") == ["V", "V", " other ", None]
    side = spark.createDataFrame([("VIP ", "V")], "k string, v string")
    assert column(cells.replace_values_from(t, "column_1", side, "k", "v"), "column_1") == ["V", "V", " other ", None]


def test_strict_cast_fails_on_one_bad_cell(table):
    t = table(["n"], [("$1,005.75",), (" ",), ("x",)])
    assert column(cells.cast_dtype(t, "column_1", "float"), "column_1") == [1005.75, None, None]
    with pytest.raises(Exception, match="Cannot cast"):
        cells.cast_dtype(t, "column_1", "float", strict=True).collect()


def test_sort_is_textual_and_stable(table):
    t = table(["n"], [("10",), ("9",), (None,), ("10",)])
    assert [r[ROW_NO] for r in rows.sort_rows(t, ["column_1"]).collect()] == [2, 0, 3, 1]
    assert [r[ROW_NO] for r in rows.sort_rows(t, ["column_1"], ascending=False).collect()] == [1, 0, 3, 2]


def test_positions_equal_row_number_under_skew(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") * 7919 % 5000).cast("string")).alias("k"), F.col("id").alias(ROW_NO)
    )
    got = {r[ROW_NO]: r[POSITION] for r in with_position(df, [F.col("k")]).collect()}
    want = sorted(df.collect(), key=lambda r: (r["k"], r[ROW_NO]))
    assert [got[r[ROW_NO]] for r in want] == list(range(5000))
    plain = with_position(df.select("k"), [F.col("k")], [False]).collect()
    assert sorted(r[POSITION] for r in plain) == list(range(5000))


def test_align_and_preview(table):
    t = table(["a", "b"], [("1", "2"), ("3", "4")])
    out = columns.align_columns(t, ["column_2", "new"])
    assert out.columns == ["column_2", "new", ROW_NO] and column(out, "new") == [None, None]
    assert [r["row_number"] for r in preview(t, 1).collect()] == [2]


def final_plan(df):
    """The adaptive plan after it ran."""
    df.write.format("noop").mode("overwrite").save()
    out = df._jdf.queryExecution()
    df.collect()
    return out.executedPlan().toString()


@pytest.mark.parametrize("form", ["diff", "replace"])
def test_a_hot_key_is_split(spark, form):
    """One key on nine of ten rows: the final plan splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("string")
        pad = F.sha2(F.col("id").cast("string"), 256)
        left = spark.range(0, 40_000, 1, 8).select(key.alias("k"), pad.alias("v"), F.col("id").alias(ROW_NO))
        right = spark.range(0, 40_000, 1, 8).select(F.col("id").cast("string").alias("k"), pad.alias("v"), F.col("id").alias(ROW_NO))
        df = compare.keyed_diff(left, right, ["k"], removed=False) if form == "diff" else cells.replace_values_from(left, "k", right, "k", "v")
        assert "skew=true" in final_plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fills_widen_number_columns(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (None, 2)], f"n bigint, {ROW_NO} bigint")
    values = lambda d: [r["n"] for r in d.orderBy(ROW_NO).collect()]
    assert values(fills.fill_missing_with(df, "n", "mean")) == [1.0, 2.0, 1.5]
    assert values(fills.fill_missing_with(df, "n", "median")) == [1.0, 2.0, 1.5]
    assert values(fills.fill_missing_with(df, "n", "explicit", "7")) == [1, 2, 7]
    as_text = fills.fill_missing_with(df, "n", "explicit", "none")
    assert values(as_text) == ["1", "2", "none"] and as_text.schema["n"].metadata["converted"]


@pytest.mark.parametrize("numbers", [[3.0], [1.0, 2.0], [5.0] * 50 + [1.0, 9.0], [float(i % 977) ** 3 for i in range(3000)], [1e300, -1e300, 0.0, 1e-300]])
def test_median_is_exact(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "n double")
    assert fills.exact_median(df, "n") == statistics.median(numbers)


@pytest.mark.parametrize("numbers", [[-0.0, 0.0], [-1e308, -5e-324, 5e-324, 1e308], [-2.5, -2.25], [3.0] * 5, [1.0, 1.0000000000000002], [-7.0, float("inf"), 2.0]])
def test_median_of_close_and_far_numbers(spark, numbers):
    df = spark.createDataFrame([(n, i) for i, n in enumerate(numbers)], f"n double, {ROW_NO} bigint")
    assert fills.exact_median(df, "n") == statistics.median(numbers)


def test_median_stages_its_numbers_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(fills, "stage", lambda df, label: staged.append(label) or stage(df, label))
    df = spark.range(0, 5000, 1, 4).select((F.col("id") * F.col("id") / 7 - 1000).alias("n"), F.col("id").alias(ROW_NO))
    assert fills.exact_median(df, "n") == statistics.median(i * i / 7 - 1000 for i in range(5000))
    assert staged == ["median"]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_rows_of_repeated_keys_are_told_apart(spark, broadcast):
    df = spark.createDataFrame([(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i}", i) for i in range(400)], f"k string, {ROW_NO} bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        alone, contested = rows.split_by_repeats(df, rows.key_columns(df, ["k"]))
        single, rest = alone.collect(), contested.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["k"] for r in rest} == {None, "hot"} and len({r["k"] for r in single}) == len(single)
    assert sorted(r[ROW_NO] for r in single + rest) == list(range(400))


def test_splits_of_files_are_small(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"
