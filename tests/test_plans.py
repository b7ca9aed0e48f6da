"""Rule packs on small tables of our own, replay, audit, comparison, streaming."""

import pytest
from pyspark.sql import functions as F

from sluicebox.errors import TableError
from sluicebox.functions.numbers import infer_gold_text
from sluicebox.operators import compare
from sluicebox.operators.cells import trim_whitespace
from sluicebox.operators.positions import source_position
from sluicebox.operators.profile import table_summary
from sluicebox.plans import actions as A
from sluicebox.plans import packs, rulepack
from sluicebox.plans.history import TablePlan, append_audit, latest_audit, plan_metrics
from sluicebox.sources import export
from sluicebox.streaming import clean_stream
from sluicebox.table import ROW_NO, data_columns

from .conftest import column

# name: raw columns, raw rows, clean rows (as text)
CASES = {
    "contacts": (
        ["customer_id", "full_name", "email", "customer_segment", "signup_date", "phone"],
        [("K1", " ann O'DELL", "ANN@X.COM ", " vip ", "2024/01/15", " 1 "), ("K2", "bo li ", " bo@x.com", "Retail ", "18-02-2024", "")],
        [("K1", "Ann O'Dell", "ann@x.com", "VIP", "2024-01-15", "1"), ("K2", "Bo Li", "bo@x.com", "Retail", "2024-02-18", "UNKNOWN")],
    ),
    "orders": (
        list(packs.ORDERS.expected_columns),
        [("O2", "Al ", " SHIPPED", "$1,005.75", "03/02/2024", "", None), ("O1", "Cy", "canceled", "89.00 ", "2024-03-01", "Rome", "RM"),
         ("O2", "Al ", " SHIPPED", "$1,005.75", "03/02/2024", "", None)],
        [("O1", "Cy", "cancelled", "89.0", "2024-03-01", "Rome", "RM"), ("O2", "Al", "shipped", "1005.75", "2024-03-02", "UNKNOWN", "UNKNOWN")],
    ),
    "appointments": (
        list(packs.APPOINTMENTS.expected_columns),
        [("A1", "mia ray ", "INSTALL", " sam reed", "04/11/2024 14:00", "scheduled", "x", "2024-04-09 15:50"),
         ("A1", "mia ray", "Installation", "Sam Reed", "2024/04/11 14:00", "scheduled", " x", "2024-04-09T14:20"),
         ("A2", "Jo", "return pickup", "", "2024-04-12T11:45:00", "confirmed", None, "2024/04/05 16:10")],
        [("A1", "Mia Ray", "Installation", "Sam Reed", "2024-04-11T14:00", "scheduled", "x", "2024-04-09T15:50"),
         ("A2", "Jo", "Returns", "TBD", "2024-04-12T11:45", "confirmed", "UNKNOWN", "2024-04-05T16:10")],
    ),
    "churn": (
        list(packs.CHURN.expected_columns),
        [("C1", "12", "", "$120.50", " vip ", "0", "12/29/2023"), ("C2", "8", "10", "245.75", "LOYAL few", "1", "21-03-2024")],
        [("C1", "12", "6", "120.5", "Vip", "0", "2023-12-29"), ("C2", "8", "10", "245.75", "Loyal Few", "1", "2024-03-21")],
    ),
    "forecast": (
        list(packs.FORECAST.expected_columns),
        [("2024/01/01", "P1", "10", "5", "shoes"), ("01/02/2024", "P1", "", "6", " HOME goods"), ("2024-01-01", "P2", None, "7", "x")],
        [("2024-01-01", "P1", "10", "5", "Shoes"), ("2024-01-02", "P1", "10", "6", "Home Goods"), ("2024-01-01", "P2", "10", "7", "X")],
    ),
    "recommendations": (
        list(packs.RECOMMENDATIONS.expected_columns),
        [(" U1 ", "S1", "5", "2024/03/01", "gear"), ("u1", "S2", "", "03/03/2024", " home goods ")],
        [("u1", "S1", "5.0", "2024-03-01", "Gear"), ("u1", "S2", "3.0", "2024-03-03", "Home Goods")],
    ),
}


def raw_and_gold(spark, name):
    columns, raw, gold = CASES[name]
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], f"{schema}, {ROW_NO} bigint")
    want = spark.createDataFrame(gold, ", ".join(f"`{c}` string" for c in packs.PACKS[name].expected_columns))
    return df, want.select(*[infer_gold_text(F.col(f"`{c}`")).alias(c) for c in want.columns])


@pytest.mark.parametrize("name", CASES)
def test_pack_reaches_gold(spark, name):
    pack = packs.PACKS[name]
    raw, gold = raw_and_gold(spark, name)
    out = rulepack.clean(raw, pack)
    after = rulepack.grade(out, gold, pack).first()
    assert after["ratio"] == 1.0 and after["score"] == 0.99
    assert rulepack.grade(raw, gold, pack).first()["ratio"] < 1.0
    assert rulepack.rollup(rulepack.run_checks(out, pack)).first()["export_ready"] is True
    assert rulepack.rollup(rulepack.run_checks(raw, pack)).first()["export_ready"] is False
    assert rulepack.issues_summary(out, pack).count() == 0


def test_pack_round_trips_as_json():
    for pack in packs.PACKS.values():
        assert rulepack.RulePack.from_json(pack.to_json()) == pack


def test_every_planned_step_matters(spark):
    raw, gold = raw_and_gold(spark, "orders")
    plan = rulepack.compile_pack(packs.ORDERS, data_columns(raw))
    for i, step in enumerate(plan):
        if step.kind == "cast_dtype":
            continue  # grading compares cast columns as numbers either way
        partial = A.apply_plan(raw, plan[:i] + plan[i + 1 :])
        assert rulepack.grade(partial, gold, packs.ORDERS).first()["ratio"] < 1.0, step.kind


def test_unknown_column_scores_low(spark):
    _, gold = raw_and_gold(spark, "orders")
    other = spark.createDataFrame([("x", 0)], f"what string, {ROW_NO} bigint")
    assert rulepack.grade(other, gold, packs.ORDERS).first()["ratio"] < 0.5


def test_suggested_steps_and_profile(spark):
    raw, _ = raw_and_gold(spark, "contacts")
    steps = [r["step"] for r in rulepack.suggest_pack_steps(raw, packs.CONTACTS).orderBy("position").collect()]
    assert steps == [
        "strip_whitespace", "normalize_case:email", "replace_values:customer_segment", "standardize_date", "rename_column", "fill_missing:phone",
    ]
    p = rulepack.profile_pack(raw, packs.CONTACTS).first()
    assert p["row_count"] == 2 and len(p["issues_summary"]) == 4 and "rename_column" in p["risky_steps"]


def test_check_rules(spark):
    from dataclasses import replace

    df = spark.createDataFrame([("a", 5.0), ("b", -1.0), ("c", None)], "email string, amount double")
    rules = dict.fromkeys(["amounts_numeric_non_negative", "emails_valid", "populated:amount", "populated:gone", "odd_rule"], "")
    got = {r["check_id"]: (r["failed_count"], r["severity"]) for r in rulepack.run_checks(df, replace(packs.ORDERS, validation_rules=rules)).collect()}
    assert got == {
        "amounts_numeric_non_negative": (2, "error"), "emails_valid": (3, "error"), "populated:amount": (1, "error"),
        "populated:gone": (3, "error"), "odd_rule": (0, "info"),
    }
    text_amount = df.withColumn("amount", F.lit("5"))
    assert rulepack.run_checks(text_amount, replace(packs.ORDERS, validation_rules={"amounts_numeric_non_negative": ""})).first()["failed_count"] == 3


def test_replay_undo_reset(table):
    t = table(["a", "b"], [(" x", "1"), ("y ", "")])
    plan = TablePlan(t).add(A.TrimWhitespace(("column_1",))).add(A.RenameColumn("column_1", "Name"))
    assert plan.revision == 3 and column(plan.current(), "column_1") == ["x", "y"]
    undone = plan.undo()
    assert undone.revision == 4 and undone.current().schema["column_1"].metadata["display_name"] == "a"
    back = undone.reset()
    assert back.revision == 5 and column(back.current(), "column_1") == [" x", "y "]
    with pytest.raises(TableError):
        back.undo()
    with pytest.raises(TableError):
        back.reset()


def test_metrics_are_measured_in_one_aggregate(table, tmp_path):
    t = table(["a", "b"], [(" x", "1"), ("y ", ""), ("y ", "")])
    plan = [A.TrimWhitespace(("column_1",)), A.FillMissing("column_2", "explicit", "0"), A.RenameColumn("column_1", "N"), A.DropDuplicates()]
    m = plan_metrics(t, plan)
    got = [(r["step"], r["action_type"], r["affected_count"]) for r in m.orderBy("step").collect()]
    assert got == [(0, "trim_whitespace", 3), (1, "fill_missing", 2), (2, "rename_column", 1), (3, "drop_duplicates", 1)]
    row_local = plan_metrics(t, plan[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert row_local.count("Aggregate") == 1
    audit = TablePlan(t, tuple(plan)).audit()
    path = str(tmp_path / "audit")
    append_audit(audit, path)
    kept = latest_audit(t.sparkSession.read.parquet(path), 2).collect()
    assert [r["revision"] for r in kept] == [5, 4]


def test_forward_fill_metrics(spark):
    df = spark.createDataFrame([("", 0), ("1", 1), ("", 2), (None, 3)], f"v string, {ROW_NO} bigint")
    m = A.FillForward(("v",)).metrics(df).first()
    assert (m["affected_count"], m["changed_rows"]) == (2, 2)


def test_footprint(spark, table):
    t = table(["a", "b"], [(" x", "1"), ("y", "2"), ("z", "3")])
    after = trim_whitespace(t)
    for by_row in (False, True):
        f = compare.change_footprint(t, after, by_row=by_row).first()
        assert (f["row_count"], f["columns"], f["changed_cells"]) == (1, ["column_1", "column_2"], {"column_1": 1})
    assert compare.change_footprint(t, t).first()["row_count"] == 0
    shorter = t.where(F.col(ROW_NO) > 0)
    assert compare.change_footprint(t, shorter).first()["row_count"] == 3
    assert compare.change_footprint(t, shorter, by_row=True).first()["row_count"] == 1


@pytest.mark.parametrize("gap", [False, True])
def test_match_ratio_over_many_blocks(spark, gap):
    """Equal blocks, a changed cell, a number that equals no number, and rows beyond the end of one side."""
    kept = f"{ROW_NO} % 1000 <> 999" if gap else "true"
    left = spark.range(0, 6000, 1, 5).select(F.col("id").cast("string").alias("n"), (F.col("id") % 7).cast("string").alias("v"), F.col("id").alias(ROW_NO)).where(kept)
    left = left.withColumn("n", F.when(F.col(ROW_NO) == 2100, "1e999").otherwise(F.col("n")))
    right = left.where(f"{ROW_NO} < 5500").withColumn("v", F.when(F.col(ROW_NO) == 4200, "other").otherwise(F.col("v")))
    rows, other = left.count(), right.count()
    for keys in (None, ["n"]):
        m = compare.match_ratio(left, right, ["n", "v"], keys, ["n"]).first()
        assert (m["current_rows"], m["expected_rows"], m["cells"]) == (rows, other, 2 * rows)
        if keys is None:
            assert m["matches"] == 2 * other - 2
    same = compare.match_ratio(left, left, ["v"], None).first()
    assert (same["matches"], same["cells"]) == (rows, rows)


def test_only_rows_of_differing_blocks_are_read_again(spark):
    left = spark.range(0, 8192, 1, 4).select(F.col("id").cast("string").alias("v"), F.col("id").alias(ROW_NO))
    right = left.withColumn("v", F.when(F.col(ROW_NO) == 5000, "x").otherwise(F.col("v")))
    sides = [source_position(df) for df in (left, right)]
    a, b, agreed = compare.differing_rows(*sides, [F.col("v")], [F.col("v")])
    assert (a.count(), b.count(), agreed) == (1024, 1024, 7168)
    a, b, agreed = compare.differing_rows(sides[0], sides[0], [F.col("v")], [F.col("v")])
    assert (a.count(), b.count(), agreed) == (0, 0, 8192)
    f = compare.change_footprint(left, right).first()
    assert (f["row_count"], f["changed_cells"]) == (1, {"v": 1})


def test_keyed_diff(spark):
    now = spark.createDataFrame([("1", "a", 0), ("2", "b", 1), ("4", None, 2), ("1", "z", 3)], f"k string, v string, {ROW_NO} bigint")
    was = spark.createDataFrame([("1", "old", 0), ("1", "a", 1), ("3", "c", 2), ("4", "", 3)], f"k string, v string, {ROW_NO} bigint")
    got = sorted((r["k"], r["status"], tuple(r["changed_columns"])) for r in compare.keyed_diff(now, was, ["k"]).collect())
    assert got == [
        ("1", "changed", ("v",)), ("1", "unchanged", ()), ("2", "new", ("k", "v")), ("3", "removed", ()), ("4", "unchanged", ()),
    ]


def test_keyed_diff_evaluates_current_once(spark):
    now = spark.range(7, 500).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    out = compare.keyed_diff(now, now.where("k <> '9'").union(spark.createDataFrame([("a", "x")], "k string, v string")), ["k"])
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["status"]: r["rows"] for r in compare.diff_summary(out).collect()} == {"unchanged": 492, "new": 1, "removed": 1}


def test_numeric_cells_match_within_tolerance(spark):
    a = spark.createDataFrame([("5", 0), ("x", 1), ("$1,000", 2)], f"n string, {ROW_NO} bigint")
    b = spark.createDataFrame([("5.0000001", 0), ("x ", 1), ("1000.0", 2)], f"n string, {ROW_NO} bigint")
    assert compare.match_ratio(a, b, ["n"], None, ["n"]).first()["matches"] == 2
    assert compare.match_ratio(a, b, ["n"], None).first()["matches"] == 0
    empty = compare.match_ratio(a.limit(0), b.limit(0), ["n"], None).first()
    assert (empty["cells"], empty["ratio"]) == (1, 1.0)


def test_hot_paths_have_no_python_and_no_single_task(spark):
    raw, _ = raw_and_gold(spark, "orders")
    plan = rulepack.clean(raw, packs.ORDERS)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    assert plan.count("Exchange") == 1


def test_stream_gives_the_same_cells(spark, tmp_path):
    t = spark.createDataFrame([(" a ", "01/20/2024"), ("B", "x")], "n string, d string")
    t.write.parquet(str(tmp_path / "in"))
    steps = [A.StripColumns(), A.NormalizeCase("lower", "n"), A.CanonicalDates({"d": False})]
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = clean_stream(stream, steps).writeStream.format("memory").queryName("cleaned").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("cleaned").collect())
    assert got == sorted(tuple(r) for r in A.apply_plan(t, steps).collect()) == [("a", "2024-01-20"), ("b", "x")]
    with pytest.raises(TableError):
        clean_stream(stream, [A.DropDuplicates()])


def test_replay_runs_no_job(table, spark):
    """Five steps that had to look at the data: replaying, undoing and building the audit start nothing."""
    t = table(["a", "b", "c", "d"], [("1", " x", "", "5"), ("3", "y ", "", ""), ("", "y ", "", "7"), ("3", "y ", "", "")])
    plan = TablePlan(t)
    for step in (A.ConvertNumeric("column_1", "integer"), A.FillMissing("column_4", "mean"), A.DropEmptyColumns(("column_3",)), A.FillMissing("column_1", "median"), A.TrimWhitespace(("column_2",))):
        plan = plan.add(step)
    context = spark.sparkContext
    context.setJobGroup("replay", "replay")
    try:
        now, before, audit = plan.current(), plan.undo().current(), plan.audit()
        assert list(context.statusTracker().getJobIdsForGroup("replay")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    rows = [tuple(r)[:3] for r in now.orderBy(ROW_NO).collect()]
    assert rows == [(1, "x", "5"), (3, "y", "6"), (3, "y", "7"), (3, "y", "6")]
    assert [r["column_2"] for r in before.orderBy(ROW_NO).collect()] == [" x", "y ", "y ", "y "]
    assert [r["affected_count"] for r in audit.orderBy("change_id").collect()] == [3, 2, 1, 1, 4]
    assert all("learned" not in a.to_dict() for a in plan.actions)


def test_checks_and_summaries_read_the_table_once(spark):
    df = spark.createDataFrame([("ORD-1", "a", "b")] * 2 + [("ORD-2", "a", None)], "order_id string, city string, state string")
    for counted in (rulepack.run_checks(df, packs.ORDERS), table_summary(df, ["city", "state"], ["order_id"])):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Subquery" not in plan and plan.count("Scan ExistingRDD") == 1
    assert tuple(table_summary(df, ["city", "state"], ["order_id"]).first()) == (3, 3, 1, 1)
    assert tuple(table_summary(df.limit(0), ["city"], ["order_id"]).first()) == (0, 3, 0, 0)
    failed = {r["check_id"]: r["failed_count"] for r in rulepack.run_checks(df, packs.ORDERS).collect()}
    assert failed["duplicates_resolved"] == 1 and failed["required_fields_present"] == 1 and failed["schema_matches"] == 1
    assert {r["failed_count"] for r in rulepack.run_checks(df.limit(0), packs.ORDERS).collect()} == {0, 1}


def test_export_makes_the_table_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def city(n):
        made.add(1)
        return f"City {n}"

    n = F.col("id").cast("string")
    df = spark.range(40).select(
        F.concat(F.lit("ORD-"), n).alias("order_id"), n.alias("customer_name"), F.lit("shipped").alias("status"), F.lit(1.5).alias("amount"),
        F.lit("2024-01-02").alias("order_date"), city("id").alias("city"), F.lit("x").alias("state"), F.col("id").alias(ROW_NO),
    )
    path = export.export_pack(df, packs.ORDERS, spark.createDataFrame([(1,)], "step int"), str(tmp_path))
    assert made.value == 40 and export.read_export(spark, path).count() == 40


def test_keyed_diff_takes_the_last_of_repeated_keys(spark):
    base = spark.createDataFrame([(f"k{i % 30 if i < 60 else i}", str(i), i) for i in range(90)], f"k string, v string, {ROW_NO} bigint")
    now = spark.createDataFrame([(f"k{i}", str(i + 30 if i < 30 else i), i) for i in range(88) if i < 30 or i >= 60], f"k string, v string, {ROW_NO} bigint")
    found = {r["status"]: r["rows"] for r in compare.diff_summary(compare.keyed_diff(now, base, ["k"])).collect()}
    assert found == {"unchanged": 58, "removed": 2}
