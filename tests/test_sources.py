import glob

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sluicebox.errors import TableError
from sluicebox.operators.profile import profile_table
from sluicebox.operators.validate import validate_table
from sluicebox.plans import packs, rulepack
from sluicebox.plans.history import TablePlan
from sluicebox.sources import csv, export
from sluicebox.table import ROW_NO, display_names

from .conftest import column


def write(tmp_path, payload: bytes, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(payload)
    return str(path)


def rows(df):
    names = [c for c in df.columns if c != ROW_NO]
    return [tuple(r[c] for c in names) for r in df.orderBy(ROW_NO).collect()]


def test_headers_text_and_row_numbers(spark, tmp_path):
    t = csv.read_csv(spark, write(tmp_path, b"name,,name,amount\n a ,b,c,0012.50\nd,e,,\n"))
    assert list(display_names(t).values()) == ["name", "", "name", "amount"]
    assert rows(t) == [(" a ", "b", "c", "0012.50"), ("d", "e", "", "")]
    assert column(t, ROW_NO) == [0, 1]


@pytest.mark.parametrize("payload", ["name\ncafé\n".encode("utf-8-sig"), "name\ncafé\n".encode("cp1252")])
def test_encodings(spark, tmp_path, payload):
    t = csv.read_csv(spark, write(tmp_path, payload))
    assert list(display_names(t).values()) == ["name"] and rows(t) == [("café",)]


def test_windows_1252_specials(spark, tmp_path):
    t = csv.read_csv(spark, write(tmp_path, "n,v\n“x”,€5\n".encode("cp1252")))
    assert rows(t) == [("“x”", "€5")]


def test_blank_and_short_lines_stay_rows(spark, tmp_path):
    t = csv.read_csv(spark, write(tmp_path, b"a,b\n,\n\n1\nx,y\n"))
    assert rows(t) == [("", ""), ("", ""), ("1", ""), ("x", "y")]


def test_quotes(spark, tmp_path):
    t = csv.read_csv(spark, write(tmp_path, b'a,b\n"M, J","say ""hi"""\n5" pipe,x\n'))
    assert rows(t) == [("M, J", 'say "hi"'), ('5" pipe', "x")]


def test_quoted_line_breaks(spark, tmp_path):
    t = csv.read_csv(spark, write(tmp_path, b'a,b\n"one\ntwo",x\ny,"p ""q""\n\nr"\n'))
    assert list(display_names(t).values()) == ["a", "b"]
    assert rows(t) == [("one\ntwo", "x"), ("y", 'p "q"\n\nr')]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_over_many_splits(spark, tmp_path, end):
    """The rows of Python's own reader, whatever the split size."""
    import csv as pycsv
    import io
    import random

    rng = random.Random(7)
    words = ["a", "b c", 'say "x"', "one\ntwo", "p\n\nq, r", "", '"', 'z"\n"z', 'x,"\n,"y', "long " * 30]
    buffer = io.StringIO()
    out = pycsv.writer(buffer, lineterminator=end)
    out.writerow(["k", "v", "w"])
    for i in range(300):
        out.writerow([i, rng.choice(words), rng.choice(words)])
    buffer.write(f'x,5" pipe,{end}')
    payload = buffer.getvalue()
    want = [tuple(r) for r in pycsv.reader(io.StringIO(payload, newline=""))][1:]
    path = write(tmp_path, payload.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            t = csv.read_csv(spark, path)
            assert rows(t) == want
            assert column(t, ROW_NO) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unclosed_quote(spark, tmp_path):
    with pytest.raises(TableError) as e:
        csv.read_csv(spark, write(tmp_path, b'a,b\n1,"open\n2,x\n'))
    assert e.value.code == "invalid_file"


def test_bad_tables(spark, tmp_path):
    cases = {b"a,b\n": "empty_table", b"a,b\n,\n , \n": "empty_table", b"": "empty_table", b"a,b\n1,2,3\n": "invalid_file", b"a,b\n1,2,\n": "invalid_file"}
    for i, (payload, code) in enumerate(cases.items()):
        with pytest.raises(TableError) as e:
            csv.read_csv(spark, write(tmp_path, payload, f"{i}.csv"))
        assert e.value.code == code, payload
    path = write(tmp_path, b"a,b\n1,2\n3,4\n")
    for limits in (csv.IngestLimits(max_rows=1), csv.IngestLimits(max_columns=1)):
        with pytest.raises(TableError) as e:
            csv.read_csv(spark, path, limits)
        assert e.value.code == "table_too_large"
    assert csv.read_csv(spark, path, csv.IngestLimits(max_rows=2, max_columns=2)).count() == 2


def test_row_numbers_over_many_splits_and_files(spark, tmp_path):
    for f in range(3):
        body = "".join(f"{f}-{i},{'x' * (i % 40)}\n" for i in range(400))
        write(tmp_path, ("id,pad\n" + body).encode(), f"part-{f}.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        t = csv.read_csv(spark, str(tmp_path))
        got = column(t, "column_1")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{f}-{i}" for f in range(3) for i in range(400)]
    assert column(t, ROW_NO) == list(range(1200))


def test_named_and_gold(spark, tmp_path):
    path = write(tmp_path, b"id,n\n007,89.0\nx ,\n")
    assert csv.read_named_csv(spark, path).columns == ["id", "n", ROW_NO]
    assert rows(csv.read_gold_csv(spark, path)) == [("7", "89"), ("x ", "")]


def test_csv_export(spark, table, tmp_path):
    t = table(["name", "", "name"], [("b", "=1+1", None), (" a ", 'q"', "x,y")])
    out = export.write_csv(t, str(tmp_path / "out"))
    payload = b"".join(open(p, "rb").read() for p in sorted(glob.glob(out + "/*.csv")))
    assert payload.startswith("﻿name,,name\n".encode())
    assert b"b,=1+1,\n" in payload and b' a ,"q""","x,y"\n' in payload and b"\r" not in payload
    back = csv.read_csv(spark, out)
    assert rows(back) == [("b", "=1+1", ""), (" a ", 'q"', "x,y")]
    assert list(display_names(back).values()) == ["name", "", "name"]


def test_bundle_needs_a_validation_of_the_revision(spark, table, tmp_path):
    plan = TablePlan(table(["name"], [("a",), ("",)]))
    outcome = validate_table(profile_table(plan.current()), ["column_1"], plan.revision)
    assert outcome.status == "failed"
    audit = spark.createDataFrame([("chg-001",)], "change_id string")
    with pytest.raises(TableError):
        export.write_validated_bundle(plan.current(), outcome, audit, str(tmp_path / "x"), plan.revision + 1)
    path = export.write_validated_bundle(plan.current(), outcome, audit, str(tmp_path / "y"), plan.revision)
    assert spark.read.json(path + "/validation_report/summary").first()["status"] == "failed"
    assert spark.read.json(path + "/audit_log").count() == 1


def test_pack_export_and_publish(spark, tmp_path):
    raw = spark.createDataFrame([("O1", "A", "shipped", "$5", "01/20/2024", "R", "S", 0)], ", ".join(f"{c} string" for c in packs.ORDERS.expected_columns) + f", {ROW_NO} bigint")
    audit = spark.createDataFrame([("x",)], "change_id string")
    with pytest.raises(TableError) as e:
        export.export_pack(raw, packs.ORDERS, audit, str(tmp_path))
    assert e.value.code == "validation_failed"
    with pytest.raises(TableError):
        export.publish(spark, None, "t")
    done = export.export_pack(rulepack.clean(raw, packs.ORDERS), packs.ORDERS, audit, str(tmp_path), score=0.99)
    assert done.endswith(packs.ORDERS.export_destination)
    assert spark.read.json(done + "/quality_report").first()["validation_status"] == "passed"
    export.publish(spark, done, "published_orders")
    assert spark.table("published_orders").select("amount").first()[0] == 5.0
    assert spark.table("published_orders").where(F.col("order_date") == "2024-01-20").count() == 1


def test_half_an_export_is_not_published(spark, tmp_path):
    table = spark.range(40).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v"), F.array("id").alias("ids"))
    whole, half, unfinished, empty = (str(tmp_path / n) for n in ("whole", "half", "unfinished", "empty"))
    for target in (whole, half):
        export.write_export(table.repartition(4), target)
    next(p for p in (tmp_path / "half" / "cleaned").iterdir() if p.name.startswith("part-") and p.stat().st_size).unlink()
    table.write.json(f"{unfinished}/cleaned")
    export.write_export(table.limit(0), empty)
    for broken in (half, unfinished):
        with pytest.raises(TableError) as e:
            export.publish(spark, broken, "never_published")
        assert e.value.code == "export_incomplete"
    assert not spark.catalog.tableExists("never_published")
    export.verify_export(spark, whole)
    export.verify_export(spark, empty)


def test_a_field_that_only_looks_quoted_is_not_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\nx,a"b,c"d\n')
    with pytest.raises(TableError, match="more fields"):
        csv.read_csv(spark, str(tmp_path / "a.csv"))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    with pytest.raises(TableError, match="b.csv"):
        csv.read_csv(spark, str(tmp_path))


def test_row_numbers_and_headers_sort_and_move_no_record(spark, tmp_path):
    for i in range(3):
        write(tmp_path, b"a,b\n" + b"x,y\n" * (i + 1), f"{i}.csv")
    lines = csv._lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = csv.number_rows(lines)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert [r["value"] for r in csv._first_records(lines).collect()] == ["a,b"] * 3
        firsts = csv._first_records(lines)._jdf.queryExecution().executedPlan().toString()
        assert column(numbered, ROW_NO) == list(range(6))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in firsts
    # The offsets of splits meet those of files by a sort; the lines meet them by a hash table.
    assert "BroadcastHashJoin [__file" in plan and plan.count("SortMergeJoin") == 1


def test_files_of_other_headers_are_named(spark, tmp_path):
    write(tmp_path, b"a,b\n1,2\n", "0.csv")
    write(tmp_path, b"a,c\n1,2\n", "1.csv")
    with pytest.raises(TableError, match="1.csv"):
        csv.read_csv(spark, str(tmp_path))


def test_records_over_lines_are_joined_without_moving_them(spark, tmp_path):
    """Lines meet their records where they are read, also where headers and cells run over several splits."""
    lines = [f"l\xe4ng {i} \u20ac" for i in range(40)]
    cell = "\n".join(lines)
    payload = f'"{cell}",b\r\n"x\ny",1\r\n,2\r\n"{cell}\n","3"\r\n5" pipe,4\n'
    changed = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        for encoding in ("utf-8", "cp1252"):
            path = write(tmp_path, payload.encode(encoding), f"{encoding}.csv")
            plan = csv._records(csv._decoded(csv._lines(spark, path)))._jdf.queryExecution().executedPlan().toString()
            assert not any(moved in plan.replace("BroadcastExchange", "") for moved in ("Exchange", "Sort", "Window"))
            t = csv.read_named_csv(spark, path)
            assert t.columns == [cell, "b", ROW_NO]
            assert [tuple(r) for r in t.orderBy(ROW_NO).collect()] == [("x\ny", "1", 0), ("", "2", 1), (cell + "\n", "3", 2), ('5" pipe', "4", 3)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_split_in_another_way_are_refused(spark, tmp_path):
    lines = csv._lines(spark, write(tmp_path, b'a,b\n"x\ny",1\n'))
    with pytest.raises(PythonException, match="another way"):
        csv._mapped(lines).mapInArrow(csv._cut({}), "value string, __file string, __start bigint, __id bigint, __part int").collect()
