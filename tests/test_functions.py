import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions import dates, headers, numbers, text


def run(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_covers_every_whitespace(spark):
    assert len(text.WS) == 29
    padded = [f"{w}a b{w}" for w in text.WS]
    assert set(run(spark, padded, text.strip)) == {"a b"}
    assert all(w.strip() == "" for w in text.WS)


def test_missing_and_title(spark):
    assert run(spark, [None, "", "  ", "　", "x"], text.is_missing) == [True, True, True, True, False]
    names = ["o'brien jo-ann 3rd", "ÉCOLE", "maya  SINGH"]
    assert run(spark, names, text.title_case) == [n.title() for n in names]


@settings(max_examples=1, suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_characters="\x00ŉǅǈǋǲſßẞİıǰ"), max_size=12), min_size=300, max_size=300))
def test_strip_matches_python(spark, values):
    assert run(spark, values, text.strip) == [v.strip() for v in values]


def test_stringify(spark):
    values = [1.0, 2.5, 120.50, 1005.75, -3.0, 0.1, 1e6, None, float("nan")]
    want = ["1", "2.5", "120.5", "1005.75", "-3", "0.1", "1000000", "", "nan"]
    assert run(spark, values, lambda c: text.stringify(c, T.DoubleType()), "double") == want


def test_render_double(spark):
    values = [1200.0, 12345678.9, 1e16, 0.0005, 0.25, 123456789012.0]
    assert run(spark, values, text.render_double, "double") == [
        "1200.0", "12345678.9", "1.0E16", "0.0005", "0.25", "123456789012.0",
    ]


def test_render_cells(spark):
    df = spark.sql("SELECT timestamp'2024-01-05 10:00:00' a, timestamp_ntz'2024-01-05 10:00:00.25' b, true c, date'2024-01-05' d, 7L e, CAST('NaN' AS DOUBLE) f")
    shown = df.select(*[text.render_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(shown) == ("2024-01-05T10:00:00", "2024-01-05T10:00:00.250000", "True", "2024-01-05", "7", None)


def test_stable_json_sorts_names_and_keeps_nulls(spark):
    df = spark.createDataFrame([("x", None)], "b string, a string")
    assert df.select(text.stable_json([("b", F.col("b")), ("a", F.col("a"))])).first()[0] == '{"a":null,"b":"x"}'


@pytest.mark.parametrize(
    ("raw", "day", "minute"),
    [
        ("2024-01-05", "2024-01-05", "2024-01-05T00:00"),
        ("2024/1/5", "2024-01-05", "2024-01-05T00:00"),
        ("01/20/2024", "2024-01-20", "2024-01-20T00:00"),
        ("18-02-2024", "2024-02-18", "2024-02-18T00:00"),
        ("2024-04-11 14:00", "2024-04-11", "2024-04-11T14:00"),
        ("2024/04/10 09:30", "2024-04-10", "2024-04-10T09:30"),
        ("04/11/2024 14:00", "2024-04-11", "2024-04-11T14:00"),
        ("04/11/2024 02:05 PM", "2024-04-11", "2024-04-11T14:05"),
        ("12/31/2024 12:00 AM", "2024-12-31", "2024-12-31T00:00"),
        ("18-02-2024 07:15", "2024-02-18", "2024-02-18T07:15"),
        ("2024-04-02T09:15:59", "2024-04-02", "2024-04-02T09:15"),
        ("2024-04-02T09:15+02:00", "2024-04-02", "2024-04-02T09:15"),
        ("2024-04-02 09:15:10.25Z", "2024-04-02", "2024-04-02T09:15"),
        ("20240102", "2024-01-02", "2024-01-02T00:00"),
        ("2024-13-01", None, None),
        ("02/30/2024", None, None),
        ("2024/01-05", None, None),
        ("2024-1", None, None),
        ("12:30", None, None),
        ("soon", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_known_layouts(spark, raw, day, minute):
    assert run(spark, [raw], lambda c: dates.canonical_date(c, False)) == [day]
    assert run(spark, [raw], lambda c: dates.canonical_date(c, True)) == [minute]


def test_free_dates(spark):
    cases = {
        "03/04/2026": ("2026-04-03", "2026-03-04"), "31/03/2026": ("2026-03-31", "2026-03-31"),
        "2026-05-06": ("2026-05-06",) * 2, "2 Mar 2026": ("2026-03-02",) * 2, "Apr 4 2026": ("2026-04-04",) * 2,
        "March 5, 2026": ("2026-03-05",) * 2, "2026.03.04": ("2026-03-04",) * 2, "05.06.26": ("2026-06-05", "2026-05-06"),
        "1/2/76": ("1976-02-01", "1976-01-02"), "2026": ("2026-01-01",) * 2, "Mar 2026": ("2026-03-01",) * 2,
        "05/03/2026 10:30 pm": ("2026-03-05", "2026-05-03"), "not available": (None,) * 2, "12:30": (None,) * 2,
        "31/02/2026": (None,) * 2,
    }
    assert run(spark, list(cases), lambda c: dates.format_free_date(c, True, "YYYY-MM-DD")) == [v[0] for v in cases.values()]
    assert run(spark, list(cases), lambda c: dates.format_free_date(c, False, "YYYY-MM-DD")) == [v[1] for v in cases.values()]


def test_layout_labels(spark):
    cases = {
        "2024-01-05": "iso_date", "2024/01/05": "year_slash_date", "31/12/2024": "slash_date", "12/31/2024": "slash_date",
        "01-13-2024": "dash_date", "2024-01-05T10:00Z": "iso_datetime", "2024-01-05 10:00:01": "iso_datetime",
        "02/30/2024": None, "1600-01-01": None, "2300-01-01": None, "2024-1-5": None, "2024-01-05T25:00": None, "x": None,
    }
    assert run(spark, list(cases), dates.date_layout) == list(cases.values())


def test_numbers(spark):
    values = ["$1,005.75", "12%", " .5 ", "-3", "5.", "abc", "1e3", "NaN", "1.5d", "", None]
    assert run(spark, values, numbers.numeric_text) == ["1005.75", "12", ".5", "-3", None, None, None, None, None, None, None]
    assert run(spark, ["$1,005.755", " 89.00 ", "1e2", "x", " "], numbers.coerce_float) == [1005.76, 89.0, 100.0, None, None]
    assert run(spark, ["1,200", "3.99", "-3.99", "x", None], numbers.coerce_int) == [1200, 3, -3, None, None]
    assert run(spark, ["007", "0.7", "0", "10"], numbers.has_leading_zero) == [True, False, False, False]
    assert run(spark, ["12%%", "12%x"], numbers.is_numeric_looking) == [True, False]


def test_calculated_numbers(spark):
    values = [20.0, 2.5, 1 / 3, 1e20, 123456.789, 1.5e-10, -0.25]
    assert run(spark, values, numbers.format_calculated, "double") == [
        "20", "2.5", "0.333333333333333", "100000000000000000000", "123456.789", "1.5e-10", "-0.25",
    ]


def test_gold_inference(spark):
    values = ["007", "89.0", "-4.50", "", "  ", "x ", "1e3"]
    assert run(spark, values, numbers.infer_gold_text) == ["7", "89", "-4.5", "", "", "x ", "1e3"]


def test_email(spark):
    values = [" a@b.co ", "a b@c.de", "a@b", "@b.co", None]
    assert run(spark, values, text.looks_like_email) == [True, False, False, False, False]


def test_headers():
    assert headers.is_identifier_like("Customer ID") and headers.is_identifier_like("zip_code")
    assert not headers.is_identifier_like("paid")
    assert headers.is_date_like("signup_date") and not headers.is_date_like("update")
    assert headers.messy_positions(["a", " a", "", "Unnamed: 0", "b\tc", "ok"]) == [0, 1, 2, 3, 4]
    assert headers.clean_header(" first\n name ", 0, {"first name"}) == "first name 2"
    assert headers.clean_header("unnamed: 3", 3, set()) == "Column 4"
