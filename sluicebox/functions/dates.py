"""Date expressions over text cells (FN-6, FN-7, FN-8, FN-10).

All layouts of a family sit in one pattern: a single ``regexp_replace`` rewrites whichever
fits to ISO-like text (groups of the others are empty), and ``try_cast`` decides whether it
is a real date. A per-layout ``try_to_timestamp`` would throw and catch a Java exception for
every layout that does not fit, and nested CASE branches would strip the cell again in each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Anything that fits no layout is rewritten to text no cast accepts.
_ELSE = r"|^[\s\S]*$"

# --- FN-6: layouts of the rule packs -------------------------------------------------
# The accepted layouts, one line each, with the groups that hold year, month,
# day and time.
_KNOWN = (
    r"^(?:"
    r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[T ]([0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]{1,6})?)?)(?:Z|[+-][0-9]{2}:[0-9]{2})?)?|"
    r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?:[T ]([0-9]{1,2}:[0-9]{1,2}))?|"
    r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?: +([0-9]{1,2}:[0-9]{1,2}))?|"
    r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})(?: +([0-9]{1,2}:[0-9]{1,2}))?|"
    r"([0-9]{4})([0-9]{2})([0-9]{2})"
    r")$" + _ELSE
)
# Year groups 1 5 11 15 17; month groups 2 6 9 14 18; day groups 3 7 10 13 19; time groups 4 8 12 16.
_KNOWN_ISO = "$1$5$11$15$17-$2$6$9$14$18-$3$7$10$13$19 $4$8$12$16"
_TWELVE_HOUR = r"(?i)^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) +(0?[1-9]|1[0-2]):([0-9]{1,2}) +([AP])M$"


def _twelve_hour(s: Column) -> Column:
    hour = F.regexp_extract(s, _TWELVE_HOUR, 4).try_cast("int") % 12 + F.when(
        F.upper(F.regexp_extract(s, _TWELVE_HOUR, 6)) == "P", 12
    ).otherwise(0)
    day = F.regexp_replace(s, _TWELVE_HOUR, "$3-$1-$2 ")
    stamp = F.concat(day, hour.cast("string"), F.lit(":"), F.regexp_extract(s, _TWELVE_HOUR, 5))
    return F.when(s.rlike(_TWELVE_HOUR), stamp.try_cast("timestamp_ntz"))


def parse_date_like(c: Column) -> Column:
    """FN-6: the wall-clock timestamp of a cell in a known layout, else null; an offset is dropped."""
    s = strip(c)
    return F.coalesce(F.regexp_replace(s, _KNOWN, _KNOWN_ISO).try_cast("timestamp_ntz"), _twelve_hour(s))


def canonical_date(c: Column, include_time: bool) -> Column:
    """FN-7: yyyy-MM-dd, or yyyy-MM-ddTHH:mm with time; null when not a known layout."""
    return F.date_format(parse_date_like(c), "yyyy-MM-dd'T'HH:mm" if include_time else "yyyy-MM-dd")


def is_canonical_date(c: Column, include_time: bool) -> Column:
    """FN-7: the stripped text already equals its own canonical form; null is not."""
    return F.coalesce(canonical_date(c, include_time) == strip(c), F.lit(False))


# --- FN-8: free-form dates with a day/month preference ---------------------------------
# Output formats on offer.
OUTPUT_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "DD/MM/YYYY": "dd/MM/yyyy",
}

_TIME_TAIL = (
    r"(?:[Tt ]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?: ?[AaPp][Mm])?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
_FREE_ISO = (
    r"^(?:([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})|([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})|"
    r"([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})|([0-9]{4})([0-9]{2})([0-9]{2}))" + _TIME_TAIL + _ELSE
)
_FREE_ISO_TEXT = "$1$4$7$10-$2$5$8$11-$3$6$9$12"
_NUMERIC = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})" + _TIME_TAIL + _ELSE
_SHORT_YEAR = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2})$"
# English month names; the first three letters decide.
_MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Year groups 3 6 7 11, month-name groups 2 4 8 10, day groups 1 5 9; the last layout has no day.
_NAMED = (
    r"^(?:"
    rf"([0-9]{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH_NAME},?[ -]([0-9]{{4}})|"
    rf"{_MONTH_NAME}[ -]([0-9]{{1,2}})(?:st|nd|rd|th)?(?:, ?|[ -])([0-9]{{4}})|"
    rf"([0-9]{{4}})[ -]{_MONTH_NAME}[ -]([0-9]{{1,2}})|"
    rf"{_MONTH_NAME},?[ -]([0-9]{{4}})"
    r")$"
)
_YEAR_ONLY = r"^[0-9]{4}$"


def _named_date(s: Column) -> Column:
    parts = F.regexp_replace(s, _NAMED, "$3$6$7$11 $2$4$8$10 $1$5$9")
    name = F.substring(F.split_part(parts, F.lit(" "), F.lit(2)), 1, 3)
    month = F.floor((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("string")
    day = F.split_part(parts, F.lit(" "), F.lit(3))
    day = F.when(day == "", "1").otherwise(day)
    return F.concat_ws("-", F.split_part(parts, F.lit(" "), F.lit(1)), month, day).try_cast("date")


def parse_free_date(c: Column, day_first: bool, two_digit_last_year: int = 2075) -> Column:
    """FN-8: the date of a cell in a free layout, else null.

    Year-first texts never swap day and month. Other numeric texts try the preferred
    order and then the other one. A two-digit year means the century ending at
    ``two_digit_last_year``. Texts whose meaning depends on today's date stay unresolved.
    """
    s = strip(c)
    orders = ["$3-$2-$1", "$3-$1-$2"] if day_first else ["$3-$1-$2", "$3-$2-$1"]
    numeric = [F.regexp_replace(s, _NUMERIC, order).try_cast("date") for order in orders]

    century = two_digit_last_year - two_digit_last_year % 100
    short = F.regexp_extract(s, _SHORT_YEAR, 3).try_cast("int") + century
    year = F.when(short > two_digit_last_year, short - 100).otherwise(short).cast("string")
    short_dates = [
        F.concat(year, F.regexp_replace(s, _SHORT_YEAR, order.removeprefix("$3"))).try_cast("date") for order in orders
    ]
    lowered = F.lower(F.regexp_replace(s, _TIME_TAIL, ""))
    return F.coalesce(
        F.regexp_replace(s, _FREE_ISO, _FREE_ISO_TEXT).try_cast("date"),
        *numeric,
        F.when(s.rlike(_SHORT_YEAR), F.coalesce(*short_dates))
        .when(s.rlike(_YEAR_ONLY), F.concat(s, F.lit("-1-1")).try_cast("date"))
        .when(lowered.rlike(_NAMED), _named_date(lowered)),
    )


def format_free_date(c: Column, day_first: bool, output_format: str, two_digit_last_year: int = 2075) -> Column:
    if output_format not in OUTPUT_FORMATS:
        raise ValueError(f"Unknown output format: {output_format}")
    return F.date_format(parse_free_date(c, day_first, two_digit_last_year), OUTPUT_FORMATS[output_format])


# --- FN-10: layout labels ---------------------------------------------------------------
# The labels and the shapes they stand for.
LAYOUTS = {
    "iso_date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "year_slash_date": r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    "slash_date": r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$",
    "dash_date": r"^([0-9]{2})-([0-9]{2})-([0-9]{4})$",
    "iso_datetime": (
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?"
        r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?$"
    ),
}
# Fixed value: years a label may have.
_LABEL_YEARS = (1677, 2262)


def date_layout(c: Column, stripped: bool = False) -> Column:
    """FN-10: which of the five layouts a cell is a real date in, else null.

    ``stripped`` says the cell is known to have no outer whitespace.
    """
    s = c if stripped else strip(c)

    def in_range(year: Column) -> Column:
        y = year.try_cast("int")
        return (y > _LABEL_YEARS[0]) & (y < _LABEL_YEARS[1])

    def either_order(pattern: str) -> Column:
        straight = F.regexp_replace(s, pattern, "$3-$1-$2").try_cast("date")
        swapped = F.regexp_replace(s, pattern, "$3-$2-$1").try_cast("date")
        return F.coalesce(straight, swapped).isNotNull() & in_range(F.substring(s, 7, 4))

    year = F.substring(s, 1, 4)
    real = {
        "iso_date": s.try_cast("date").isNotNull() & in_range(year),
        "year_slash_date": F.translate(s, "/", "-").try_cast("date").isNotNull() & in_range(year),
        "slash_date": either_order(LAYOUTS["slash_date"]),
        "dash_date": either_order(LAYOUTS["dash_date"]),
        "iso_datetime": F.regexp_replace(s, r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", "").try_cast("timestamp_ntz").isNotNull()
        & in_range(year),
    }
    label = F.lit(None).cast("string")
    for name in reversed(LAYOUTS):
        label = F.when(s.rlike(LAYOUTS[name]), F.when(real[name], F.lit(name))).otherwise(label)
    # All layouts are 10 to 25 characters long, so most text is settled without a pattern.
    return F.when(F.length(s).between(10, 25), label)
