"""Personal data replaced by format-preserving pseudonyms, as expressions only.

Values are found by one pattern and validated: card numbers (Luhn), IBANs (mod 97), US social security numbers (number ranges), IPv4 addresses
(octets), phone numbers (8 to 15 digits), dates of the calendar, and e-mail addresses. Each valid value goes through a keyed Feistel network whose
symbols keep their own ranges, so the pseudonym is a valid value of the same kind and layout, different values stay different, and equal ones equal
in every document. Check digits are computed anew. Values that fail their test stay as they are.

A phone number with a country code and the same number in a national layout are different values. Not looked for: IPv6 addresses, dates with one-digit days or
months (3/5/2024), and bare runs of ten digits without separators.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8

# The layouts of what is looked for. A run is entered at its start only, so a long run is scanned once. Every repeated group has a bound
# (a domain has 127 labels at most), since the engine recurses once for each repetition of a group.
_BETWEEN = r"[ .*#%&$!\-]{0,5}"
# Single separators of phone numbers; two kinds of no-break space are among them.
_GAP = "[ .\\-/\u00a0\u202f]"
# National phone numbers: three, three and four digits; French pairs; two Spanish and two German layouts.
_NATIONAL = "|".join([
    r"[0-9]{3}[\-. ][0-9]{3}[\-. ][0-9]{4}",
    rf"0[1-9](?:{_GAP}[0-9]{{2}}){{4}}",
    rf"[6-9][0-9]{{2}}(?:{_GAP}[0-9]{{2}}){{3}}",
    rf"[89][0-9]{_GAP}[0-9]{{3}}(?:{_GAP}[0-9]{{2}}){{2}}",
    r"0[1-9][0-9]{1,3}[ /\-][0-9]{5,8}",
    r"0[1-9][0-9]{1,3}[ /\-][0-9]{2,4}[ \-][0-9]{2,5}",
])
_ABROAD = rf"\+[0-9]{{1,3}}{_BETWEEN}\(?[0-9]{{2,4}}\)?{_BETWEEN}[0-9]{{3,4}}{_BETWEEN}[0-9]{{3,4}}"
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,24}",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    r"(?<![0-9])[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}(?![0-9])",
    r"(?<![0-9])[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}(?![0-9])",
    r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    r"(?<![0-9\-/.])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])",
    r"(?<![0-9\-/.])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    r"(?<![0-9\-/.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9.])",
    # After +1 ten digits and after +33 and +34 nine; others are taken with a short last group, in any single-spaced grouping, up to 15 digits.
    rf"(?<![0-9+])\+1{_BETWEEN}\(?[0-9]{{3}}\)?{_BETWEEN}[0-9]{{3}}{_BETWEEN}[0-9]{{4}}(?![0-9])",
    rf"(?<![0-9+])\+3[34](?:{_GAP}?[0-9]){{9}}(?![0-9])",
    rf"(?<![0-9+]){_ABROAD}(?![0-9]|{_GAP}[0-9]{{1,3}}(?![0-9]))",
    rf"(?<![0-9+])\+[0-9](?:{_GAP}?\(?[0-9]\)?){{7,14}}(?![0-9])",
    rf"(?<![0-9+]){_ABROAD}(?![0-9])",
    r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}(?![0-9])",
    rf"(?<![0-9.\-])(?:{_NATIONAL})(?![0-9]|[.\-][0-9])",
])
# Country codes of one digit, of two digits, and all others of three.
CALLING_CODE = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: The session setting that holds the key.
KEY_SETTING = "spark.sluicebox.pii.key"
# Days are permuted in blocks of 2^16 that begin here: the first from it on lasts to 2099.
FIRST_DAY = "1920-08-01"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, ranges: Column, key: str, kind: str) -> Column:
    """The numbers ``values``, each below its range, permuted under the key: the halves of the list take turns in shifting each other."""
    # Everything a round needs is in the state: a lambda evaluates what it names from outside anew for each element, which would make long values quadratic.
    half = (F.size(values) / 2).cast("int")
    parts = {"a": F.slice(values, 1, half), "b": F.slice(values, half + 1, F.size(values)), "of_a": F.slice(ranges, 1, half), "of_b": F.slice(ranges, half + 1, F.size(ranges))}

    def shifted(part: Column, limit: Column, other: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat_ws(",", F.lit(f"{key}/{kind}"), turn.cast("string"), other.cast("array<string>")).cast("binary"), 512)

        def shift(h: Column) -> Column:
            number = lambda i: F.conv(F.substring(h, F.pmod(i, F.lit(25)) * 5 + 1, F.lit(5)), 16, 10).cast("int")
            return F.transform(part, lambda v, i: (v + number(i)) % F.element_at(limit, i + 1))

        return bound(digest, shift)

    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(*[part.alias(name) for name, part in parts.items()]),
        lambda s, turn: F.struct(
            F.when(turn % 2 == 1, shifted(s["a"], s["of_a"], s["b"], turn)).otherwise(s["a"]).alias("a"),
            F.when(turn % 2 == 0, shifted(s["b"], s["of_b"], s["a"], turn)).otherwise(s["b"]).alias("b"),
            s["of_a"].alias("of_a"), s["of_b"].alias("of_b"),
        ),
    )
    return bound(done, lambda s: F.concat(s["a"], s["b"]))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted(text: Column, key: str, kind: str) -> Column:
    """Digits, small and capital letters shifted within their kind; other characters stay."""

    def of(chars: Column) -> Column:
        low = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c))
        size = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
        values = feistel(F.transform(chars, lambda c: F.ascii(c) - low(c)), F.transform(chars, size), key, kind)
        return F.array_join(F.zip_with(chars, values, lambda c, v: F.char(low(c) + v)), "")

    return bound(_characters(text), of)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced in order."""
    empty = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    step = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["s"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("s"), (s["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["n"].alias("n")))
    return F.aggregate(_characters(layout), empty, step, lambda s: s["s"])


def luhn_sum(digits: Column, last_counts_double: bool) -> Column:
    values = F.transform(_characters(F.reverse(digits)), lambda c: c.cast("int"))
    doubled = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
    odd = 0 if last_counts_double else 1
    return F.aggregate(F.transform(values, lambda v, i: F.when(i % 2 == odd, doubled(v)).otherwise(v)), F.lit(0), lambda s, v: s + v)


def _mod97(text: Column) -> Column:
    number = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(_characters(text), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97)


def _card(value: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = bound(body, lambda b: F.concat(b, ((10 - luhn_sum(b, True) % 10) % 10).cast("string")))
        return F.when((luhn_sum(digits, False) % 10 == 0) & F.length(digits).between(13, 19) & digits.rlike("[1-9]"), bound(whole, lambda w: _laid_out(value, w)))

    return F.coalesce(bound(_digits(value), of), value)


def _iban(value: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def renewed(body: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, body)

        spread = lambda new: F.when(value.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
        valid = (_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
        return F.when(valid, bound(bound(_permuted(rest, key, "iban"), renewed), spread))

    return F.coalesce(bound(F.regexp_replace(value, " ", ""), of), value)


def _address(value: Column, key: str) -> Column:
    def of(octets: Column) -> Column:
        moved = feistel(octets, F.transform(octets, lambda _: F.lit(256)), key, "ipv4")
        return F.when(F.forall(octets, lambda o: o < 256), F.array_join(moved.cast("array<string>"), "."))

    return F.coalesce(bound(F.split(value, r"\.").cast("array<int>"), of), value)


def _security_number(value: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def of(parts: Column) -> Column:
        area, group, serial = (F.element_at(parts, i) for i in (1, 2, 3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        numbers = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
        back = lambda n: F.format_string(
            "%03d-%02d-%04d", F.element_at(n, 1) + F.when(F.element_at(n, 1) >= 665, 2).otherwise(1), F.element_at(n, 2) + 1, F.element_at(n, 3) + 1
        )
        moved = bound(numbers, lambda n: feistel(n, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"))
        return F.when(valid, bound(moved, back))

    return F.coalesce(bound(F.split(value, "-").cast("array<int>"), of), value)


def _date(value: Column, layout: str, key: str) -> Column:
    def of(day: Column) -> Column:
        place = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        inner = F.pmod(place, F.lit(65536))
        moved = bound(F.array((inner / 256).cast("int"), inner % 256), lambda n: feistel(n, F.array(F.lit(256), F.lit(256)), key, "date"))
        new = bound(moved, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), place - inner + F.element_at(n, 1) * 256 + F.element_at(n, 2)))
        return F.when(F.year(day).between(1800, 2200), F.date_format(new, layout))

    return F.coalesce(bound(F.try_to_timestamp(value, F.lit(layout)).cast("date"), of), value)


def _phone(value: Column, key: str) -> Column:
    """The country code after + stays, read from the digits, so that a number has one pseudonym in every layout."""

    def of(digits: Column) -> Column:
        code = F.when(value.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise("")
        moved = bound(code, lambda c: F.concat(c, _permuted(F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")))
        return F.when(F.length(digits).between(8, 15), _laid_out(value, moved)).otherwise(value)

    return bound(_digits(value), of)


def _email(value: Column, key: str) -> Column:
    """All but the last label of the domain, in lower case."""
    name = F.regexp_replace(value, r"\.[A-Za-z]+$", "")
    return F.concat(_permuted(F.lower(name), key, "email"), F.lower(F.regexp_extract(value, r"\.[A-Za-z]+$", 0)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself where it fails the test of its kind."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike("^[A-Z]"), _iban(value, key))
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(value, "yyyy-MM-dd", key))
        .when(value.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.when(F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNotNull(), _date(value, "dd/MM/yyyy", key)).otherwise(_date(value, "MM/dd/yyyy", key)))
        .when(value.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), _date(value, "dd.MM.yyyy", key))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _security_number(value, key))
        .when(value.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), _address(value, key))
        .when(value.rlike(rf"^\+|^\(|^(?:{_NATIONAL})$"), _phone(value, key))
        .otherwise(_card(value, key))
    )


def session_key(spark: SparkSession) -> str:
    """The key in ``KEY_SETTING``. Where that is unset, a random one is drawn and set there: one session's pseudonyms agree, and nobody can reverse them later."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with personal data in the text replaced, and how many values were.

    Every other column and every row stays. A null text stays null with a count of 0. ``count_col`` replaces a column of that name.
    """
    text = F.col(f"`{text_col}`")

    def of(found: Column) -> Column:
        new = F.transform(found, lambda v: pseudonym(v, key))
        gaps = F.split(text, PATTERN, -1)

        def joined(new: Column) -> Column:
            parts = F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, v: F.concat(g, v))
            changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
            return F.struct(F.array_join(parts, "").alias("text"), changed.alias("n"))

        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).alias("n"))).otherwise(bound(new, joined))

    # Every layout has a digit or an @, and most texts have neither.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    done = docs.withColumn("__done", bound(found, of))
    out = [F.coalesce("__done.text", text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return done.select(*out, *([F.coalesce("__done.n", F.lit(0)).alias(count_col)] if count_col else []))
