"""Scalar expressions against hand values."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tillwise.functions import binding, dates, numeric, text


def evaluate(spark, expression, value, data_type="string"):
    frame = spark.createDataFrame([(value,)], f"v {data_type}")
    return frame.select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (text.squeeze, "  AB-12  ", "AB-12"),
        (text.squeeze, " a \t b ", "a b"),
        (text.clean_text, "  ", None),
        (text.clean_text, " x ", "x"),
        (text.country_name, "great  britain", "United Kingdom"),
        (text.country_name, " españa", "Spain"),
        (text.country_name, "new-land o'neil", "New-Land O'Neil"),
        (text.country_name, "NATION_0", "Nation_0"),
        (text.currency_code, " eur ", "EUR"),
        (text.order_status, "CANCELED", "cancelled"),
        (text.order_status, "in_progress", "pending"),
        (text.order_status, "on_hold", "on-hold"),
        (text.sales_channel, "e-commerce", "website"),
        (text.sales_channel, "pop_up", "pop up"),
        (text.base_name, "/a/b/c.csv", "c.csv"),
        (text.redact_message, "from a@b.co password=x", "from [REDACTED_EMAIL] password=[REDACTED]"),
        (text.redact_message, "row {order_id: 1}", "row [REDACTED_ORDER_RECORD]"),
        (text.redact_failure, "Bearer abc failed", "Bearer [redacted] failed"),
        (text.redact_failure, "", None),
    ],
)
def test_text(spark, function, value, expected):
    assert evaluate(spark, function, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("12.5%", "0.125"), ("0,25", "0.25"),
        ("15%", "0.15"), ("$ 1 000", "1000"), ("1,234", "1.234"), ("1,234,567", None),
        ("1,2.3,4", None), ("many", None), ("  ", None), ("1_000", None), ("1e3", "1000"),
        ("-5.00", "-5"),
    ],
)
def test_localised_numbers(spark, value, expected):
    found = evaluate(spark, lambda c: numeric.parse_number(c, numeric.MONEY), value)
    assert found == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize(
    ("value", "expected"), [("12", 12), ("12.5", None), ("3.0", 3), ("1200%", 12), ("NaN", None)]
)
def test_integers(spark, value, expected):
    assert evaluate(spark, numeric.parse_integer, value) == expected


def test_strict_numbers_do_not_accept_localised_forms(spark):
    def strict(c):
        return numeric.strict_number(c, "string")

    assert evaluate(spark, strict, " 1.5 ") == 1.5
    assert evaluate(spark, strict, "1,5") is None
    assert evaluate(spark, strict, "inf") is None
    infinite = float("inf")
    assert evaluate(spark, lambda c: numeric.strict_number(c, "double"), infinite, "double") is None


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2025-01-31", date(2025, 1, 31)), (" 2025-01-31T10:30 ", date(2025, 1, 31)),
        ("31/01/2025", date(2025, 1, 31)), ("12-25-2025", date(2025, 12, 25)),
        ("05.01.2025", date(2025, 1, 5)), ("2025/1/5", date(2025, 5, 1)),
        ("20250105", date(2025, 1, 5)), ("5 Jan 2025", date(2025, 1, 5)),
        ("Jan 5, 2025", date(2025, 1, 5)), ("2025-02-30", None), ("2025-13-01", None),
        ("31-02-2025", None), ("45689", None), ("not-a-date", None), ("", None),
    ],
)
def test_text_dates(spark, value, expected):
    assert evaluate(spark, dates.parse_text_date, value) == expected


def test_other_dates(spark):
    def serial(c):
        return dates.parse_date(c, "int")

    assert evaluate(spark, serial, 45689, "int") == date(2025, 2, 1)
    assert evaluate(spark, lambda c: dates.parse_text_date(c, True), "01/31/2025") == date(2025, 1, 31)
    assert evaluate(spark, lambda c: dates.parse_text_date(c, serials=True), "45689") == date(2025, 2, 1)
    stamp = datetime(2025, 3, 4, 15, 30)
    assert evaluate(spark, lambda c: dates.parse_date(c, "timestamp"), stamp, "timestamp") == date(
        2025, 3, 4
    )
    assert evaluate(spark, lambda c: dates.parse_month(c, "string"), "2025-01") == "2025-01"
    assert evaluate(spark, lambda c: dates.parse_month(c, "string"), "15/02/2025") == "2025-02"
    assert evaluate(spark, lambda c: dates.parse_month(c, "string"), "2025-13") is None


def test_rounding_is_half_away_from_zero(spark):
    def cents(c):
        return numeric.round_money(c)

    assert evaluate(spark, cents, Decimal("1.005"), "decimal(18,4)") == Decimal("1.01")
    assert evaluate(spark, cents, Decimal("-1.005"), "decimal(18,4)") == Decimal("-1.01")
    assert evaluate(spark, cents, None, "decimal(18,4)") == Decimal("0.00")


def test_labels(spark):
    assert evaluate(spark, text.duration_label, 12.345, "double") == "12.35 s"
    assert evaluate(spark, text.duration_label, 125.4, "double") == "2m 5s"
    assert evaluate(spark, text.duration_label, None, "double") == "Not recorded"
    assert evaluate(spark, text.score_label, 84.9, "double") == "Review recommended"
    settings = {"theme": "x", "API-Token": "y", "logo": "z"}
    assert evaluate(spark, text.safe_settings, settings, "map<string,string>") == {"theme": "x"}


def test_private_and_long_values(spark):
    frame = spark.createDataFrame(
        [("customer_id", "C-1"), ("price", "x" * 130), ("price", None)], "f string, v string"
    )
    shown = [r["s"] for r in frame.select(text.safe_value(F.col("f"), F.col("v")).alias("s")).collect()]
    assert shown == ["[REDACTED]", "x" * 117 + "...", "<NA>"]


@pytest.mark.parametrize(
    "cell,day_first,month_first",
    [
        ("7/9/2031", "2031-09-07", "2031-07-09"), ("27/9/2031", "2031-09-27", None), ("2031/9/27", "2031-09-27", "2031-09-27"),
        (" 27/9/2031", "2031-09-27", None), ("7/9/2031 ", "2031-09-07", "2031-07-09"), ("1/2/7/2031", None, None),
        ("7 /9/2031", None, None), ("07.09.2031", "2031-09-07", "2031-07-09"), ("09-27-2031", "2031-09-27", "2031-09-27"),
        ("2031-09-27", "2031-09-27", "2031-09-27"), ("2031-09-31", None, None), ("2031-09-27 23:59:01", "2031-09-27", "2031-09-27"),
        ("2031-09-27 24:59:01", None, None), ("2031-09-27 soon", None, None), ("20310927", "2031-09-27", "2031-09-27"),
    ],
)
def test_shapes_of_dates(spark, cell, day_first, month_first):
    value = F.lit(cell)
    row = spark.range(1).select(
        dates.parse_text_date(value).cast("string").alias("a"), dates.parse_text_date(value, True).cast("string").alias("b")
    ).first()
    assert (row["a"], row["b"]) == (day_first, month_first)


def test_intermediates_are_computed_once(spark):
    named = binding.let(F.uuid(), lambda x: F.struct(x.alias("a"), x.alias("b")))
    row = spark.range(1).select(named.alias("s")).first()["s"]
    assert row["a"] == row["b"]
    sums = binding.let_all(lambda x, y: x * y + x, x=F.col("id") + 2, y=F.lit(5))
    assert spark.range(1).select(sums.alias("n")).first()["n"] == 12


def test_quotients_are_rounded_once(spark):
    """Near halves, where a rounded quotient rounds to the wrong side, and signs."""
    amounts = ["0", "1", "-1", "0.000049999999", "33.333333333333", "-2.005", "1234567890.123456789012", "5"]
    amounts += ["0.371249999999", "37.124999999999", "100.005", "100.004999999999"]
    bottoms = ["1", "3", "-3", "100", "7.000000000001", "0", "999999.999999"]
    rows = [(Decimal(a), Decimal(b), abs(int(Decimal(b)))) for a in amounts for b in bottoms]
    frame = spark.createDataFrame(rows, "a decimal(38,12), b decimal(38,12), n bigint")
    found = frame.select(
        "*", numeric.percentage(F.col("a"), F.col("b")).alias("share"),
        numeric.money_per(F.col("a"), F.col("n")).alias("each"),
    )

    def exact(top, bottom):
        return (top / bottom).quantize(Decimal("0.01"), ROUND_HALF_UP) if bottom else Decimal(0)

    with localcontext() as context:
        context.prec = 80
        for row in found.collect():
            assert row["share"] == exact(row["a"] * 100, row["b"]), row
            assert row["each"] == exact(row["a"], Decimal(row["n"])), row


def test_cheap_patterns_tell_the_same_texts_apart(spark):
    """The anchored patterns against the searches that they stand for."""
    rng = random.Random(5)
    marks = "aZ09 .,-_%$€£¥\xa0\x85  é'[`{@!~\t\n\x1c\x7f"
    cells = ["", " ", "a", " a ", " a\x85", "new-land  o'neil", "NATION_12", "u.S.", "5\x85", "$ 1,5"]
    cells += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    value = F.col("cell")
    pairs = {
        "usual": (value.rlike(text._USUAL), ~value.rlike(r"[^ -~]")),
        "apart": (value.rlike(text._WORDS_APART), ~value.rlike(r"[^ A-Za-z][A-Za-z]|[^ -~]")),
        "quiet": (
            F.when(value.rlike(numeric._QUIET), F.regexp_replace(value, numeric._NOISE, "") == value),
            F.when(value.rlike(numeric._QUIET), F.lit(True)),
        ),
        "strip": (text.strip(value), F.btrim(value, F.lit(text._SPACES))),
        "clean": (text.clean_text(value), F.nullif(F.btrim(value, F.lit(text._SPACES)), F.lit(""))),
        "blank": (text.is_blank(value), F.coalesce(F.btrim(value, F.lit(text._SPACES)) == "", F.lit(True))),
    }
    frame = spark.createDataFrame([(cell,) for cell in [None, *cells]], "cell string")
    for name, (got, wanted) in pairs.items():
        odd = frame.filter(~got.eqNullSafe(wanted)).collect()
        assert not odd, (name, odd[:3])
