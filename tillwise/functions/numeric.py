"""Number parsing, exact money arithmetic, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.text import strip

# Widths leave room for price x quantity x discount without losing a digit:
# decimal(26,6) * decimal(9,6) = decimal(36,12), and a sum of those is decimal(38,12).
MONEY = "decimal(22,6)"
RATE = "decimal(9,6)"
GROSS = "decimal(26,6)"
EXACT = "decimal(36,12)"
RATIO = "decimal(28,8)"
WHOLE = "decimal(18,0)"
MONEY_OUT = "decimal(28,2)"
PERCENT_OUT = "decimal(18,2)"

_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NUMBER_CELL = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)%?$"
_NOT_A_NUMBER = r"(?i)^\s*[+-]?nan\d*\s*$"
_PERCENT = r"%[\s\x{a0}]*$"
_NOISE = r"[ \x{a0}$€£¥]|^\s+|\s+$"
# Such text has none of that noise.
_QUIET = r"\A[!-#%-~]*+\z"
# A separator counts as thousands when the last separator is the other one.
_THOUSANDS = r"\.(?=.*,[^.,]*$)|,(?=.*\.[^.,]*$)"
_WIDE = "decimal(38,10)"


def _localised(value: Column) -> Column:
    """Number text with one decimal point, empty when the cell is not a number.

    Each step rewrites the text once, so the expression stays a short chain. Noise is looked for
    only where there may be some, separators of thousands only where both kinds of separators stand.
    """
    text = F.when(value.rlike(_QUIET), value).otherwise(F.regexp_replace(value, _NOISE, ""))
    both = value.contains(".") & value.contains(",")
    text = F.replace(F.when(both, F.regexp_replace(text, _THOUSANDS, "")).otherwise(text), F.lit(","), F.lit("."))
    return F.regexp_extract(text, _NUMBER_CELL, 1)


def scaled_number(value: Column) -> Column:
    """Localised number text at full scale; a percent sign divides by one hundred.

    Text that is already a plain number skips the rewriting.
    """
    other = _localised(value).try_cast(_WIDE)
    percent = value.contains("%") & value.rlike(_PERCENT)
    return (
        F.when(value.rlike(_PLAIN_NUMBER), strip(value).try_cast(_WIDE))
        .when(percent, other / 100)
        .otherwise(other)
    )


def parse_number(value: Column, data_type: str) -> Column:
    """Localised number text as a decimal; a percent sign divides by one hundred."""
    return scaled_number(value).try_cast(data_type)


def reads_as_number(value: Column) -> Column:
    """Whether text is a number without any rewriting."""
    return value.rlike(_PLAIN_NUMBER)


def is_nan_text(value: Column) -> Column:
    """Text that reads as a missing number rather than as a wrong one."""
    return F.coalesce(value.rlike(_NOT_A_NUMBER), F.lit(False))


def whole_number(number: Column) -> Column:
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def parse_integer(value: Column) -> Column:
    """Localised number text as a whole number, else null."""
    return whole_number(scaled_number(value))


def is_numeric(data_type: str) -> bool:
    return data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or (
        data_type.startswith("decimal")
    )


def strict_number(value: Column, data_type: str, whole: bool = False) -> Column:
    """A finite number exactly as written (no localised forms), optionally whole."""
    if is_numeric(data_type):
        number = value
        if data_type in ("float", "double"):
            finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
            number = F.when(finite, value)
    else:
        text = value.cast("string")
        number = F.when(text.rlike(_PLAIN_NUMBER), strip(text).try_cast("double"))
    return F.when(number == F.floor(number), number) if whole else number


def or_zero(value: Column, data_type: str) -> Column:
    return F.coalesce(value.cast(data_type), F.lit(0).cast(data_type))


def round_money(value: Column) -> Column:
    """Cents, half away from zero, with an empty sum read as zero."""
    return F.coalesce(F.round(value, 2), F.lit(0)).cast(MONEY_OUT)


def _nonzero(value: Column, data_type: str) -> Column:
    return F.when(value != 0, value.cast(data_type))


def _units(amount: Column) -> Column:
    """An amount as a whole number of its twelfth places."""
    return (amount.cast("decimal(38,12)") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)")


def _half_up(top: Column, bottom: Column) -> Column:
    """A quotient of whole decimals as a whole number, rounded once, half away from zero."""
    size = F.abs(bottom)
    nearest = F.call_function("div", F.abs(top) * 2 + size, size * 2)
    return F.when((top < 0) != (bottom < 0), -nearest).otherwise(nearest)


def percentage(numerator: Column, denominator: Column) -> Column:
    """Share of one hundred to two places; zero when there is no denominator."""
    bottom = F.when(denominator != 0, _units(denominator))
    share = _half_up(_units(numerator) * 10_000, bottom)
    return (F.coalesce(share, F.lit(0)).cast("decimal(20,0)") / 100).cast(PERCENT_OUT)


def count_percentage(numerator: Column, denominator: Column) -> Column:
    bottom = _nonzero(denominator, WHOLE)
    ratio = numerator.cast(WHOLE) / bottom
    return F.coalesce(F.round(ratio * 100, 2), F.lit(0)).cast(PERCENT_OUT)


def money_per(total: Column, count: Column) -> Column:
    """An amount a piece in cents; zero when there are no pieces."""
    bottom = F.when(count != 0, count.cast(WHOLE) * F.lit(10**10).cast("decimal(11,0)")).cast("decimal(38,0)")
    cents = _half_up(_units(total), bottom)
    return (F.coalesce(cents, F.lit(0)).cast("decimal(26,0)") / 100).cast(MONEY_OUT)
