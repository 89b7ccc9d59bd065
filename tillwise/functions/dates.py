"""Date parsing from text, numbers, and native types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.binding import let
from tillwise.functions.numeric import is_numeric
from tillwise.functions.text import strip

_TIME = r"([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?"
_ISO = r"^\s*(\d{4}-\d{2}-\d{2})" + _TIME + r"\s*$"
_SLASH = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
_MONTH, _LATE_DAY = r"(0?[1-9]|1[0-2])", r"(1[3-9]|2\d|3[01])"
_NOT_PLAIN = r"^(?!\d{4}-\d{2}-\d{2}$)"

# Text forms and the order of their parts. A rewritten text starts with "=" (all digits)
# or "@" (month name), which no later form matches. Where day and month can be told apart
# only by size, the second form of a pair catches the days above twelve.
_COMMON_FORMS = (
    (r"^(\d{4})(\d{2})(\d{2})$", "=$1-$2-$3"),
    (r"^(\d{4})-(\d{2})$", "=$1-$2-01"),
    (r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[-, ]+(\d{4})$", "@$3-$2-$1"),
    (r"^([A-Za-z]{3})[a-z]* (\d{1,2}),? (\d{4})$", "@$3-$1-$2"),
)
_DAY_FIRST_FORMS = (
    (r"^(\d{1,2})[-.]" + _MONTH + r"[-.](\d{4})$", "=$3-$2-$1"),
    (r"^" + _MONTH + "[-.]" + _LATE_DAY + r"[-.](\d{4})$", "=$3-$1-$2"),
    (_NOT_PLAIN + r"(\d{4})[-/.](\d{1,2})[-/.]" + _MONTH + "$", "=$1-$3-$2"),
    (_NOT_PLAIN + r"(\d{4})[-/.]" + _MONTH + "[-/.]" + _LATE_DAY + "$", "=$1-$2-$3"),
)
_MONTH_FIRST_FORMS = (
    (r"^" + _MONTH + r"[-.](\d{1,2})[-.](\d{4})$", "=$3-$1-$2"),
    (r"^" + _LATE_DAY + "[-.]" + _MONTH + r"[-.](\d{4})$", "=$3-$2-$1"),
    (_NOT_PLAIN + r"(\d{4})[-/.]" + _MONTH + r"[-/.](\d{1,2})$", "=$1-$2-$3"),
    (_NOT_PLAIN + r"(\d{4})[-/.]" + _LATE_DAY + "[-/.]" + _MONTH + "$", "=$1-$3-$2"),
)


def parse_text_date(value: Column, month_first: bool = False, serials: bool = False) -> Column:
    """Calendar date of the listed text forms; any other text is null.

    The shape of a cell, its length and the marks at fixed places, chooses its parser: full ISO,
    slash and dotted dates are cut at those places, other cells go by patterns and rewriting.
    ``serials`` also reads whole or fractional numbers as spreadsheet day counts. It is off by
    default because digits in a text cell are not a date.
    """
    parsed = _shaped(value, month_first)
    if serials:
        text = strip(value)
        number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
        parsed = F.coalesce(parse_serial(number), parsed)
    return parsed


def _shaped(cell: Column, month_first: bool) -> Column:
    """Cells by the places of their marks; those of other shapes by patterns."""
    def at(place: int, size: int = 1) -> Column:
        return F.substring(cell, place, size)

    def joined(month: Column, day: Column) -> Column:
        # A date may end in a blank when it is cast, so the day has to end in a digit.
        text = F.concat(F.right(cell, F.lit(4)), F.lit("-"), month, F.lit("-"), day)
        return F.when(F.right(day, F.lit(1)).between("0", "9"), text.try_cast("date"))

    def slashed(first: Column, second: Column) -> Column:
        usual = joined(first, second) if month_first else joined(second, first)
        whole = size == F.length(first) + F.length(second) + 6
        return F.when(whole & F.length(first).between(1, 2) & F.length(second).between(1, 2), usual)

    def dotted(first: Column, second: Column) -> Column:
        month, day = (first, second) if month_first else (second, first)
        late = day.between("01", "12") & month.between("13", "31")
        return F.when(month.between("01", "12"), joined(month, day)).when(late, joined(day, month))

    size = F.length(cell)
    head = F.substring_index(cell, "/", 2)
    parts = F.substring_index(head, "/", 1), F.substring_index(head, "/", -1)
    iso, ten = (at(5) == "-") & (at(8) == "-"), size == 10
    digit_first = at(1).between("0", "9")
    slashes = size.between(8, 10) & digit_first & (at(-5) == "/") & ((at(2) == "/") | (at(3) == "/"))
    dots = ten & digit_first & at(3).isin("-", ".") & at(6).isin("-", ".")
    return (
        F.when(ten & iso, cell.try_cast("date"))
        .when(slashes, slashed(*parts))
        .when(dots, dotted(at(1, 2), at(4, 2)))
        .when((size > 10) & iso, F.when(cell.rlike(_ISO), at(1, 10).try_cast("date")))
        .otherwise(let(cell, lambda text: _patterned(text, month_first)))
    )


def _patterned(value: Column, month_first: bool) -> Column:
    iso = F.regexp_extract(value, _ISO, 1).try_cast("date")
    slash = F.regexp_replace(value, _SLASH, "$3-$1-$2" if month_first else "$3-$2-$1")
    return (
        F.when(value.rlike(_ISO), iso)
        .when(value.rlike(_SLASH), slash.try_cast("date"))
        .otherwise(_rewritten(strip(value), month_first))
    )


def _rewritten(text: Column, month_first: bool) -> Column:
    ordered = text
    for pattern, parts in _COMMON_FORMS + (_MONTH_FIRST_FORMS if month_first else _DAY_FIRST_FORMS):
        ordered = F.regexp_replace(ordered, pattern, parts)
    digits = F.when(ordered.startswith("="), F.substring(ordered, 2, 10).try_cast("date"))
    named = F.try_to_timestamp(F.substring(ordered, 2, 11), F.lit("yyyy-MMM-d")).cast("date")
    return F.when(text.rlike("[A-Za-z]{3}"), F.when(ordered.startswith("@"), named)).otherwise(digits)


def parse_serial(value: Column) -> Column:
    """Spreadsheet day count (day 0 is 1899-12-30) as a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).try_cast("int"))


def parse_date(
    value: Column, data_type: str, month_first: bool = False, serials: bool = False
) -> Column:
    if data_type.startswith("timestamp") or data_type == "date":
        return value.cast("date")
    if is_numeric(data_type):
        return parse_serial(value)
    return parse_text_date(value, month_first, serials)


def parse_month(value: Column, data_type: str, month_first: bool = False) -> Column:
    """``yyyy-MM`` of a month or date cell."""
    if data_type != "string":
        return F.date_format(parse_date(value, data_type), "yyyy-MM")
    text = strip(value)
    day = F.when(
        F.length(text) == 7, parse_text_date(F.concat(text, F.lit("-01")))
    ).otherwise(parse_text_date(text, month_first))
    return F.date_format(day, "yyyy-MM")
