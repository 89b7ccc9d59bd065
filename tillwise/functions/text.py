"""Text normalisation, redaction, and display labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.binding import let

# Spellings and the canonical name each one stands for.
COUNTRY_NAMES = {
    "Cyprus": ["cy", "cyprus"],
    "Germany": ["de", "deutschland", "germany"],
    "Spain": ["es", "españa", "spain"],
    "France": ["fr", "france"],
    "Greece": ["gr", "greece", "hellas"],
    "Italy": ["it", "italia", "italy"],
    "United Kingdom": ["uk", "u.k.", "great britain", "united kingdom"],
    "United States": ["us", "u.s.", "usa", "united states of america", "united states"],
}
ORDER_STATUSES = {
    "completed": ["complete", "completed", "paid"],
    "cancelled": ["cancelled", "canceled"],
    "pending": ["pending", "in progress", "processing"],
    "refunded": ["refunded"],
    "returned": ["returned"],
}
SALES_CHANNELS = {
    "website": ["web", "online", "ecommerce", "e-commerce", "website"],
    "amazon": ["amazon"],
    "marketplace": ["marketplace"],
    "retail": ["retail", "store"],
    "wholesale": ["wholesale"],
}
# Key fragments that mark a setting or a field as private.
SECRET_KEY_PARTS = (
    "api_key", "apikey", "api_token", "token", "secret", "password", "credential",
    "authorization", "private_key", "database_url", "connection_string", "dsn",
)
DROPPED_SETTING_KEYS = ("logo", "content")
PRIVATE_FIELD_PARTS = ("customer", "email", "token", "secret", "password")
# Text patterns removed from messages.
ORDER_RECORD_PATTERN = r"(?i)\{[^{}]*\b(?:order_id|order_number)\b[^{}]*\}"
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
MESSAGE_SECRET_PATTERN = (
    r"(?i)\b(api[_ -]?token|access[_ -]?token|authorization|password|secret)\b"
    r"\s*([:=])\s*([^\s,;]+)"
)
FAILURE_SECRET_PATTERN = (
    r"(?i)\b(api[_ -]?token|authorization|bearer|password|secret)\b(\s*[:=]?\s*)([^\s,;]+)"
)

# White space as Unicode defines it; the regex class \s covers ASCII only.
_SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
_SPACE = (
    r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Text without these, and without white space at its ends, needs no rewriting.
_UNTIDY = r"[^ -~]|  "
# Such text has no white space but blanks. Anchored loops over a class are the cheapest patterns.
_USUAL = r"\A[ -~]*+\z"
# Such text has no letter right after another mark than a blank, so words begin after blanks only.
_WORDS_APART = r"\A[A-Za-z ]*+(?:[!-@\[-`{-~]++(?![A-Za-z])[A-Za-z ]*+)*+\z"


def strip(value: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks.

    Printable ASCII, the usual case, holds no white space but blanks.
    """
    tidy = F.when(_is_bare(value), value).when(value.rlike(_USUAL), F.trim(value))
    return tidy.otherwise(let(value, _stripped))


def _is_bare(text: Column) -> Column:
    """Whether text begins and ends with a printable mark of ASCII."""
    return F.left(text, F.lit(1)).between("!", "~") & F.right(text, F.lit(1)).between("!", "~")


def _stripped(text: Column) -> Column:
    return F.when(_is_bare(text), text).otherwise(F.btrim(text, F.lit(_SPACES)))


def clean_text(value: Column) -> Column:
    """Trimmed text; blank text becomes null."""
    bare = F.trim(value)
    other = let(let(value, _stripped), lambda text: F.when(text != "", text))
    tidy = F.when(_is_bare(value), value).when(value.rlike(_USUAL), F.when(bare != "", bare))
    return tidy.otherwise(other)


def squeeze(value: Column) -> Column:
    """Trimmed text with each inner run of white space reduced to one blank."""
    return _with_squeezed(value, lambda text: text)


def _with_squeezed(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body of squeezed text.

    Tidy text needs only its outer blanks removed. It takes built-in functions alone, which are
    compiled; a lambda is interpreted for every row, so only other text goes through one.
    """
    bare = F.trim(value)
    tidy = value.rlike(_USUAL) & ~bare.contains("  ") & (bare != "")
    other = let(let(value, _stripped), lambda text: let(_squeezed(text), body))
    return F.when(tidy, body(bare)).otherwise(other)


def _squeezed(text: Column) -> Column:
    runs = F.when(text.rlike(_UNTIDY), F.regexp_replace(text, f"{_SPACE}+", " "))
    return F.when(text != "", F.coalesce(runs, text))


def title_case(value: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    Where letters follow only blanks and letters, that is what the built-in function does; a
    single word of ASCII is cheaper without its search for word breaks.
    """
    words = F.split(F.lower(value), r"(?<=[^\p{L}])(?=\p{L})")
    capital = F.transform(
        words, lambda word: F.concat(F.upper(word.substr(1, 1)), F.substring(word, 2, 2147483647))
    )
    word = F.concat(F.upper(F.left(value, F.lit(1))), F.lower(F.substring(value, 2, 2147483647)))
    return (
        F.when(~value.rlike(_WORDS_APART), F.array_join(capital, ""))
        .when(~value.contains(" "), word)
        .otherwise(F.initcap(value))
    )


def _lookup(key: Column, names: Mapping[str, Iterable[str]]) -> Column:
    pairs = [F.lit(part) for name, keys in names.items() for k in keys for part in (k, name)]
    return F.try_element_at(F.create_map(*pairs), key)


def country_name(value: Column) -> Column:
    known = lambda text: F.coalesce(_lookup(F.lower(text), COUNTRY_NAMES), title_case(text))
    return _with_squeezed(value, known)


def currency_code(value: Column) -> Column:
    return F.upper(clean_text(value))


def order_status(value: Column) -> Column:
    spelled = lambda text: _lookup(F.replace(text, F.lit("-"), F.lit(" ")), ORDER_STATUSES)
    marked = F.replace(F.lower(value), F.lit("_"), F.lit("-"))
    return _with_squeezed(marked, lambda text: F.coalesce(spelled(text), text))


def sales_channel(value: Column) -> Column:
    spaced = F.replace(F.lower(value), F.lit("_"), F.lit(" "))
    return _with_squeezed(spaced, lambda text: F.coalesce(_lookup(text, SALES_CHANNELS), text))


def is_blank(value: Column) -> Column:
    """Null or white space only."""
    text = value.cast("string")
    begun = F.left(text, F.lit(1)).between("!", "~")
    return F.when(begun, F.lit(False)).otherwise(F.coalesce(strip(text) == "", F.lit(True)))


def plain(value: Column, data_type: str) -> Column:
    """Text of a cell, without the padding zeros of a fixed-scale decimal."""
    text = value.cast("string")
    if data_type.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return text


def redact_message(value: Column) -> Column:
    """Remove order records, e-mail addresses, and named secrets from a message."""
    text = F.regexp_replace(value, ORDER_RECORD_PATTERN, "[REDACTED_ORDER_RECORD]")
    text = F.regexp_replace(text, EMAIL_PATTERN, "[REDACTED_EMAIL]")
    return F.regexp_replace(text, MESSAGE_SECRET_PATTERN, "$1$2[REDACTED]")


def redact_failure(value: Column) -> Column:
    """Remove inline credentials from a stored failure text; empty text becomes null."""
    text = F.regexp_replace(value, FAILURE_SECRET_PATTERN, "$1$2[redacted]")
    return F.when(value != "", text)


def private_field(field: Column) -> Column:
    return F.coalesce(field.rlike("(?i)" + "|".join(PRIVATE_FIELD_PARTS)), F.lit(False))


def safe_value(field: Column, value: Column, limit: int | None = 120) -> Column:
    """Issue value for display: private fields hidden, long text cut."""
    text = F.coalesce(value, F.lit("<NA>"))
    if limit is not None:
        cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
        text = F.when(F.length(text) > limit, cut).otherwise(text)
    return F.when(private_field(field), F.lit("[REDACTED]")).otherwise(text)


def safe_settings(settings: Column) -> Column:
    """Drop private keys from a settings map."""
    private = "|".join(SECRET_KEY_PARTS)

    def keep(key: Column, _value: Column) -> Column:
        name = F.translate(F.lower(key), "- ", "__")
        return ~name.rlike(private) & ~F.lower(key).isin(*DROPPED_SETTING_KEYS)

    return F.map_filter(settings, keep)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def duration_label(seconds: Column) -> Column:
    """Seconds below a minute to two places, else whole minutes and seconds."""
    rest = F.bround(seconds - 60 * F.floor(seconds / 60), 0).cast("int")
    return (
        F.when(seconds.isNull(), F.lit("Not recorded"))
        .when(seconds < 60, F.format_string("%.2f s", seconds))
        .otherwise(F.format_string("%dm %ds", F.floor(seconds / 60).cast("int"), rest))
    )


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 95, F.lit("Excellent data health"))
        .when(score >= 85, F.lit("Good data health"))
        .when(score >= 70, F.lit("Review recommended"))
        .otherwise(F.lit("Significant issues require attention"))
    )


def nested_text(value: Column) -> Column:
    """JSON text of a map, array, or struct for a flat report column."""
    return F.to_json(value)
