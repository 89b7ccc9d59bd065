"""Cleaning of one canonical dataset in a single projection plus the duplicate check."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.errors import ConfigError
from tillwise.functions import text
from tillwise.functions.dates import parse_date, parse_month
from tillwise.functions.numeric import (
    MONEY,
    is_nan_text,
    is_numeric,
    parse_number,
    reads_as_number,
    scaled_number,
    strict_number,
    whole_number,
)
from tillwise.operators.duplicates import KEEP_FIRST, flag_duplicates
from tillwise.operators.issues import (
    CLEANING,
    blocks,
    col,
    issue,
    no_issues,
    raised,
)
from tillwise.sources.schemas import (
    ORDERS,
    RETURNS,
    SHARED_CONVERTERS,
    TRACE_COLUMNS,
    schema_of,
)
from tillwise.staging import Stage

_TEXT_CONVERTERS = {
    "id": text.squeeze,
    "text": text.clean_text,
    "country": text.country_name,
    "status": text.order_status,
    "channel": text.sales_channel,
}
# Converters that may reject a value, in the order their issues are listed.
_CHECKED = ("integer", "number", "date", "month")


@dataclass(frozen=True)
class CleaningOptions:
    """Currency, duplicate, and date policies.

    Rates are units of the default currency per unit of the named one.
    """

    default_currency: str = "USD"
    exchange_rates: Mapping[str, float | str | Decimal] = field(default_factory=dict)
    duplicate_strategy: str = KEEP_FIRST
    month_first: bool = False
    excel_serials: bool = False

    @property
    def currency(self) -> str:
        code = self.default_currency.strip().upper()
        if not code:
            raise ConfigError("The default currency must not be empty.")
        return code

    @property
    def rates(self) -> dict[str, Decimal]:
        rates = {
            code.strip().upper(): Decimal(str(rate)) for code, rate in self.exchange_rates.items()
        }
        rates[self.currency] = Decimal(1)
        if any(rate <= 0 for rate in rates.values()):
            raise ConfigError("Exchange rates must be greater than zero.")
        return rates

    def rate_of(self, code: Column) -> Column:
        pairs = [
            part
            for name, rate in self.rates.items()
            for part in (F.lit(name), F.lit(rate).cast("decimal(18,8)"))
        ]
        return F.try_element_at(F.create_map(*pairs), code)


def convert_currency(amount: Column, code: Column, options: CleaningOptions) -> Column:
    """Amount in the default currency, null when no rate is known for the code."""
    known = F.coalesce(text.currency_code(code), F.lit(options.currency))
    return (amount * options.rate_of(known)).cast(MONEY)


def default_currency(orders: DataFrame, given: str | None = None) -> str:
    """Most frequent currency code of the orders; the first one seen wins a tie."""
    if given is not None:
        return given
    if "currency" not in orders.columns:
        return "USD"
    code = text.currency_code(F.col("currency"))
    ranked = (
        orders.select(code.alias("code"), "source_file", "source_row_number")
        .filter("code is not null")
        .groupBy("code")
        .agg(
            F.count("*").alias("uses"),
            F.min(F.struct("source_file", "source_row_number")).alias("seen"),
        )
        .orderBy(F.desc("uses"), "seen")
    )
    top = ranked.first()
    return top["code"] if top else "USD"


def _converter_of(kind: str, name: str) -> str | None:
    own = schema_of(kind).field(name)
    if own is not None and own.converter != "currency":
        return own.converter
    return SHARED_CONVERTERS.get(name)


def _convert(
    converter: str, name: str, kind: str, data_type: str, options: CleaningOptions
) -> Column:
    value = col(name)
    if converter in _TEXT_CONVERTERS:
        return _TEXT_CONVERTERS[converter](value.cast("string"))
    if converter == "date":
        return parse_date(value, data_type, options.month_first, options.excel_serials)
    if converter == "month":
        return parse_month(value, data_type, options.month_first)
    target = schema_of(kind).field(name).data_type
    if is_numeric(data_type):
        number = strict_number(value, data_type)
        return number if converter == "integer" else number.try_cast(target)
    # Whole numbers are told apart in the next projection, which then reads a column.
    return scaled_number(value) if converter == "integer" else parse_number(value, target)


def _changed(converter: str, raw: Column, data_type: str, cleaned: Column) -> Column:
    """Whether cleaning altered a cell.

    A number counts as unaltered when its source text already reads as that number.
    """
    if converter in ("integer", "number") and not is_numeric(data_type):
        same = F.coalesce(reads_as_number(raw), F.lit(True)) & (raw.isNull() | cleaned.isNotNull())
    elif converter in ("integer", "number"):
        same = raw.cast("double").eqNullSafe(cleaned.cast("double"))
    elif converter == "date" and data_type == "string":
        same = raw.isNull()
    else:
        same = raw.eqNullSafe(cleaned)
    return F.when(same, 0).otherwise(1)


def _rejected(converter: str, raw: Column, data_type: str, cleaned: Column) -> Column:
    failed = raw.isNotNull() & cleaned.isNull()
    if converter == "number":
        failed = failed & ~is_nan_text(raw.cast("string"))
    return failed


def clean_dataset(
    frame: DataFrame,
    kind: str,
    options: CleaningOptions | None = None,
    structural: bool = False,
    stage: Stage | None = None,
    count_changes: bool = True,
) -> DataFrame:
    """Return the annotated table: typed values, issues, source values, blocking step.

    ``frame`` holds canonical columns and trace columns, and may already carry ``_issues``
    from an earlier check. ``structural`` blocks every row. ``count_changes`` adds the
    per-column change marks that ``cleaning_stats`` sums.
    """
    options = options or CleaningOptions()
    schema = schema_of(kind)
    types = dict(frame.dtypes)
    columns = [c for c in frame.columns if c not in TRACE_COLUMNS and c != "_issues"]
    converters = {c: _converter_of(schema.kind, c) for c in columns}
    converts_currency = schema.kind in (ORDERS, RETURNS) and "currency" in columns

    raw_code = F.col("currency").cast("string") if converts_currency else F.lit(None)
    prepared = frame.select(
        *[c for c in frame.columns if c in TRACE_COLUMNS],
        (F.col("_issues") if "_issues" in frame.columns else no_issues()).alias("_issues"),
        F.struct(*[col(c).alias(c) for c in columns]).alias("_source"),
        F.coalesce(text.currency_code(raw_code), F.lit(options.currency)).alias("_code"),
        *[
            (
                _convert(converters[c], c, schema.kind, types[c], options)
                if converters[c]
                else col(c)
            ).alias(c)
            for c in columns
        ],
    )
    whole = {c: whole_number(F.col(c)) for c in columns if converters[c] == "integer"}
    prepared = prepared.withColumns({**whole, "_rate": options.rate_of(F.col("_code"))})

    found: list[Column] = []
    changes = {
        c: _changed(converters[c], F.col("_source")[c], types[c], col(c))
        for c in columns
        if converters[c]
    }
    for converter in _CHECKED:
        for c in (name for name in columns if converters[name] == converter):
            raw = F.col("_source")[c]
            rejected = _rejected(converter, raw, types[c], col(c))
            found.append(F.when(rejected, _conversion_issue(converter, c, raw)))
    outputs = {c: col(c) for c in columns}

    if converts_currency:
        raw = F.col("_source")["currency"].cast("string")
        supported, home = F.col("_rate").isNotNull(), F.lit(options.currency)
        message = F.concat(
            F.lit("Currency '"), F.col("_code"), F.lit("' has no configured exchange rate.")
        )
        found.append(
            F.when(
                ~supported,
                issue(
                    "unsupported_currency",
                    "currency",
                    message,
                    raw,
                    "Add an exchange rate or use a supported currency.",
                ),
            )
        )
        outputs["currency"] = F.when(supported, home).otherwise(F.col("_code"))
        changes["currency"] = F.when(supported & ~raw.eqNullSafe(home), 1).otherwise(0)
        if schema.amount in columns:
            amount = F.col(schema.amount)
            moved = (amount * F.col("_rate")).try_cast(MONEY)
            outputs[schema.amount] = F.when(supported, moved).otherwise(amount)
            changes[schema.amount] = changes[schema.amount] + F.when(
                supported & (moved != amount), 1
            ).otherwise(0)

    issues = F.concat(F.col("_issues"), raised(*found))
    annotated = prepared.select(
        *[outputs[c].alias(c) for c in columns],
        *[c for c in prepared.columns if c in TRACE_COLUMNS],
        issues.alias("_issues"),
        F.struct(*[F.col("_source")[c].cast("string").alias(c) for c in columns]).alias("_raw"),
        *(
            [F.struct(*[v.alias(c) for c, v in changes.items()]).alias("_changes")]
            if count_changes and changes
            else []
        ),
    ).withColumn(
        "_step", F.when(F.lit(structural) | blocks(F.col("_issues")), F.lit(CLEANING))
    )
    keys = list(schema.key)
    if stage is not None:
        # The duplicate check reads the table twice; conversions should run once.
        annotated = stage.write(annotated, f"cleaned-{schema.kind}")
    if structural or not set(keys) <= set(columns):
        return annotated
    return flag_duplicates(
        annotated,
        keys,
        options.duplicate_strategy,
        schema.latest_by,
        stage,
        f"repeated-{schema.kind}",
    )


def _conversion_issue(converter: str, name: str, raw: Column) -> Column:
    if converter == "month":
        return issue(
            "invalid_month", name, "Month could not be converted.", raw,
            "Use YYYY-MM or a valid date.",
        )
    code = "invalid_date" if converter == "date" else "invalid_numeric_value"
    return issue(
        code, name, f"'{name}' could not be converted.", raw,
        "Correct the source value or leave it empty.",
    )


def cleaning_stats(annotated: DataFrame, kind: str) -> DataFrame:
    """Row, change, invalid-value and duplicate counts in long form.

    ``subject`` is a column name for ``changed_values`` per column and null for totals.
    """
    marked = "_changes" in annotated.columns
    names = annotated.schema["_changes"].dataType.fieldNames() if marked else []
    codes = ("invalid_numeric_value", "invalid_date", "invalid_month", "unsupported_currency")
    invalid = F.size(F.filter("_issues", lambda item: item["issue_code"].isin(*codes)))
    duplicate = F.exists("_issues", lambda item: item["issue_code"] == "duplicate_row")
    sums = {name: F.coalesce(F.sum(F.col("_changes")[name]), F.lit(0)) for name in names}
    totals = annotated.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.col("_step").isNull()).alias("cleaned_rows"),
        F.count_if(F.col("_step").isNotNull()).alias("excluded_rows"),
        sum(sums.values(), F.lit(0)).alias("changed_values"),
        F.coalesce(F.sum(invalid), F.lit(0)).alias("invalid_values"),
        F.count_if(duplicate).alias("duplicate_rows"),
        *[value.alias(f"changed:{name}") for name, value in sums.items()],
    )
    return totals.unpivot([], totals.columns, "measure", "value").select(
        F.lit(kind).alias("dataset"),
        F.when(F.col("measure").startswith("changed:"), F.lit("changed_values"))
        .otherwise(F.col("measure"))
        .alias("measure"),
        F.when(
            F.col("measure").startswith("changed:"), F.substring_index("measure", ":", -1)
        ).alias("subject"),
        F.col("value").cast("bigint").alias("value"),
    )
