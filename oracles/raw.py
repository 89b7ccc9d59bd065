"""SQL for cleaning, validation, and pipeline queries over the raw datasets."""

from __future__ import annotations

from dataclasses import dataclass

from oracles.base import define, kpis, lines, performance, with_ctes
from oracles.typed import cutoff, findings, metrics, velocity

QUERIES: dict[str, str] = {}


def add(name: str, text: str) -> None:
    QUERIES[name] = with_ctes(text)


# Scalar helpers for the value forms that the raw datasets contain.
def text(value: str) -> str:
    return f"nullif(trim({value}), '')"


def squeezed(value: str) -> str:
    return f"regexp_replace({text(value)}, '\\s+', ' ', 'g')"


def number(value: str) -> str:
    bare = f"regexp_replace({value}, '[ $€]', '', 'g')"
    digits = f"replace({bare}, '%', '')"
    comma_last = f"strpos(reverse({digits}), ',') < strpos(reverse({digits}), '.')"
    decimal = (
        f"case when contains({digits}, ',') and contains({digits}, '.') then "
        f"case when {comma_last} then replace(replace({digits}, '.', ''), ',', '.') "
        f"else replace({digits}, ',', '') end else replace({digits}, ',', '.') end"
    )
    scale = f"case when {bare} like '%\\%' escape '\\' then 0.01 else 1.00 end"
    return f"(try_cast({decimal} as decimal(18,6)) * {scale})"


def integer(value: str) -> str:
    return f"case when {number(value)} = floor({number(value)}) then cast({number(value)} as bigint) end"


def day(value: str) -> str:
    forms = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y', '%d.%m.%Y']"
    return f"cast(try_strptime(trim({value}), {forms}) as date)"


def month(value: str) -> str:
    full = f"case when length(trim({value})) = 7 then trim({value}) || '-01' else {value} end"
    return f"strftime({day(full)}, '%Y-%m')"


def title(value: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({value}), '[a-z]+|[^a-z]+'), "
        "lambda s: upper(s[1:1]) || s[2:]), '')"
    )


def country(value: str) -> str:
    name = squeezed(value)
    return (
        f"case lower({name}) when 'uk' then 'United Kingdom' when 'great britain' then "
        "'United Kingdom' when 'deutschland' then 'Germany' when 'u.s.' then 'United States' "
        f"when 'hellas' then 'Greece' else {title(name)} end"
    )


def status(value: str) -> str:
    name = f"replace(lower({text(value)}), '_', '-')"
    return (
        f"case {name} when 'complete' then 'completed' when 'paid' then 'completed' "
        f"when 'in-progress' then 'pending' else {name} end"
    )


def channel(value: str) -> str:
    name = squeezed(f"replace(lower({value}), '_', ' ')")
    return (
        f"case {name} when 'online' then 'website' when 'store' then 'retail' "
        f"when 'e-commerce' then 'website' else {name} end"
    )


def plain(value: str) -> str:
    shown = f"cast({value} as varchar)"
    return f"regexp_replace(regexp_replace({shown}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_CODE = f"coalesce(upper({text('r_currency')}), 'USD')"
_RATE = f"case {_CODE} when 'USD' then 1.0 when 'EUR' then 1.1 when 'GBP' then 1.25 end"

# Canonical column, source heading, cleaning expression over r_<column>.
COLUMNS = {
    "orders": (
        ("order_id", "Order Number", squeezed("r_order_id")),
        ("order_date", "Date", day("r_order_date")),
        ("product_id", "SKU", squeezed("r_product_id")),
        ("quantity", "Qty", integer("r_quantity")),
        ("unit_price", "Price", f"cast({number('r_unit_price')} as decimal(22,6))"),
        ("customer_id", "customer_id", squeezed("r_customer_id")),
        ("discount", "Discount Rate", f"cast({number('r_discount')} as decimal(9,6))"),
        ("currency", "Currency Code", f"case when {_RATE} is null then {_CODE} else 'USD' end"),
        ("country", "Market", country("r_country")),
        ("sales_channel", "Channel", channel("r_sales_channel")),
        ("order_status", "Status", status("r_order_status")),
        ("Note", "Note", "r_Note"),
    ),
    "products": (
        ("product_id", "Product Code", squeezed("r_product_id")),
        ("product_name", "Product", text("r_product_name")),
        ("purchase_cost", "Cost", f"cast({number('r_purchase_cost')} as decimal(22,6))"),
        ("recommended_price", "RRP", f"cast({number('r_recommended_price')} as decimal(22,6))"),
        ("category", "Product Category", text("r_category")),
        ("supplier", "Vendor", text("r_supplier")),
        ("vat_rate", "VAT", f"cast({number('r_vat_rate')} as decimal(9,6))"),
    ),
    "inventory": (
        ("product_id", "SKU", squeezed("r_product_id")),
        ("warehouse", "Location", text("r_warehouse")),
        ("stock_quantity", "On Hand", integer("r_stock_quantity")),
        ("reserved_quantity", "Reserved", integer("r_reserved_quantity")),
        ("reorder_level", "Reorder Point", integer("r_reorder_level")),
        ("last_restock_date", "Last Restock", day("r_last_restock_date")),
    ),
    "returns": (
        ("return_id", "RMA", squeezed("r_return_id")),
        ("order_id", "Order Reference", squeezed("r_order_id")),
        ("product_id", "Article", squeezed("r_product_id")),
        ("return_date", "Returned On", day("r_return_date")),
        ("quantity", "Qty", integer("r_quantity")),
        ("refund_amount", "Refund", f"cast({number('r_refund_amount')} as decimal(22,6))"),
        ("return_reason", "Reason", text("r_return_reason")),
    ),
    "monthly_targets": (
        ("month", "Period", month("r_month")),
        ("revenue_target", "Revenue Goal", f"cast({number('r_revenue_target')} as decimal(22,6))"),
        ("profit_target", "Profit Goal", f"cast({number('r_profit_target')} as decimal(22,6))"),
        ("orders_target", "Order Target", integer("r_orders_target")),
    ),
}
KEYS = {
    "orders": ("order_id", "product_id"), "products": ("product_id",),
    "inventory": ("product_id", "warehouse"), "returns": ("return_id",),
    "monthly_targets": ("month",),
}


@dataclass(frozen=True)
class Check:
    code: str
    field: str
    test: str
    message: str
    value: str
    action: str
    severity: str = "error"
    free: bool = False


def _unconverted(field: str, code: str = "invalid_numeric_value") -> Check:
    return Check(
        code, field, f"r_{field} is not null and c_{field} is null",
        f"'{field}' could not be converted.".replace("'", "''"), f"r_{field}",
        "Correct the source value or leave it empty.",
    )


CLEANING = {
    "orders": (
        _unconverted("quantity"), _unconverted("unit_price"), _unconverted("discount"),
        _unconverted("order_date", "invalid_date"),
        Check("unsupported_currency", "currency", f"{_RATE} is null",
              f"Currency ''' || {_CODE} || ''' has no configured exchange rate.", "r_currency",
              "Add an exchange rate or use a supported currency."),
    ),
    "products": (
        _unconverted("purchase_cost"), _unconverted("recommended_price"), _unconverted("vat_rate"),
    ),
    "inventory": (
        _unconverted("stock_quantity"), _unconverted("reserved_quantity"),
        _unconverted("reorder_level"), _unconverted("last_restock_date", "invalid_date"),
    ),
    "returns": (
        _unconverted("quantity"), _unconverted("refund_amount"),
        _unconverted("return_date", "invalid_date"),
    ),
    "monthly_targets": (
        _unconverted("orders_target"), _unconverted("revenue_target"),
        _unconverted("profit_target"),
        Check("invalid_month", "month", "r_month is not null and c_month is null",
              "Month could not be converted.", "r_month", "Use YYYY-MM or a valid date."),
    ),
}


def _missing(field: str, label: str) -> Check:
    return Check(f"missing_{field}", field, f"{field} is null", f"The {label} is missing.",
                 f"cast({field} as varchar)", f"Provide a valid {label}.")


def _negative(field: str, code: str, message: str, action: str) -> Check:
    return Check(code, field, f"{field} < 0", message, plain(field), action)


def _stock(field: str, code: str, label: str) -> Check:
    return _negative(field, code, f"{label} cannot be negative.",
                     f"Enter a {label.lower()} greater than or equal to zero.")


def _target(field: str, label: str) -> Check:
    return _negative(field, "negative_target", f"{label} cannot be negative.",
                     "Enter a target greater than or equal to zero.")


BUSINESS = {
    "products": (
        Check("missing_product_name", "product_name", "product_name is null",
              "Product name is missing.", "product_name", "Provide a product name."),
        Check("invalid_purchase_cost", "purchase_cost", "purchase_cost is null",
              "Purchase cost must be numeric.", plain("purchase_cost"),
              "Replace the value with a numeric purchase cost."),
        _negative("purchase_cost", "negative_purchase_cost", "Purchase cost cannot be negative.",
                  "Enter a purchase cost greater than or equal to zero."),
        Check("recommended_price_below_cost", "recommended_price",
              "recommended_price < purchase_cost", "Recommended price is below purchase cost.",
              plain("recommended_price"),
              "Review pricing or confirm that the product is intentionally sold at a loss.",
              "warning", True),
        Check("invalid_vat_rate", "vat_rate", "not vat_rate between 0 and 1",
              "VAT rate must be between 0 and 1.", plain("vat_rate"),
              "Enter VAT as a decimal between 0 and 1."),
    ),
    "orders": (
        _missing("order_id", "order ID"), _missing("order_date", "order date"),
        _missing("product_id", "product ID"),
        Check("invalid_quantity", "quantity", "quantity is null",
              "Quantity must be a whole number.", "cast(quantity as varchar)",
              "Replace the value with a positive whole number."),
        Check("quantity_not_positive", "quantity", "quantity <= 0",
              "Quantity must be greater than zero.", "cast(quantity as varchar)",
              "Enter a quantity greater than zero."),
        Check("invalid_unit_price", "unit_price", "unit_price is null",
              "Unit price must be numeric.", plain("unit_price"),
              "Replace the value with a numeric unit price."),
        _negative("unit_price", "negative_unit_price", "Unit price cannot be negative.",
                  "Enter a unit price greater than or equal to zero."),
        Check("discount_out_of_range", "discount", "not discount between 0 and 1",
              "Discount must be between 0 and 1.", plain("discount"),
              "Enter the discount as a decimal between 0 and 1."),
        Check("unknown_product_id", "product_id", "not known_product",
              "Order references an unknown product ID.", "product_id",
              "Correct the product ID or add the referenced product."),
    ),
    "inventory": (
        Check("unknown_product_id", "product_id", "not known_product",
              "Inventory references an unknown product ID.", "product_id",
              "Add the product to the catalogue or correct the product ID."),
        _stock("stock_quantity", "negative_stock", "Stock quantity"),
        _stock("reserved_quantity", "negative_reserved_quantity", "Reserved quantity"),
        _stock("reorder_level", "negative_reorder_level", "Reorder level"),
        Check("reserved_quantity_exceeds_stock", "reserved_quantity",
              "reserved_quantity > stock_quantity",
              "Reserved quantity is greater than available stock.",
              "cast(reserved_quantity as varchar)",
              "Reduce the reserved quantity or correct the stock quantity."),
    ),
    "returns": (
        Check("unknown_order_id", "order_id", "not known_order",
              "Return references an unknown order ID.", "order_id",
              "Correct the order ID or add the referenced order."),
        Check("unknown_product_id", "product_id", "not known_product",
              "Return references an unknown product ID.", "product_id",
              "Correct the product ID or add the referenced product."),
        Check("invalid_return_quantity", "quantity", "quantity is null or quantity <= 0",
              "Return quantity must be a positive whole number.", "cast(quantity as varchar)",
              "Enter a positive whole-number return quantity."),
        _negative("refund_amount", "negative_refund_amount", "Refund amount cannot be negative.",
                  "Enter a refund amount greater than or equal to zero."),
        Check("return_date_before_order_date", "return_date", "return_date < sold_on",
              "Return date is before the matching order date.", "cast(return_date as varchar)",
              "Correct the return date or matching order reference."),
        Check("returned_quantity_exceeds_sold", "quantity", "quantity > sold_units",
              "Returned quantity is greater than the sold quantity.", "cast(quantity as varchar)",
              "Reduce the return quantity or correct the matching order."),
    ),
    "monthly_targets": (
        Check("invalid_month", "month", "month is null", "Target month must use YYYY-MM format.",
              "month", "Enter a valid month such as 2025-01."),
        _target("revenue_target", "Revenue Target"), _target("profit_target", "Profit Target"),
        _target("orders_target", "Orders Target"),
    ),
}


def _issue(kind: str, check: Check, source: str, row: str = "source_row_number") -> str:
    return f"""select '{check.severity}' as severity, '{kind}' as source_dataset,
  '{kind}' as source_filename, {row} as row_number, '{check.field}' as field,
  '{check.code}' as issue_code, '{check.message}' as message, {check.value} as original_value,
  '{check.action}' as recommended_action, {str(check.free).lower()} as row_can_continue
from {source} where {check.test}"""


_PRODUCT_LOOKUP = """(select product_id as pid, true as listed, product_name, purchase_cost,
  recommended_price, category, supplier, vat_rate from products_kept)"""
_REFERENCED = {
    "products": "select * from products_unique",
    "monthly_targets": "select * from monthly_targets_unique",
    "orders": f"""select o.*, coalesce(p.listed, false) as known_product, p.product_name,
      p.purchase_cost, p.recommended_price, p.category, p.supplier, p.vat_rate
      from orders_unique o left join {_PRODUCT_LOOKUP} p on o.product_id is not distinct from p.pid""",
    "inventory": f"""select i.*, coalesce(p.listed, false) as known_product, p.product_name,
      p.purchase_cost, p.recommended_price, p.category, p.supplier, p.vat_rate
      from inventory_unique i left join {_PRODUCT_LOOKUP} p on i.product_id = p.pid""",
    "returns": f"""select r.*, coalesce(p.listed, false) as known_product,
      coalesce(k.listed, false) as known_order, s.sold_on, s.sold_units, s.sold_price,
      p.product_name, p.purchase_cost, p.recommended_price, p.category, p.supplier, p.vat_rate
      from returns_unique r left join {_PRODUCT_LOOKUP} p on r.product_id = p.pid
      left join (select distinct order_id as oid, true as listed from orders_kept) k
        on r.order_id = k.oid
      left join (select order_id as oid, product_id as pid, order_date as sold_on,
        quantity as sold_units, unit_price as sold_price from orders_kept) s
        on r.order_id = s.oid and r.product_id = s.pid""",
}
ORDER = ("products", "orders", "inventory", "returns", "monthly_targets")
for kind in ORDER:
    columns = COLUMNS[kind]
    mapped = ", ".join(f'"{heading}" as r_{name}' for name, heading, _ in columns)
    define(f"{kind}_mapped", f"select {mapped}, source_row_number from {kind}_raw")
    converted = ", ".join(f"{expression} as c_{name}" for name, _, expression in columns)
    define(f"{kind}_parsed", f"select *, {converted} from {kind}_mapped")
    names = [name for name, _, _ in columns]
    typed = ", ".join(
        f"cast(c_{name} * coalesce({_RATE}, 1.0) as decimal(22,6)) as {name}"
        if (kind, name) == ("orders", "unit_price")
        else f"c_{name} as {name}"
        for name in names
    )
    bad = " or ".join(f"({check.test})" for check in CLEANING[kind])
    define(f"{kind}_typed", f"select *, {typed}, coalesce({bad}, false) as rejected from {kind}_parsed")
    keys = ", ".join(KEYS[kind])
    define(
        f"{kind}_placed",
        f"""select *, case when not rejected then row_number() over (partition by rejected, {keys}
        order by source_row_number) end as place from {kind}_typed""",
    )
    define(f"{kind}_unique", f"select * from {kind}_placed where place = 1")
    define(f"{kind}_checked", _REFERENCED[kind])
    blocked = " or ".join(
        f"coalesce({check.test}, false)" for check in BUSINESS[kind] if not check.free
    )
    define(f"{kind}_kept", f"select * from {kind}_checked where not ({blocked})")
    duplicate = Check(
        "duplicate_row", ", ".join(KEYS[kind]), "place > 1",
        "Duplicate row excluded using ''keep_first''.",
        "'[' || " + " || ',' || ".join(
            f"coalesce('\"' || {key} || '\"', 'null')" for key in KEYS[kind]
        ) + " || ']'",
        "Review duplicate source records.", "warning",
    )
    define(
        f"{kind}_cleaning_issues",
        " union all ".join(
            [_issue(kind, check, f"{kind}_typed") for check in CLEANING[kind]]
            + [_issue(kind, duplicate, f"{kind}_placed")]
        ),
    )
    define(
        f"{kind}_issues",
        f"select * from {kind}_cleaning_issues union all "
        + " union all ".join(_issue(kind, check, f"{kind}_checked") for check in BUSINESS[kind]),
    )
define("issues", " union all ".join(f"select * from {kind}_issues" for kind in ORDER))
for kind in ORDER:
    define(
        f"{kind}_reasons",
        f"""select row_number as source_row_number, string_agg(distinct issue_code, '; '
        order by issue_code) as exclusion_reason from {kind}_issues where not row_can_continue
        group by 1""",
    )

for name, kind in (("orders", "orders"), ("products", "products"), ("inventory", "inventory"),
                   ("returns", "returns"), ("targets", "monthly_targets")):
    picked = ", ".join(column for column, _, _ in COLUMNS[kind])
    add(f"clean_{name}", f"select {picked}, source_row_number from {kind}_unique")
add("cleaning_issues", "select * from orders_cleaning_issues")
add(
    "dedupe_keep_last_row",
    """select product_id, product_name, source_row_number from (select *, row_number() over
    (partition by rejected, product_id order by source_row_number desc) as last
    from products_typed) t where not rejected and last = 1""",
)


# A numeric cell is unchanged when its text already is the number.
_NUMERIC = {
    "orders": ("quantity", "unit_price", "discount"),
    "products": ("purchase_cost", "recommended_price", "vat_rate"),
    "inventory": ("stock_quantity", "reserved_quantity", "reorder_level"),
    "returns": ("quantity", "refund_amount"),
    "monthly_targets": ("revenue_target", "profit_target", "orders_target"),
}
_DATES = ("order_date", "return_date", "last_restock_date")


def _changed(kind: str, name: str) -> str:
    if name in _NUMERIC[kind]:
        test = (
            f"r_{name} is not null and not (regexp_matches(r_{name}, "
            f"'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*$') and c_{name} is not null)"
        )
        extra = ""
        if (kind, name) == ("orders", "unit_price"):
            extra = " + case when coalesce(c_unit_price <> unit_price, false) then 1 else 0 end"
        return f"sum(case when {test} then 1 else 0 end{extra})"
    if name in _DATES:
        return f"count(r_{name})"
    if name == "currency":
        return f"count_if({_RATE} is not null and r_currency is distinct from 'USD')"
    return f"count_if(r_{name} is distinct from c_{name})"


def _stats(kind: str) -> str:
    names = [name for name, _, _ in COLUMNS[kind] if name != "Note"]
    parts = {f"changed_values|{name}": _changed(kind, name) for name in names}
    rejected = " + ".join(
        f"case when {check.test} then 1 else 0 end" for check in CLEANING[kind]
    )
    totals = {
        "input_rows|": "count(*)",
        "cleaned_rows|": "count_if(place = 1)",
        "excluded_rows|": "count_if(rejected or place > 1)",
        "changed_values|": " + ".join(parts.values()),
        "invalid_values|": f"sum({rejected})",
        "duplicate_rows|": "count_if(place > 1)",
    }
    return " union all ".join(
        f"select '{kind}' as dataset, '{label.split('|')[0]}' as measure, "
        f"nullif('{label.split('|')[1]}', '') as subject, cast({value} as bigint) as value "
        f"from {kind}_placed"
        for label, value in {**totals, **parts}.items()
    )


add("cleaning_stats", " union all ".join(_stats(kind) for kind in ORDER))
add(
    "default_currency",
    f"""select code as default_currency from (select upper({text("r_currency")}) as code,
    source_row_number from orders_mapped) t where code is not null group by code
    order by count(*) desc, min(source_row_number) limit 1""",
)
add(
    "normalized_values",
    f"""select source_row_number, {squeezed("r_order_id")} as order_id,
    {country("r_country")} as country, {status("r_order_status")} as order_status,
    {channel("r_sales_channel")} as sales_channel, upper({text("r_currency")}) as currency
    from orders_mapped""",
)
add(
    "parsed_values",
    f"""select source_row_number, c_quantity as quantity, c_unit_price as unit_price,
    c_discount as discount, c_order_date as order_date,
    case when regexp_matches(trim(r_quantity), '^[+-]?[0-9]+(\\.0*)?$')
      then cast(cast(trim(r_quantity) as double) as bigint) end as strict_quantity
    from orders_parsed""",
)
add(
    "converted_currency",
    f"""select source_row_number, cast(c_unit_price * ({_RATE}) as decimal(22,6)) as unit_price
    from orders_parsed""",
)

# Pipeline results.
add(
    "structural_issues",
    """select field, issue_code, cast(null as bigint) as blocked_rows from (values
      ('order_date', 'missing_required_column'), ('unit_price', 'missing_required_column'))
      t(field, issue_code)
    union all select null, null, count(*) from returns_raw""",
)
_HEADINGS = " union all ".join(
    f"select '{kind}' as dataset, '{heading}' as source_column, '{name}' as canonical_column, "
    f"'matched' as status, '{need}' as requirement"
    for kind, required in (
        ("orders", 5), ("products", 4), ("inventory", 3), ("returns", 6), ("monthly_targets", 2)
    )
    for place, (name, heading, _) in enumerate(COLUMNS[kind])
    if name != "Note"
    for need in ("required" if place < required else "optional",)
)
add(
    "mapping_report",
    _HEADINGS + " union all select 'orders', 'Note', '', 'unknown', '' ",
)
add("all_issues", "select * from issues")


def _excluded(kind: str) -> str:
    wanted = ("product_id", "order_id", "quantity", "unit_price", "currency", "month")
    names = [name for name, _, _ in COLUMNS[kind]]
    values = ", ".join(
        f"case when t.rejected or t.place > 1 then t.r_{name} "
        f"else cast(t.{name} as varchar) end as {name}"
        if name in names
        else f"cast(null as varchar) as {name}"
        for name in wanted
    )
    return f"""select '{kind}' as source_dataset, source_row_number, 'excluded' as
  processing_status, exclusion_reason, {values}
  from {kind}_placed t join {kind}_reasons using (source_row_number)"""


define("excluded", " union all ".join(_excluded(kind) for kind in ORDER))
add("excluded_rows", "select * from excluded")
add(
    "exclusion_reasons",
    "select source_dataset, exclusion_reason, count(*) as rows from excluded group by 1, 2",
)
_ORDER_COLUMNS = (
    '"Order Number", "Date", "SKU", "Qty", "Price", customer_id, "Discount Rate", "Currency Code", "Market", '
    '"Channel", "Status", "Note"'
)
add(
    "duplicated_rows",
    f"""select source_row_number, {_ORDER_COLUMNS} from (
      select *, count(*) over (partition by {_ORDER_COLUMNS}) as copies from (
        select {_ORDER_COLUMNS}, source_row_number from orders_raw union all
        select {_ORDER_COLUMNS}, source_row_number + 1000000000 from orders_raw where source_row_number % 101 = 5
        union all select * replace ("Note" || '!' as "Note", source_row_number + 2000000000 as source_row_number)
        from (select {_ORDER_COLUMNS}, source_row_number from orders_raw where source_row_number % 103 = 6)) u) t
    where copies > 1""",
)
_RETURN_COLUMNS = ", ".join(name for name, _, _ in COLUMNS["returns"])
add("split_blocked", f"select {_RETURN_COLUMNS}, source_row_number from returns_kept")
define("targets_kept", "select * from monthly_targets_kept")
_ORDER_COLUMNS = ", ".join(f"o.{name}" for name, _, _ in COLUMNS["orders"])
_ATTRIBUTES = ("product_name", "purchase_cost", "recommended_price", "category", "supplier", "vat_rate")


def _attributes(alias: str, prefix: str) -> str:
    return ", ".join(f"{alias}.{name} as {prefix}{name}" for name in _ATTRIBUTES)


define(
    "processed",
    f"""select {_ORDER_COLUMNS}, o.source_row_number, 'processed' as processing_status,
    {_attributes("o", "")}, strftime(order_date, '%Y-%m') as reporting_month,
    t.revenue_target as target_revenue_target, t.profit_target as target_profit_target,
    t.orders_target as target_orders_target
    from orders_kept o left join targets_kept t on t.month = strftime(order_date, '%Y-%m')""",
)
add("processed_orders", "select * from processed")
_STOCK_COLUMNS = ", ".join(name for name, _, _ in COLUMNS["inventory"])
add(
    "processed_inventory",
    f"""select {_STOCK_COLUMNS}, source_row_number, 'processed' as processing_status,
    {_attributes("i", "product_")} from inventory_kept i""",
)
add(
    "processed_returns",
    f"""select {_RETURN_COLUMNS}, source_row_number, 'processed' as processing_status,
    sold_on as original_order_date, sold_units as sold_quantity, sold_price as
    original_unit_price, {_attributes("r", "product_")} from returns_kept r""",
)
define(
    "stats",
    " union all ".join(
        f"""select '{kind}' as dataset, (select count(*) from {kind}_raw) as input_rows,
        (select count(*) from {kind}_kept) as processed_rows,
        (select count(*) from {kind}_reasons) as excluded_rows,
        (select count(*) from {kind}_issues) as issue_count"""
        for kind in ORDER
    ),
)
add("processing_stats", "select * from stats")
define(
    "health",
    " union all ".join(
        f"""select '{kind}' as dataset, total_rows, error_rows, warning_rows,
        total_rows - error_rows - warning_rows as valid_rows, false as has_dataset_issues
        from (select (select count(*) from {kind}_raw) as total_rows,
          count_if(bad) as error_rows, count_if(not bad and warned) as warning_rows
          from (select row_number, bool_or(severity = 'error' or not row_can_continue) as bad,
            bool_or(severity = 'warning') as warned from {kind}_issues group by 1) r) h"""
        for kind in ORDER
    ),
)
add("row_health", "select * from health")
define(
    "scores",
    """select *, round_even(100.0::double * (valid_rows + 0.5::double * warning_rows) / total_rows, 2)
    as quality_score from health""",
)
add("quality_score", "select dataset, quality_score from scores")
define(
    "combined",
    """select sum(total_rows)::bigint as total_rows, sum(valid_rows)::bigint as valid_rows,
    sum(warning_rows)::bigint as warning_rows, sum(error_rows)::bigint as error_rows,
    round_even(sum(quality_score * total_rows) / sum(total_rows), 2) as quality_score
    from scores""",
)
add("combined_quality", "select * from combined")
add(
    "score_label",
    """select dataset, case when quality_score >= 95 then 'Excellent data health'
    when quality_score >= 85 then 'Good data health' when quality_score >= 70 then
    'Review recommended' else 'Significant issues require attention' end as label from scores""",
)
define(
    "summary",
    """select sum(input_rows)::bigint as source_rows, sum(processed_rows)::bigint as valid_rows,
    sum(excluded_rows)::bigint as excluded_rows,
    (select count_if(severity = 'warning') from issues) as warnings,
    (select count_if(severity = 'error') from issues) as errors,
    (select quality_score from combined) as quality_score from stats""",
)
add("quality_summary", "select * from summary")
_CATEGORY = """case when issue_code like 'missing\\_%' escape '\\' then 'Missing Values'
  when contains(issue_code, 'duplicate') then 'Duplicate Records'
  when issue_code in ('unknown_order_id', 'unknown_product_id', 'return_date_before_order_date',
    'returned_quantity_exceeds_sold') then 'Invalid Relationships'
  when issue_code in ('invalid_date', 'invalid_month', 'invalid_numeric_value',
    'invalid_purchase_cost', 'invalid_quantity', 'invalid_restock_date',
    'invalid_return_quantity', 'invalid_unit_price', 'invalid_vat_rate') then 'Invalid Data Types'
  when severity = 'warning' then 'Transformation Warnings' else 'Business Rule Violations' end"""
define(
    "views",
    f"""select *, {_CATEGORY} as category, source_dataset || '|' || source_filename || '|'
    || row_number || '|' || field || '|' || issue_code || '|0' as issue_id,
    case when source_dataset in ('orders', 'products') and not row_can_continue
      then 'Excluded from processing' else 'Pending review' end as action from issues""",
)
add(
    "categorize_issues",
    "select source_dataset, issue_code, category, count(*) as issues from views group by 1, 2, 3",
)
add(
    "issue_groups",
    """select category, count(distinct (source_dataset, row_number)) as affected_rows,
    count(*) as issue_count, case when bool_or(severity = 'error') then 'error' else 'warning' end
    as highest_severity from views group by 1""",
)
_DECISION = """case when action = 'Excluded from processing' then action
  when not row_can_continue then 'Exclusion required'
  when severity = 'warning' then 'Reviewable warning' else 'Can continue' end"""
add(
    "issue_views",
    f"select issue_id, category, action, {_DECISION} as processing_status from views",
)
add(
    "filter_issues",
    """select issue_id, issue_code from views where source_dataset in ('orders', 'returns')
    and severity = 'error' and category in ('Invalid Relationships', 'Invalid Data Types')
    and contains(lower(source_dataset || ' ' || field || ' ' || issue_code || ' ' || message ||
      ' ' || coalesce(original_value, '') || ' ' || recommended_action), 'product')""",
)
add(
    "issue_export",
    """select severity, source_dataset, source_filename as source_file, row_number, field,
    issue_code, message as issue, case when length(coalesce(original_value, '<NA>')) > 120
      then left(original_value, 117) || '...' else coalesce(original_value, '<NA>') end
      as original_value, recommended_action, action as action_taken from views""",
)
add(
    "generation_gate",
    """select count_if(severity = 'error' and not row_can_continue) as blocking_errors,
    cast(0 as bigint) as structural_errors, count_if(severity = 'warning') as warnings,
    'blocked by errors' as verdict from issues""",
)
add(
    "review_gate",
    """select cast(0 as bigint) as structural_errors,
    count_if(not row_can_continue and action = 'Pending review') as unresolved_exclusions,
    count_if(severity = 'warning') as warnings, true as warnings_confirmed,
    count_if(not row_can_continue and action = 'Pending review') = 0 as may_continue from views""",
)
add(
    "accepted_actions",
    """select case when severity = 'warning' then 'Accepted with warning'
    else 'Excluded from processing' end as action, count(*) as issues from issues
    where severity = 'warning' or not row_can_continue group by 1""",
)

# Analytics over what the pipeline accepted.
define("lines_processed", lines("orders_kept", "returns_kept", "true"))
add("process_datasets", kpis("lines_processed"))
_YEAR = "{day} between date '1998-01-01' and date '1998-12-31'"
_FIRST, _LAST = (f"(select {end}(order_date) from orders_kept)" for end in ("min", "max"))
_WHOLE = f"{{day}} between {_FIRST} and {_LAST}"
define("lines_report", lines("orders_kept", "returns_kept", _WHOLE))
define("lines_board", lines("orders_kept", "returns_kept", "true"))
add("report_analytics", performance("lines_report", {"category": "category"}))
define(
    "stock_kept",
    f"select i.*, {_attributes('i', 'product_')} from inventory_kept i",
)
define("velocity_report", velocity("orders_kept", "returns_kept", _WHOLE))
define("cutoff_report", cutoff("velocity_report"))
define(
    "metrics_report",
    metrics(
        "stock_kept", "velocity_report", "cutoff_report", _FIRST, _LAST,
        f"greatest({_LAST}, (select max(last_restock_date) from inventory_kept))",
    ),
)
add(
    "report_inventory",
    """select product_id, warehouse, available_stock, stock_coverage_days, inventory_status,
    suggested_reorder_quantity, days_since_last_sale, units_sold, is_high_revenue, as_of_date
    from metrics_report""",
)
add("dashboard_kpis", kpis("lines_board"))
define("velocity_board", velocity("orders_kept", "returns_kept", _WHOLE))
define("cutoff_board", cutoff("velocity_board"))
define(
    "metrics_board",
    metrics(
        "stock_kept", "velocity_board", "cutoff_board", _FIRST, _LAST, _LAST,
    ),
)
add(
    "dashboard_summary",
    f"""select {_FIRST} as date_from, {_LAST} as date_to,
    (select count(*) from lines_board) as filtered_order_rows,
    (select count(*) from inventory_kept) as filtered_inventory_rows,
    (select count(*) from returns_kept r join lines_board l using (order_id, product_id))
      as filtered_return_rows, 0 as active_filter_count, 'USD' as currency""",
)
add(
    "dashboard_inventory_risk",
    "select inventory_status, count(*) as products from metrics_board group by 1",
)
_BEFORE = "{day} between date '1997-01-01' and date '1997-12-31'"
define("lines_board_before", lines("orders_kept", "returns_kept", _BEFORE))
define("lines_board_year", lines("orders_kept", "returns_kept", _YEAR))


def _ordinal(source: str) -> str:
    return f"""select row_number() over (order by date) as period_day, net_revenue from
    ({performance(source, {"date": "order_date"})}) d"""


add(
    "dashboard_comparison",
    f"""select cast(period_day as int) as period_day, a.net_revenue as current_period,
    b.net_revenue as previous_period from ({_ordinal("lines_board_year")}) a full join
    ({_ordinal("lines_board_before")}) b using (period_day)""",
)
define("findings_board", findings("metrics_board"))
add(
    "dashboard_recommendations",
    """select rule_identifier, severity, count(*) as recommendations from findings_board
    group by 1, 2""",
)
add(
    "dashboard",
    """select 'out_of_stock_and_critical' as section, count(*) as rows from metrics_board
      where inventory_status in ('Out of Stock', 'Critical')
    union all select 'below_reorder_level', count(*) from metrics_board where reorder_alert
    union all select 'dead_stock', count(*) from metrics_board
      where days_since_last_sale >= 30 and available_stock > 0
    union all select 'overstock', count(*) from metrics_board
      where inventory_status = 'Overstock'
    union all select 'no_sales', count(*) from metrics_board where units_sold = 0
    union all select 'recommendations', count(*) from findings_board
    union all select 'revenue_over_time', count(distinct order_date) from lines_board
    union all select 'sales_by_country', count(distinct country) from lines_board
    union all select 'sales_by_channel', count(distinct sales_channel) from lines_board""",
)
_SUMMED = ("gross_revenue", "discount_amount", "refund_amount", "net_revenue",
           "cost_of_goods_sold", "gross_profit")
_COUNTED = ("orders", "units_sold", "returned_quantity")


def _totalled(source: str, first: str) -> str:
    """A performance table whose last row has the sums of amounts and counts."""
    return (
        f"select * replace (cast({first} as varchar) as {first}) from ({source}) a union all by name "
        f"select 'Total' as {first}, "
        + ", ".join(f"sum({name})::decimal(28,2) as {name}" for name in _SUMMED) + ", "
        + ", ".join(f"sum({name})::bigint as {name}" for name in _COUNTED)
        + f" from ({source}) b"
    )


def _report_by(**groups: str) -> str:
    return performance("lines_report", groups)


def _best(by: str) -> str:
    return f"select * from ({_PRODUCTS}) p order by {by} desc, product_id limit 10"


_PRODUCTS = _report_by(product_id="product_id", product_name="product_name")
_DAILY = _report_by(date="order_date")
_ORDER_SUMS = ("quantity", "purchase_cost", "target_revenue_target", "target_profit_target",
               "target_orders_target")
_SECTIONS = {
    "summary_kpis": kpis("lines_report"),
    "summary_trend": f"select date, net_revenue as current_period_revenue from ({_DAILY}) d",
    "summary_categories": f"""select * from ({_report_by(category="category")}) c
      order by category nulls first limit 10""",
    "summary_top_products": _best("net_revenue"),
    "sales_daily": _totalled(_DAILY, "date"),
    "sales_weekly": _totalled(
        performance("lines_report", {"week_start": "cast(date_trunc('week', order_date) as date)"}),
        "week_start",
    ),
    "sales_countries": _totalled(_report_by(country="country"), "country"),
    "sales_channels": _totalled(_report_by(sales_channel="sales_channel"), "sales_channel"),
    "products_categories": _totalled(_report_by(category="category"), "category"),
    "products_top_revenue": _totalled(_best("net_revenue"), "product_id"),
    "products_top_profit": _totalled(_best("gross_profit"), "product_id"),
    "products_bands": f"""select *, case when gross_profit < 0 then 'loss'
      when gross_profit > 0 then 'profit' end as profit_band,
      case when gross_margin_percent < 10 then 'low' end as margin_band,
      case when return_rate_percent > 10 then 'high' end as return_band from ({_PRODUCTS}) p""",
    "inventory": "select * from metrics_report",
    "inventory_status": "select inventory_status, count(*) as products from metrics_report group by 1",
    "recommendations": "select * exclude (warehouse) from findings_report",
    "quality_issues": "select * from issues",
    "processed_orders": f"""select *, 'orders' as source_file, cast(null as varchar) as exclusion_reason
      from processed union all by name select 'Total' as order_id,
      {', '.join(f"sum({name}) as {name}" for name in _ORDER_SUMS)} from processed""",
}
define("findings_report", findings("metrics_report"))
add("write_report_mart", _SECTIONS["sales_countries"])
_BACK = f"""select r.return_reason, r.product_id from returns_kept r
  join (select distinct order_id, product_id from lines_report) l using (order_id, product_id)
  where {_WHOLE.format(day="r.return_date")}"""
_MORE_ROWS = {
    "metadata": "9",
    "summary_cards": "8",
    "summary_targets": "(select count(*) from targets_kept)",
    "summary_alerts": "(select least(8, count(*)) from findings_report)",
    "summary_recommendations": "(select least(10, count(*)) from findings_report)",
    "returns_reasons": f"(select count(*) + 1 from (select distinct return_reason from ({_BACK}) r) d)",
    "returns_products": f"(select least(10, count(distinct product_id)) + 1 from ({_BACK}) r)",
    "quality_excluded": "(select count(*) from excluded)",
}
add(
    "report_manifest",
    " union all ".join(
        [f"select '{name}' as section, count(*) as rows, true as as_listed from ({source}) t"
         for name, source in _SECTIONS.items()]
        + [f"select '{name}', {rows}, true" for name, rows in _MORE_ROWS.items()]
    ),
)
add(
    "report_values",
    " union all ".join(
        f"""select '{name}' as section, column_name, count(cell) as filled,
      count(distinct cell) as distinct_values,
      cast(sum(try_cast(cell as decimal(38,4))) as double) as amount
      from (select columns(*)::varchar from ({source}) t)
      unpivot include nulls (cell for column_name in (columns(*))) group by column_name"""
        for name, source in _SECTIONS.items()
    ),
)
add(
    "write_validation_mart",
    " union all ".join(
        f"select '{name}' as metric, cast({name} as double) as value from summary"
        for name in ("source_rows", "valid_rows", "excluded_rows", "warnings", "errors",
                     "quality_score")
    ),
)

# Sources and the run log.
_RETURN_COLUMNS = '"RMA", "Order Reference", "Article", "Returned On", "Qty", "Refund"'
add("read_csv_source", f'select {_RETURN_COLUMNS}, "Reason" from returns_raw')
add("read_mixed_csv", f"""select {_RETURN_COLUMNS}, "Reason" || ' é' as "Reason" from returns_raw""")
add(
    "mixed_row_numbers",
    """select cast(source_row_number % 3 as varchar) as folder, count(*)::bigint as rows, true as dense
    from returns_raw group by 1""",
)
add(
    "with_trace",
    """select count(*) as rows, sum(o_orderkey)::bigint as key_total, true as dense
    from orders""",
)
add(
    "source_profile",
    """select 'returns' as dataset, 'csv' as file_type, 7 as column_count,
    'RMA, Order Reference, Article, Returned On, Qty, Refund, Reason' as columns,
    case source_row_number % 3 when 0 then ';' when 1 then ',' else chr(9) end as detected_delimiter,
    case source_row_number % 3 when 0 then 'UTF-8' when 1 then 'cp1252' else 'UTF-16' end as detected_encoding,
    count(*)::bigint as row_count, true as sized from returns_raw group by all""",
)
add(
    "load_sources",
    " union all ".join(
        f"select '{kind}' as dataset, '{form}' as file_type, count(*) as rows from {source}"
        for kind, form, source in (
            ("orders", "api", "orders_clean"), ("products", "parquet", "products_raw"),
            ("inventory", "parquet", "inventory_raw"), ("returns", "parquet", "returns_raw"),
            ("monthly_targets", "parquet", "monthly_targets_raw"),
        )
    ),
)
add(
    "run_ids",
    """select event_id, 'RUN-' || strftime(ts, '%Y%m%d') || '-' || case when place < 1000
    then lpad(cast(place as varchar), 3, '0') else cast(place as varchar) end as run_id
    from (select event_id, ts, row_number() over (partition by cast(ts as date)
      order by ts, event_id) as place from events) t""",
)
define(
    "latest",
    """select *, 'RUN-' || lpad(cast(user_id as varchar), 6, '0') as run_id,
    case event_type when 'signup' then 'Pending' when 'view' then 'Running'
      when 'purchase' then 'Completed' when 'click' then 'Completed with Warnings'
      else 'Failed' end as status, event_type in ('purchase', 'click') as reported
    from (select * from events qualify row_number() over (partition by user_id
      order by event_id desc) = 1) e where event_id % 17 <> 0""",
)
add("latest_runs", "select run_id, status, event_id as state_number from latest")
add(
    "list_runs",
    """select run_id, status, event_id as state_number from latest
    where status in ('Completed', 'Completed with Warnings', 'Failed')
      and ts >= timestamp '2024-01-02' order by ts desc, run_id desc limit 5000""",
)
add(
    "run_history",
    """select run_id, status, strftime(cast(ts as date) - 30, '%Y-%m-%d') || ' to '
      || strftime(ts, '%Y-%m-%d') as reporting_period, event_id + user_id as source_rows,
    event_id % 7 as excluded_rows, event_id % 3 as warnings, event_id % 2 as errors,
    case when reported and event_id % 3 = 0 then case when event_id % 2 = 0
        then event_id || '.xlsx' else 'Report' end
      when reported then 'File unavailable' else 'Not generated' end as output_file,
    case when reported and event_id % 3 = 0 then 'View details · Download'
      else 'View details' end as actions from latest""",
)
add(
    "run_details",
    """select run_id, 'orders.csv' as orders_file, 'theme' as settings,
    case when event_type = 'error' then 'Stopped: password=[redacted], Bearer [redacted]; retry' end
      as failure_summary from latest""",
)
add(
    "run_durations",
    """select run_id, case when s is null then 'Not recorded'
      when s < 60 then cast(cast(s as int) as varchar) || '.00 s'
      else cast(cast(s as int) // 60 as varchar) || 'm ' || cast(cast(s as int) % 60 as varchar)
        || 's' end as duration
    from (select run_id, case when event_id % 5 <> 0 then floor(value * 10) end as s
      from latest) t""",
)
add(
    "redact_text",
    """select event_id, 'user [REDACTED_EMAIL] sent [REDACTED_ORDER_RECORD] with '
    || 'Access-Token:[REDACTED]; secret=[REDACTED]; note kept' as message from events""",
)
