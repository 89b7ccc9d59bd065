"""SQL for the queries over the typed datasets."""

from __future__ import annotations

from oracles.base import (
    ALL_TIME,

    CHOICE,
    YEAR,
    define,
    kpis,
    money,
    percent,
    performance,
    with_ctes,
)

QUERIES: dict[str, str] = {}
_TRACE = "exclude (source_file, processing_status, exclusion_reason)"
_YEAR_ORDERS = YEAR.format(day="order_date")
_YEAR_RETURNS = YEAR.format(day="return_date")


def add(name: str, text: str) -> None:
    QUERIES[name] = with_ctes(text)


add("filter_orders", f"select * {_TRACE} from orders_clean where {CHOICE.format(day='order_date')}")
add("filter_returns", f"select * {_TRACE} from returns_clean where {_YEAR_RETURNS}")
add("completed_lines", f"select * {_TRACE} from orders_clean where order_status = 'completed'")
add(
    "matched_returns",
    f"""select * {_TRACE} from returns_clean r where exists (select 1 from orders_clean o
    where o.order_id = r.order_id and o.product_id = r.product_id
      and o.order_status = 'completed')""",
)
add(
    "line_refunds",
    """select order_id, product_id, sum(quantity)::bigint as returned_quantity,
    cast(sum(refund_amount) as decimal(26,6)) as refund_amount
    from returns_clean group by order_id, product_id""",
)
add(
    "sales_lines",
    """select order_id, product_id, order_date, quantity, unit_price, discount, gross_revenue,
    discount_amount, returned_quantity, refund_amount, net_revenue, cost_of_goods_sold,
    cast(net_revenue - cost_of_goods_sold as decimal(36,12)) as gross_profit from lines""",
)
add("sales_kpis", kpis("lines"))
add("sales_kpis_filtered", kpis("lines_choice"))
_WEEK = "cast(date_trunc('week', order_date) as date)"
add("daily_revenue", performance("lines", {"date": "order_date"}))
add("weekly_revenue", performance("lines", {"week_start": _WEEK}))
add("category_performance", performance("lines", {"category": "category"}))
add("country_performance", performance("lines", {"country": "country"}))
add("channel_performance", performance("lines", {"sales_channel": "sales_channel"}))
_PRODUCTS = performance("lines", {"product_id": "product_id", "product_name": "product_name"})
add("product_performance", _PRODUCTS)
for _name, _by in (("revenue", "net_revenue"), ("profit", "gross_profit")):
    add(
        f"top_products_by_{_name}",
        f"select * from ({_PRODUCTS}) t order by {_by} desc, product_id limit 10",
    )
add("category_chart", performance("lines", {"category": "category"}))
add("country_chart", performance("lines", {"country": "country"}))
add("channel_chart", performance("lines", {"sales_channel": "sales_channel"}))
add(
    "sales_analytics",
    " union all by name ".join(
        f"select '{name}' as dimension, cast({name} as varchar) as member, * exclude ({name}) "
        f"from ({performance('lines', {name: text})}) t"
        for name, text in (
            ("date", "order_date"), ("week_start", _WEEK), ("category", "category"),
            ("country", "country"), ("sales_channel", "sales_channel"),
        )
    ),
)


def _returned(scope: str) -> str:
    return f"""select r.*, o.product_name, o.category, o.country, o.sales_channel, o.currency,
  o.order_status, r.quantity as returned_quantity
from returns_clean r join sold o using (order_id, product_id)
where o.order_status = 'completed' and {scope.format(day="o.order_date")}
  and {scope.format(day="r.return_date")}"""


define("returned", _returned(ALL_TIME))
define("sold_lines", "select * from sold where order_status = 'completed'")
add("returns_with_order_attrs", f"select * {_TRACE} from returned")
_UNITS = "(select coalesce(sum(quantity), 0)::bigint from sold_lines)"
add(
    "returns_kpis",
    f"""select returned_quantity, refund_amount, {percent("returned_quantity", "units")}
    as return_rate_percent from (select coalesce(sum(returned_quantity), 0)::bigint as
      returned_quantity, {money("sum(refund_amount)")} as refund_amount, {_UNITS} as units
      from returned) t""",
)


def _reasons(source: str) -> str:
    return f"""select return_reason, count(distinct return_id) as returns,
    sum(returned_quantity)::bigint as returned_quantity, {money("sum(refund_amount)")} as
    refund_amount from {source} group by return_reason"""


def _rates(source: str, sold: str) -> str:
    rate = percent("returned_quantity", "units_sold")
    return f"""select *, {rate} as return_rate, {rate} as return_rate_percent from (
  select product_id, product_name, units_sold, coalesce(back, 0) as returned_quantity,
    {money("refund")} as refund_amount
  from (select product_id, min(product_name) as product_name, sum(quantity)::bigint as units_sold
    from {sold} group by product_id) s
  left join (select product_id, sum(returned_quantity)::bigint as back,
    sum(refund_amount) as refund from {source} group by product_id) b using (product_id)) t"""


add("return_reasons", _reasons("returned"))
add("product_return_rates", _rates("returned", "sold_lines"))
_RANKED = "order by return_rate_percent desc, returned_quantity desc, product_id limit"
add(
    "products_by_return_rate",
    f"select * from ({_rates('returned', 'sold_lines')}) r {_RANKED} 25",
)
add(
    "returns_analytics",
    f"""select 'reason' as part, return_reason as member, returned_quantity, refund_amount
    from ({_reasons("returned")}) a
    union all select * from (select 'product', product_id, returned_quantity, refund_amount
      from ({_rates("returned", "sold_lines")}) b {_RANKED} 10) c
    union all select 'total', null, coalesce(sum(returned_quantity), 0)::bigint,
      {money("sum(refund_amount)")} from returned""",
)

# Joins.
add(
    "safe_left_join",
    """select order_id, product_id, quantity, o.source_row_number, product_name, category
    from orders_clean o left join products_clean p using (product_id)""",
)
add("orders_enriched", f"select * {_TRACE} from sold")
_MONTH = "strftime(order_date, '%Y-%m')"
add(
    "orders_with_targets",
    f"""select o.source_row_number, order_id, product_id, {_MONTH} as reporting_month,
    revenue_target as target_revenue_target, profit_target as target_profit_target,
    orders_target as target_orders_target
    from orders_clean o left join monthly_targets_clean t on t.month = {_MONTH}""",
)
add("inventory_enriched", f"select * {_TRACE} from stocked")
add(
    "returns_enriched",
    """select r.* exclude (source_file, processing_status, exclusion_reason),
    o.order_date as original_order_date, o.quantity as sold_quantity,
    o.unit_price as original_unit_price, p.product_name as product_product_name,
    p.purchase_cost as product_purchase_cost, p.recommended_price as product_recommended_price,
    p.category as product_category, p.supplier as product_supplier, p.vat_rate as product_vat_rate
    from returns_clean r left join orders_first o using (order_id, product_id)
    left join products_clean p on p.product_id = r.product_id""",
)
define("some_products", "select * from products_clean where category <> 'PROMO'")
add(
    "orphan_orders",
    """select order_id, product_id, source_row_number from orders_clean
    where product_id not in (select product_id from some_products)""",
)
add(
    "orphan_inventory",
    """select product_id, warehouse, source_row_number from inventory_clean
    where product_id not in (select product_id from some_products)""",
)
add(
    "orphan_returns",
    """select return_id, order_id, source_row_number from returns_clean where order_id not in
    (select order_id from orders_clean where order_status = 'completed')""",
)
add(
    "order_references",
    """select order_id, product_id, sum(quantity)::bigint as sold_units,
    arg_min(order_date, source_row_number) as sold_on from orders_clean group by all""",
)
define(
    "actual",
    f"""select {_MONTH} as month, cast(sum(net_revenue) as decimal(38,12)) as actual_revenue
    from lines group by 1""",
)
add("monthly_actual", "select * from actual")
_RATIO = """cast(((2 * cast(round(actual_revenue, 8) * 100000000 as hugeint) * 1000000
    + cast(revenue_target * 100000000 as hugeint))
    // (2 * cast(revenue_target * 100000000 as hugeint))) as decimal(18,0)) * 0.000001"""
add(
    "target_achievement",
    f"""select month, revenue_target, actual_revenue, cast({_RATIO} as decimal(18,6))
    as target_achievement from (select t.month, revenue_target,
      coalesce(actual_revenue, cast(0 as decimal(38,12))) as actual_revenue
      from monthly_targets_clean t left join actual a using (month)) j""",
)
add(
    "target_bands",
    f"""select month, case when ratio >= 1.05 then 'exceeded' when ratio >= 1 then 'met'
      when ratio >= 0.9 then 'close' when ratio is not null then 'missed' end as target_band
    from (select month, {_RATIO} * 1.6 as ratio from (select t.month, revenue_target,
      coalesce(actual_revenue, cast(0 as decimal(38,12))) as actual_revenue
      from monthly_targets_clean t left join actual a using (month)) j) k""",
)
add(
    "product_bands",
    f"""select product_id, case when gross_profit < 0 then 'loss' when gross_profit > 0 then
    'profit' end as profit_band, case when gross_margin_percent < 32 then 'low' end as
    margin_band, case when return_rate_percent > 6 then 'high' end as return_band
    from ({_PRODUCTS}) t""",
)

# Periods and comparisons.
add(
    "resolve_period",
    """select min(order_date) as start, max(order_date) as end,
    cast(max(order_date) - min(order_date) + 1 as int) as days from orders_clean""",
)
add(
    "previous_period",
    f"""select cast(low - cast(high - low + 1 as int) as date) as start, cast(low - 1 as date)
    as end, cast(high - low + 1 as int) as days from (select min(order_date) as low,
    max(order_date) as high from orders_clean where {CHOICE.format(day="order_date")}) t""",
)
_METRICS = (
    "gross_revenue", "discount_amount", "net_revenue", "cost_of_goods_sold", "gross_profit",
    "gross_margin_percent", "orders", "units_sold", "average_order_value", "returned_quantity",
    "refund_amount", "return_rate_percent",
)
define("kpis_now", kpis("lines_year"))
define("kpis_before", kpis("lines_before"))


def _long(source: str, value: str) -> str:
    return " union all ".join(
        f"select '{name}' as metric, cast({name} as decimal(28,4)) as {value} from {source}"
        for name in _METRICS
    )


_GROWTH = """case when previous = 0 then case when current = 0 then 0 end
  else cast(sign(current - previous) * ((2 * cast(abs(current - previous) * 10000 as hugeint) * 10000
    + cast(abs(previous) * 10000 as hugeint)) // (2 * cast(abs(previous) * 10000 as hugeint)))
    as decimal(18,0)) * 0.01 end"""
_COMPARED = f"""cast(current - previous as decimal(28,4)) as absolute_difference,
  cast({_GROWTH} as decimal(18,2)) as percentage_difference"""
define(
    "compared",
    f"""select metric, current, previous, {_COMPARED},
    case when metric in ('gross_margin_percent', 'return_rate_percent')
      then cast(round(current - previous, 2) as decimal(18,2)) end as percentage_point_difference
    from ({_long("kpis_now", "current")}) a join ({_long("kpis_before", "previous")}) b
    using (metric)""",
)
add("period_comparison", "select * from compared")
_COUNTRY_NOW = performance("lines_year", {"country": "country"})
_COUNTRY_BEFORE = performance("lines_before", {"country": "country"})
add(
    "compare_values",
    f"""select country, current, previous, {_COMPARED}, cast(round(current - previous, 2)
      as decimal(18,2)) as percentage_point_difference
    from (select country, cast(a.return_rate_percent as decimal(28,4)) as current,
      cast(coalesce(b.return_rate_percent, 0) as decimal(28,4)) as previous
      from ({_COUNTRY_NOW}) a left join (select * from ({_COUNTRY_BEFORE}) x
        where country <> 'NATION_7') b using (country)) t""",
)
_CARDS = (
    "net_revenue|Net Revenue|1|0", "gross_profit|Gross Profit|1|0",
    "gross_margin_percent|Gross Margin|0|1", "orders|Orders|0|0", "units_sold|Units Sold|0|0",
    "average_order_value|Average Order Value|1|0", "return_rate_percent|Return Rate|0|1",
    "available_stock|Available Stock|0|0",
)
define(
    "cards",
    " union all ".join(
        f"select {place} as position, '{field}' as field, '{label}' as label, "
        f"{m} = 1 as monetary, {r} = 1 as rate"
        for place, (field, label, m, r) in enumerate((c.split("|") for c in _CARDS), start=1)
    ),
)
add(
    "kpi_cards",
    f"""select position, field, label, value, change, case when rate then 'percentage points'
      else 'percentage' end as comparison_type,
      case when change is null or change = 0 then 'neutral'
        when (change > 0) <> (field = 'return_rate_percent') then 'positive' else 'negative' end
      as direction, monetary, rate
    from (select c.*, v.value, case when rate then p.percentage_point_difference
        else p.percentage_difference end as change
      from cards c join ({_long("kpis_now", "value")} union all
        select 'available_stock', cast(sum(stock_quantity - reserved_quantity) as decimal(28,4))
        from inventory_clean) v on v.metric = c.field
      left join compared p on p.metric = c.field) t""",
)


def _ordinal(source: str, scope: str = "true") -> str:
    return f"""select row_number() over (order by date) as period_day, date, net_revenue from
    ({performance(source, {"date": "order_date"})}) d where {scope}"""


add(
    "current_vs_previous",
    f"""select cast(period_day as int) as period_day, a.net_revenue as current_period,
    b.net_revenue as previous_period from ({_ordinal("lines_year")}) a full join
    ({_ordinal("lines_before")}) b using (period_day)""",
)
add(
    "daily_with_previous",
    f"""select a.date, a.net_revenue, b.net_revenue as previous_period_revenue
    from ({_ordinal("lines_year")}) a left join ({_ordinal("lines_before")}) b
    using (period_day)""",
)
add(
    "comparison_long",
    f"""select period_day, 'current_period' as period, net_revenue from ({_ordinal("lines_year")})
    a union all select period_day, 'previous_period', net_revenue
    from ({_ordinal("lines_before", "date <= date '1997-09-30'")}) b""",
)


# Inventory and recommendations.
def velocity(orders: str, returns: str, scope: str) -> str:
    inside = scope.format(day="order_date")
    return f"""
select product_id, coalesce(sum(case when {inside} then quantity end), 0)::bigint as units_sold,
  cast(coalesce(sum(case when {inside} then net end), 0) as decimal(38,12)) as net_revenue,
  coalesce(sum(case when {inside} then returned end), 0)::bigint as returned_quantity,
  max(order_date) as last_sale_date
from (select o.product_id, o.order_date, o.quantity, coalesce(r.back, 0) as returned,
    cast(cast(o.quantity * o.unit_price as decimal(26,6)) - cast(cast(o.quantity * o.unit_price
      as decimal(26,6)) * coalesce(o.discount, 0) as decimal(36,12)) - coalesce(r.refund, 0)
      as decimal(36,12)) as net
  from {orders} o left join (select order_id, product_id, sum(quantity)::bigint as back,
    sum(refund_amount) as refund from {returns} where {scope.format(day="return_date")}
    group by order_id, product_id) r using (order_id, product_id)
  where o.order_status = 'completed' and o.product_id is not null) t group by product_id"""


def cutoff(source: str) -> str:
    """Three-quarter quantile of positive revenues, interpolated on exact decimals."""
    return f"""
select cast(a + (b - a) * share as decimal(38,12)) as cutoff from (
  select max(case when place = floor(0.75 * (n - 1)) then net_revenue end) as a,
    max(case when place = least(floor(0.75 * (n - 1)) + 1, n - 1) then net_revenue end) as b,
    max(cast((3 * (n - 1)) % 4 as decimal(4,0)) * 0.25) as share
  from (select cast(net_revenue as decimal(26,12)) as net_revenue, count(*) over () as n,
    row_number() over (order by net_revenue) - 1 as place from {source}
    where net_revenue > 0) ranked) t"""


def metrics(stock: str, velocity_cte: str, cutoff_cte: str, first: str, last: str, as_of: str) -> str:
    """Inventory metrics; thresholds are the defaults 7, 14, 120 and a 30-day target."""
    days = f"(cast({last} - {first} as bigint) + 1)"
    coverage = (
        f"cast(case when units > 0 then cast(sign(avail) * ((2 * abs(avail) * {days} * 100 + units)"
        " // (2 * units)) as decimal(18,0)) * 0.01 end as decimal(18,2))"
    )
    daily = f"cast(cast((2 * units * 10000 + {days}) // (2 * {days}) as decimal(18,0)) * 0.0001 as decimal(18,4))"
    return f"""
select product_id, warehouse, product_name, stock_quantity, reserved_quantity,
  avail as available_stock, reorder_level, {daily} as average_daily_sales,
  {coverage} as stock_coverage_days, avail <= reorder_level as reorder_alert,
  greatest(0, greatest(reorder_level, (units * 30 + {days} - 1) // {days}) - avail)::bigint
    as suggested_reorder_quantity,
  last_sale_date, cast({as_of} - last_sale_date as int) as days_since_last_sale,
  last_restock_date, cast({as_of} - last_restock_date as int) as days_since_last_restock,
  case when avail <= 0 then 'Out of Stock' when units <= 0 then 'No Sales Data'
    when avail * {days} <= 7 * units then 'Critical'
    when avail * {days} <= 14 * units then 'Low Stock'
    when avail * {days} > 120 * units then 'Overstock' else 'Healthy' end as inventory_status,
  units as units_sold, net_revenue, returned_quantity,
  {percent("returned_quantity", "units")} as return_rate_percent,
  cast(coalesce(cost, 0) as decimal(22,6)) as purchase_cost,
  cast(coalesce(price, 0) as decimal(22,6)) as selling_price,
  product_name is null or cost is null or price is null as catalogue_data_missing,
  net_revenue > 0 and net_revenue >= (select cutoff from {cutoff_cte}) as is_high_revenue,
  {first} as period_start, {last} as period_end, cast({days} as int) as period_days,
  {as_of} as as_of_date
from (select i.product_id, i.warehouse, i.product_product_name as product_name,
    coalesce(stock_quantity, 0) as stock_quantity, coalesce(reserved_quantity, 0) as
    reserved_quantity, coalesce(reorder_level, 0) as reorder_level,
    coalesce(stock_quantity, 0) - coalesce(reserved_quantity, 0) as avail, last_restock_date,
    product_purchase_cost as cost, product_recommended_price as price,
    coalesce(units_sold, 0) as units, last_sale_date,
    cast(coalesce(net_revenue, 0) as decimal(38,12)) as net_revenue,
    coalesce(returned_quantity, 0) as returned_quantity
  from {stock} i left join {velocity_cte} v using (product_id)) t"""


define("velocity", velocity("sold", "returns_clean", YEAR))
define("cutoff_year", cutoff("velocity"))
add("product_velocity", "select * from velocity")
add("revenue_cutoff", "select * from cutoff_year")
add(
    "inventory_period",
    """select min(order_date) as period_start, max(order_date) as period_end,
    greatest(max(order_date), (select max(last_restock_date) from inventory_clean)) as as_of_date,
    cast(max(order_date) - min(order_date) + 1 as int) as period_days from sold_lines""",
)
define(
    "metrics",
    metrics(
        "stocked", "velocity", "cutoff_year", "date '1998-01-01'", "date '1998-12-31'",
        "greatest(date '1998-12-31', (select max(last_restock_date) from inventory_clean))",
    ),
)
add("inventory_metrics", "select * from metrics")
add(
    "inventory_distribution",
    "select inventory_status, count(*) as products from metrics group by 1",
)
add("available_stock_total", "select sum(available_stock)::bigint as available_stock from metrics")
add(
    "inventory_exceptions",
    """select 'out_of_stock_and_critical' as exception, product_id, warehouse from metrics
      where inventory_status in ('Out of Stock', 'Critical')
    union all select 'below_reorder_level', product_id, warehouse from metrics
      where available_stock <= reorder_level
    union all select 'dead_stock', product_id, warehouse from metrics
      where days_since_last_sale >= 45 and available_stock > 0
    union all select 'overstock', product_id, warehouse from metrics
      where inventory_status = 'Overstock'
    union all select 'no_sales', product_id, warehouse from metrics where units_sold = 0""",
)
_TOP = """select * from (select '{by}' as ranking, product_id, warehouse, net_revenue,
  return_rate_percent from metrics order by {by} desc, product_id, warehouse limit 10) t{n}"""
add(
    "inventory_top",
    _TOP.format(by="net_revenue", n=1) + " union all "
    + _TOP.format(by="return_rate_percent", n=2),
)


def _plain(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"regexp_replace(regexp_replace({text}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _json(**parts: str) -> str:
    """JSON text of a map with the warehouse first; a null value is left out."""
    pieces = [
        f"coalesce(',\"{name}\":\"' || ({value}) || '\"', '')" for name, value in parts.items()
    ]
    return "'{\"warehouse\":\"' || warehouse || '\"' || " + " || ".join(pieces) + " || '}'"


_ACT = """case when suggested_reorder_quantity > 0 then 'Reorder ' || suggested_reorder_quantity
  || ' units.' else 'Schedule replenishment before the next sale.' end"""
_AVAIL = "cast(available_stock as varchar)"
_COVER = "cast(stock_coverage_days as varchar)"
_RATE = "cast(return_rate_percent as varchar)"
_IDLE = "cast(days_since_last_sale as varchar)"
_REACHED = """case when days_since_last_sale >= 90 then 90 when days_since_last_sale >= 60 then 60
  when days_since_last_sale >= 30 then 30 end"""
# test, type, severity, rule, explanation, metrics, action
_PER_ROW = (
    ("inventory_status = 'Out of Stock'", "inventory", "'critical'", "'INV_OUT_OF_STOCK'",
     "'Available stock is zero or negative.'", _json(available_stock=_AVAIL), _ACT),
    ("available_stock <= reorder_level", "inventory", "'warning'", "'INV_BELOW_REORDER_LEVEL'",
     "'Available stock is at or below the configured reorder level.'",
     _json(available_stock=_AVAIL, reorder_level="cast(reorder_level as varchar)",
           suggested_reorder_quantity="cast(suggested_reorder_quantity as varchar)"), _ACT),
    ("stock_coverage_days < 7", "inventory", "'critical'", "'INV_COVERAGE_LT_7'",
     f"'Stock coverage is only ' || {_COVER} || ' days, below the critical threshold.'",
     _json(stock_coverage_days=_COVER, threshold_days="'7'"), _ACT),
    ("stock_coverage_days >= 7 and stock_coverage_days < 14", "inventory", "'warning'",
     "'INV_COVERAGE_LT_14'",
     f"'Stock coverage is ' || {_COVER} || ' days, below the low-stock threshold.'",
     _json(stock_coverage_days=_COVER, threshold_days="'14'"), _ACT),
    ("stock_coverage_days > 120", "inventory", "'warning'", "'INV_COVERAGE_GT_120'",
     f"'Stock coverage is ' || {_COVER} || ' days, above the overstock threshold.'",
     _json(stock_coverage_days=_COVER, threshold_days="'120'"), "'Review excess stock.'"),
    ("available_stock > 0 and days_since_last_sale >= 30", "inventory",
     "case when days_since_last_sale >= 90 then 'critical' else 'warning' end",
     f"'INV_DEAD_STOCK_' || ({_REACHED})",
     f"'The product has not sold for ' || {_IDLE} || ' days.'",
     _json(days_since_last_sale=_IDLE, threshold_days=f"cast({_REACHED} as varchar)",
           available_stock=_AVAIL),
     "'Review excess stock and consider a markdown or transfer.'"),
)
_PER_PRODUCT = (
    ("is_high_revenue and inventory_status in ('Out of Stock', 'Critical')", "inventory",
     "'critical'", "'INV_HIGH_REVENUE_CRITICAL'",
     "'A high-revenue product has critically low stock.'",
     "'{\"warehouse\":\"' || warehouse || '\",\"net_revenue\":\"' || " + _plain("net_revenue")
     + " || '\",\"stock_coverage_days\":' || coalesce('\"' || " + _COVER + " || '\"', 'null') || '}'",
     _ACT),
    ("return_rate_percent > 10", "returns", "'warning'", "'RET_HIGH_RETURN_RATE'",
     f"'The product return rate is ' || {_RATE} || '%.'", _json(return_rate_percent=_RATE),
     f"'Investigate the ' || {_RATE} || '% return rate.'"),
    ("purchase_cost > selling_price", "pricing", "'critical'", "'PRICING_COST_ABOVE_SELLING'",
     "'Purchase cost is higher than the configured selling price.'",
     _json(purchase_cost=_plain("purchase_cost"), selling_price=_plain("selling_price")),
     "'Review supplier cost and update the selling price.'"),
    ("units_sold = 0", "sales", "'warning'", "'SALES_NO_SALES'",
     "'The product generated no completed sales in the analysis period.'",
     _json(units_sold="'0'", period_days="cast(period_days as varchar)", available_stock=_AVAIL),
     "'Review demand, listing visibility, and stocking strategy.'"),
    ("catalogue_data_missing", "catalogue", "'critical'", "'CATALOGUE_MISSING_DATA'",
     "'Required catalogue attributes are missing for this product.'",
     _json(catalogue_data_missing="'true'"),
     "'Update the product catalogue before including these orders.'"),
)


def _finding(rule: tuple[str, ...], once: bool, source: str) -> str:
    test, kind, severity, name, words, found, action = rule
    first = "qualify row_number() over (partition by product_id order by warehouse) = 1"
    return f"""select '{kind}' as recommendation_type, {severity} as severity, product_id,
  {words} as explanation, {found} as supporting_metrics, {action} as recommended_action,
  {name} as rule_identifier, warehouse from {source} where {test} {first if once else ''}"""


def findings(source: str) -> str:
    return " union all ".join(
        [_finding(rule, False, source) for rule in _PER_ROW]
        + [_finding(rule, True, source) for rule in _PER_PRODUCT]
    )


define("findings", findings("metrics"))
add("recommendations", "select * exclude (warehouse) from findings")
add(
    "filter_recommendations",
    """select severity, product_id, rule_identifier from findings
    where recommendation_type in ('returns', 'pricing', 'sales')""",
)
add("recommendation_counts", "select severity, count(*) as recommendations from findings group by 1")
add(
    "priority_alerts",
    """select * exclude (warehouse) from (select * from findings order by severity = 'warning',
    rule_identifier, product_id, warehouse limit 8) t""",
)

# Scopes and options.
_BRANDS = "('Brand#3', 'Brand#5')"
define(
    "brand_products",
    f"""select product_id from sold where supplier in {_BRANDS}
    union select product_id from stocked where product_supplier in {_BRANDS}""",
)
define("chosen_products", "select 'P' || range as product_id from range(0, 200, 3)")
define(
    "listed_products",
    "select * from brand_products intersect select product_id from chosen_products",
)
define(
    "held_products",
    """select distinct product_id from inventory_clean join brand_products using (product_id)
    where warehouse in ('W1', 'W2', 'W3', 'W5', 'W8')""",
)


def _counts(ids: str, inventory_scope: str = "true") -> str:
    return f"""select 'orders' as dataset, product_id, count(*) as rows from sold
      join {ids} using (product_id) group by 2
    union all select 'inventory', product_id, count(*) from inventory_clean
      join {ids} using (product_id) where {inventory_scope} group by 2
    union all select 'returns', product_id, count(*) from returns_clean
      join {ids} using (product_id) group by 2"""


add("catalogue_scope", _counts("listed_products"))
add("warehouse_scope", _counts("held_products", "warehouse in ('W1', 'W2', 'W3', 'W5', 'W8')"))
add(
    "filter_options",
    " union ".join(
        f"select '{label}' as dimension, {column} as value from {source} where {column} is not null"
        for label, column, source in (
            ("countries", "country", "sold"), ("categories", "category", "sold"),
            ("sales_channels", "sales_channel", "sold"), ("currencies", "currency", "sold"),
            ("order_statuses", "order_status", "sold"), ("suppliers", "supplier", "sold"),
            ("products", "product_id", "sold"), ("warehouses", "warehouse", "stocked"),
            ("suppliers", "product_supplier", "stocked"), ("products", "product_id", "stocked"),
        )
    )
    + """ union select 'minimum_date', cast(min(order_date) as varchar) from sold
    union select 'maximum_date', cast(max(order_date) as varchar) from sold""",
)

# Duplicates over typed tables.
add("dedupe_keep_first", f"select * {_TRACE} from orders_first")
add(
    "dedupe_keep_latest",
    """select * exclude (source_file, processing_status, exclusion_reason, n, best, place) from (
      select *, count(*) over k as n, max(return_date) over k as best,
        row_number() over (partition by product_id, return_reason
          order by return_date desc nulls last, source_row_number) as place
      from (select * replace (case when source_row_number % 3 <> 0 then return_date end
        as return_date) from returns_clean) r
      window k as (partition by product_id, return_reason)) t
    where n = 1 or (best is not null and place = 1)""",
)
add(
    "dedupe_exclude_all",
    """select * exclude (source_file, processing_status, exclusion_reason, n) from (select *,
    count(*) over (partition by order_id, product_id) as n from orders_clean) t where n = 1""",
)
_TYPED_ISSUE = """select '{severity}' as severity, '{kind}' as source_dataset,
  '{kind}' as source_filename, source_row_number as row_number, '{field}' as field,
  '{code}' as issue_code, {message} as message, {value} as original_value,
  '{action}' as recommended_action, {free} as row_can_continue
  from {source} where {test}"""
# Message and recommended action of each code.
_TEXTS = {
    "orders|missing_order_id": ("The order ID is missing.", "Provide a valid order ID."),
    "orders|missing_order_date": ("The order date is missing.", "Provide a valid order date."),
    "orders|invalid_quantity": (
        "Quantity must be a whole number.", "Replace the value with a positive whole number."),
    "orders|invalid_unit_price": ("Unit price must be numeric.", "Replace the value with a numeric unit price."),
    "orders|discount_out_of_range": (
        "Discount must be between 0 and 1.", "Enter the discount as a decimal between 0 and 1."),
    "orders|unsupported_currency": ("Currency 'DOGE' is not supported.", "Use one of: CHF, EUR, GBP, USD."),
    "products|recommended_price_below_cost": (
        "Recommended price is below purchase cost.",
        "Review pricing or confirm that the product is intentionally sold at a loss."),
    "products|duplicated_product_id": (
        "Product ID must be unique.", "Keep one product row for this ID or assign a unique ID."),
    "products|missing_product_name": ("Product name is missing.", "Provide a product name."),
    "products|invalid_vat_rate": ("VAT rate must be between 0 and 1.", "Enter VAT as a decimal between 0 and 1."),
    "inventory|unknown_product_id": (
        "Inventory references an unknown product ID.",
        "Add the product to the catalogue or correct the product ID."),
    "inventory|reserved_quantity_exceeds_stock": (
        "Reserved quantity is greater than available stock.",
        "Reduce the reserved quantity or correct the stock quantity."),
    "inventory|negative_stock": (
        "Stock quantity cannot be negative.", "Enter a stock quantity greater than or equal to zero."),
    "inventory|negative_reorder_level": (
        "Reorder level cannot be negative.", "Enter a reorder level greater than or equal to zero."),
    "inventory|invalid_restock_date": ("Last restock date is invalid.", "Use a valid date such as YYYY-MM-DD."),
    "returns|unknown_order_id": (
        "Return references an unknown order ID.", "Correct the order ID or add the referenced order."),
    "returns|unknown_product_id": (
        "Return references an unknown product ID.", "Correct the product ID or add the referenced product."),
    "returns|invalid_return_quantity": (
        "Return quantity must be a positive whole number.", "Enter a positive whole-number return quantity."),
    "returns|negative_refund_amount": (
        "Refund amount cannot be negative.", "Enter a refund amount greater than or equal to zero."),
    "returns|return_date_before_order_date": (
        "Return date is before the matching order date.", "Correct the return date or matching order reference."),
    "returns|returned_quantity_exceeds_sold": (
        "Returned quantity is greater than the sold quantity.",
        "Reduce the return quantity or correct the matching order."),
    "monthly_targets|invalid_month": (
        "Target month must use YYYY-MM format.", "Enter a valid month such as 2025-01."),
    "monthly_targets|duplicate_target_month": (
        "Target month must be unique.", "Keep one target row for this month."),
    **{
        f"monthly_targets|negative_target|{field}": (
            f"{label} cannot be negative.", "Enter a target greater than or equal to zero.")
        for field, label in (
            ("revenue_target", "Revenue Target"), ("profit_target", "Profit Target"), ("orders_target", "Orders Target"))
    },
}
define(
    "returns_with_sales",
    """select r.*, o.sold_on, o.sold_units from returns_clean r left join (select order_id,
    product_id, sum(quantity) as sold_units, arg_min(order_date, source_row_number) as sold_on
    from orders_clean group by all) o using (order_id, product_id)""",
)


def _typed(kind, code, field, test, value, source, severity="error", free="false") -> str:
    texts = _TEXTS.get(f"{kind}|{code}") or _TEXTS[f"{kind}|{code}|{field}"]
    message, action = (text.replace("'", "''") for text in texts)
    return _TYPED_ISSUE.format(
        kind=kind, code=code, field=field, test=test, value=value, source=source,
        severity=severity, free=free, message=f"'{message}'", action=action,
    )


_NOT_LISTED = "product_id not in (select product_id from some_products)"
add(
    "validate_all",
    " union all ".join(
        [
            _typed("products", "recommended_price_below_cost", "recommended_price",
                   "recommended_price < purchase_cost", _plain("recommended_price"),
                   "some_products", "warning", "true"),
            _typed("inventory", "unknown_product_id", "product_id", _NOT_LISTED, "product_id",
                   "inventory_clean"),
            _typed("inventory", "reserved_quantity_exceeds_stock", "reserved_quantity",
                   "reserved_quantity > stock_quantity", "cast(reserved_quantity as varchar)",
                   "inventory_clean"),
            _typed("returns", "unknown_product_id", "product_id", _NOT_LISTED, "product_id",
                   "returns_with_sales"),
            _typed("returns", "return_date_before_order_date", "return_date",
                   "return_date < sold_on", "cast(return_date as varchar)", "returns_with_sales"),
            _typed("returns", "returned_quantity_exceeds_sold", "quantity",
                   "quantity > sold_units", "cast(quantity as varchar)", "returns_with_sales"),
        ]
    ),
)


def _as_text(kind: str, planted: dict[str, tuple[int, str]]) -> str:
    """A typed table as text in which every so-manieth row holds something else."""
    cells = ", ".join(
        f"case when source_row_number % {every} = 3 then {value} else cast({name} as varchar) end as {name}"
        for name, (every, value) in planted.items()
    )
    return f"select * exclude ({', '.join(planted)}), {cells} from {kind}_clean"


define("orders_planted", _as_text("orders", {
    "order_id": (89, "''"), "order_date": (97, "null"), "currency": (101, "'doge'"), "discount": (103, "'1500'"),
    "quantity": (107, "'1.5'"), "unit_price": (109, "'free'"),
}))
define("products_text", _as_text("products", {"vat_rate": (29, "'1.2'"), "product_name": (31, "' '")}))
define("products_planted", """select * from products_text union all
    select * replace (source_row_number + 1000000000 as source_row_number) from products_text
    where source_row_number % 37 = 3""")
define("inventory_planted", _as_text("inventory", {
    "last_restock_date": (113, "'soon'"), "stock_quantity": (127, "'-1'"), "reorder_level": (131, "'-7'"),
}))
define("returns_planted", f"""select r.*, o.sold_on, o.sold_units from ({_as_text("returns", {
    "return_date": (137, "'1989-12-31'"), "quantity": (139, "'0'"), "refund_amount": (149, "'-0.01'"),
    "order_id": (151, "'O-NONE'"),
})}) r left join (
    select order_id, product_id, sum(cast(quantity as double)) as sold_units,
      arg_min_null(cast(order_date as date), source_row_number) as sold_on
    from orders_planted where order_id <> '' group by all) o using (order_id, product_id)""")
define("targets_text", _as_text("monthly_targets", {
    "month": (7, "'2031-13'"), "revenue_target": (11, "'-1'"), "profit_target": (13, "'-0.5'"),
    "orders_target": (5, "'-2'"),
}))
define("targets_planted", """select * from targets_text union all
    select * replace (source_row_number + 1000000000 as source_row_number) from targets_text
    where source_row_number % 17 = 4""")
_ORIGINAL_DATE = "case when return_date = '1989-12-31' then '12/31/1989' else return_date end"
_PLANTED = [
    ("orders", "missing_order_id", "order_id", "order_id = ''", "order_id", "orders_planted"),
    ("orders", "missing_order_date", "order_date", "order_date is null", "order_date", "orders_planted"),
    ("orders", "invalid_quantity", "quantity", "quantity = '1.5'", "quantity", "orders_planted"),
    ("orders", "invalid_unit_price", "unit_price", "unit_price = 'free'", "unit_price", "orders_planted"),
    ("orders", "discount_out_of_range", "discount", "discount = '1500'", "discount", "orders_planted"),
    ("orders", "unsupported_currency", "currency", "currency = 'doge'", "currency", "orders_planted"),
    ("products", "duplicated_product_id", "product_id",
     "product_id in (select product_id from products_planted group by 1 having count(*) > 1)", "product_id",
     "products_planted"),
    ("products", "missing_product_name", "product_name", "product_name = ' '", "product_name", "products_planted"),
    ("products", "recommended_price_below_cost", "recommended_price",
     "cast(recommended_price as double) < cast(purchase_cost as double)", "cast(recommended_price as varchar)",
     "products_planted", "warning", "true"),
    ("products", "invalid_vat_rate", "vat_rate", "vat_rate = '1.2'", "vat_rate", "products_planted"),
    ("inventory", "invalid_restock_date", "last_restock_date", "last_restock_date = 'soon'", "last_restock_date",
     "inventory_planted"),
    ("inventory", "negative_stock", "stock_quantity", "cast(stock_quantity as bigint) < 0", "stock_quantity",
     "inventory_planted"),
    ("inventory", "negative_reorder_level", "reorder_level", "reorder_level = '-7'", "reorder_level",
     "inventory_planted"),
    ("inventory", "reserved_quantity_exceeds_stock", "reserved_quantity",
     "cast(reserved_quantity as bigint) > cast(stock_quantity as bigint)", "cast(reserved_quantity as varchar)",
     "inventory_planted"),
    ("returns", "unknown_order_id", "order_id",
     "order_id not in (select order_id from orders_planted where order_id <> '')", "order_id", "returns_planted"),
    ("returns", "invalid_return_quantity", "quantity", "quantity = '0'", "quantity", "returns_planted"),
    ("returns", "negative_refund_amount", "refund_amount", "cast(refund_amount as double) < 0", "refund_amount",
     "returns_planted"),
    ("returns", "return_date_before_order_date", "return_date", "cast(return_date as date) < sold_on",
     _ORIGINAL_DATE, "returns_planted"),
    ("returns", "returned_quantity_exceeds_sold", "quantity", "cast(quantity as double) > sold_units", "quantity",
     "returns_planted"),
    ("monthly_targets", "invalid_month", "month", "month = '2031-13'", "month", "targets_planted"),
    ("monthly_targets", "duplicate_target_month", "month",
     "month in (select month from targets_planted group by 1 having count(*) > 1)", "month", "targets_planted"),
    *[
        ("monthly_targets", "negative_target", field, f"cast({field} as double) < 0", field, "targets_planted")
        for field in ("revenue_target", "profit_target", "orders_target")
    ],
]
add(
    "validate_planted",
    f"""select source_dataset, field, issue_code, severity, message, count(*) as issues,
    sum(row_number)::bigint as row_total, min(original_value) as least_value
    from ({" union all ".join(_typed(*entry) for entry in _PLANTED)}) found group by all""",
)
_COUNTRY_ALL = performance("lines", {"country": "country"})
add(
    "section_totals",
    f"""select * from ({_COUNTRY_ALL}) a union all by name select 'Total' as country,
    sum(gross_revenue)::decimal(28,2) as gross_revenue,
    sum(discount_amount)::decimal(28,2) as discount_amount,
    sum(refund_amount)::decimal(28,2) as refund_amount,
    sum(net_revenue)::decimal(28,2) as net_revenue,
    sum(cost_of_goods_sold)::decimal(28,2) as cost_of_goods_sold,
    sum(gross_profit)::decimal(28,2) as gross_profit, sum(orders)::bigint as orders,
    sum(units_sold)::bigint as units_sold, sum(returned_quantity)::bigint as returned_quantity
    from ({_COUNTRY_ALL}) b""",
)
add(
    "write_table",
    f"""select sales_channel, cast(net_revenue as varchar) as net_revenue,
    cast(orders as varchar) as orders, cast(units_sold as varchar) as units_sold
    from ({performance("lines", {"sales_channel": "sales_channel"})}) t""",
)
add(
    "read_api_pages",
    """select order_id, cast(order_date as varchar) as order_date, product_id,
    cast(quantity as varchar) as quantity, cast(unit_price as varchar) as unit_price
    from orders_clean""",
)
