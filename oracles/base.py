"""Common table expressions and SQL helpers for the comparison queries."""

from __future__ import annotations

import re

from tillwise.sources.sample import CLEAN, RAW

_NUMBERED = {"{lineitem}": "lineitem_rn", "{part}": "part_rn", "{orders}": "orders_rn"}


def shared(text: str) -> str:
    """Shared dataset SQL with this engine's table names and quotes."""
    for mark, name in _NUMBERED.items():
        text = text.replace(mark, name)
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("`", '"')


CTES: dict[str, str] = {
    name: f"select *, row_number() over () - 1 as rn from {name[:-3]}"
    for name in ("lineitem_rn", "part_rn", "orders_rn")
}
for kind, text in CLEAN.items():
    CTES[f"{kind}_clean"] = shared(text)
for kind, text in RAW.items():
    CTES[f"{kind}_raw"] = shared(text)

CTES["orders_first"] = """select * from orders_clean qualify row_number() over
  (partition by order_id, product_id order by source_row_number) = 1"""
CTES["sold"] = """select o.*, p.product_name, p.purchase_cost, p.recommended_price, p.category,
  p.supplier, p.vat_rate from orders_first o left join products_clean p using (product_id)"""
CTES["stocked"] = """select i.*, p.product_name as product_product_name,
  p.purchase_cost as product_purchase_cost, p.recommended_price as product_recommended_price,
  p.category as product_category, p.supplier as product_supplier, p.vat_rate as product_vat_rate
  from inventory_clean i left join products_clean p using (product_id)"""

ALL_TIME = "true"
YEAR = "{day} between date '1998-01-01' and date '1998-12-31'"
BEFORE = "{day} between date '1997-01-01' and date '1997-12-31'"
CHOICE_DAYS = "{day} between date '1997-01-01' and date '1999-12-31'"
CHOICE = (
    CHOICE_DAYS + " and country in ('NATION_1', 'NATION_2', 'NATION_4', 'NATION_8')"
    " and sales_channel in ('2-HIGH', '5-LOW') and currency = 'USD'"
    " and order_status = 'completed'"
)


def lines(orders: str, returns: str, scope: str, return_scope: str | None = None) -> str:
    """Completed lines in scope with refunds dated in scope."""
    dated = (return_scope or scope).format(day="return_date")
    return f"""
select o.*, coalesce(r.returned, 0) as returned_quantity,
  cast(coalesce(r.refund, 0) as decimal(26,6)) as refund_amount,
  cast(o.quantity * o.unit_price as decimal(26,6)) as gross_revenue,
  cast(o.quantity * coalesce(o.purchase_cost, 0) as decimal(26,6)) as cost_of_goods_sold,
  cast(cast(o.quantity * o.unit_price as decimal(26,6)) * coalesce(o.discount, 0)
    as decimal(36,12)) as discount_amount,
  cast(cast(o.quantity * o.unit_price as decimal(26,6))
    - cast(cast(o.quantity * o.unit_price as decimal(26,6)) * coalesce(o.discount, 0)
      as decimal(36,12)) - coalesce(r.refund, 0) as decimal(36,12)) as net_revenue
from {orders} o left join (
  select order_id, product_id, sum(quantity)::bigint as returned, sum(refund_amount) as refund
  from {returns} where {dated} group by order_id, product_id) r using (order_id, product_id)
where {scope.format(day="o.order_date")} and lower(o.order_status) = 'completed'"""


CTES["lines"] = lines("sold", "returns_clean", ALL_TIME)
CTES["lines_year"] = lines("sold", "returns_clean", YEAR)
CTES["lines_before"] = lines("sold", "returns_clean", BEFORE)
CTES["lines_choice"] = lines("sold", "returns_clean", CHOICE, CHOICE_DAYS)


def define(name: str, text: str) -> None:
    CTES[name] = text


def with_ctes(text: str) -> str:
    """Prefix a query with the expressions it needs, in order of definition."""
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", body):
                needed.add(name)
                visit(CTES[name])

    visit(text)
    parts = [f"{name} as materialized ({CTES[name]})" for name in CTES if name in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + text


def whole(value: str) -> str:
    """Scaled integer of a money sum; the sample needs at most six places."""
    return f"cast({value} * 1000000 as hugeint)"


def rounded(top: str, bottom: str) -> str:
    """Integer quotient rounded half away from zero."""
    return (
        f"(sign({top}) * sign({bottom}) * "
        f"((2 * abs({top}) + abs({bottom})) // (2 * abs({bottom}))))"
    )


def percent(top: str, bottom: str, money: bool = False) -> str:
    n, d = (whole(top), whole(bottom)) if money else (f"cast({top} as hugeint)", f"cast({bottom} as hugeint)")
    share = rounded(f"({n} * 10000)", f"({d})")
    return (
        f"cast(case when {d} = 0 then 0 else cast({share} as decimal(18,0)) * 0.01 end "
        "as decimal(18,2))"
    )


def money(value: str) -> str:
    return f"cast(round(coalesce({value}, 0), 2) as decimal(28,2))"


def per_order(total: str, count: str) -> str:
    """Cents per order, rounded half up on exact integers."""
    share = rounded(whole(total), f"(cast({count} as hugeint) * 10000)")
    return (
        f"cast(case when {count} = 0 then 0 else cast({share} as decimal(20,0)) * 0.01 end "
        "as decimal(28,2))"
    )


_NET = "(g - d - f)"
_PROFIT = "(g - d - f - c)"
KPIS = {
    "gross_revenue": money("g"),
    "discount_amount": money("d"),
    "refund_amount": money("f"),
    "net_revenue": money(_NET),
    "cost_of_goods_sold": money("c"),
    "gross_profit": money(_PROFIT),
    "gross_margin_percent": percent(_PROFIT, _NET, True),
    "orders": "orders",
    "units_sold": "units",
    "average_order_value": per_order(_NET, "orders"),
    "returned_quantity": "returned",
    "return_rate_percent": percent("returned", "units"),
}


def sums(source: str, groups: dict[str, str] | None = None) -> str:
    keys = "".join(f"{expression} as {name}, " for name, expression in (groups or {}).items())
    by = f" group by {', '.join(groups.values())}" if groups else ""
    return f"""(select {keys}
  cast(coalesce(sum(gross_revenue), 0) as decimal(38,12)) as g,
  cast(coalesce(sum(discount_amount), 0) as decimal(38,12)) as d,
  cast(coalesce(sum(refund_amount), 0) as decimal(38,12)) as f,
  cast(coalesce(sum(cost_of_goods_sold), 0) as decimal(38,12)) as c,
  count(distinct order_id) as orders, coalesce(sum(quantity), 0)::bigint as units,
  coalesce(sum(returned_quantity), 0)::bigint as returned from {source}{by})"""


def kpis(source: str) -> str:
    return (
        "select " + ", ".join(f"{text} as {name}" for name, text in KPIS.items())
        + f" from {sums(source)} s"
    )


def performance(source: str, groups: dict[str, str]) -> str:
    columns = {name: text for name, text in KPIS.items() if name != "average_order_value"}
    columns["gross_margin"] = KPIS["gross_margin_percent"]
    columns["return_rate"] = KPIS["return_rate_percent"]
    picked = ", ".join(f"{text} as {name}" for name, text in columns.items())
    return f"select {', '.join(groups)}, {picked} from {sums(source, groups)} s"
