"""The star-schema sample tables as retail datasets.

Each dataset is one SELECT in the SQL that Spark and other engines share. ``CLEAN`` holds
typed canonical tables. ``RAW`` holds text tables with source headings, mixed formats and
planted errors, so that mapping, cleaning, and validation have work to do. Row numbers are
the row positions of the Parquet file (``rn``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.staging import deal_by_size

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_TRACE = (
    "'{file}' as source_file, cast({row} + 2 as bigint) as source_row_number, "
    "'pending' as processing_status, cast(null as string) as exclusion_reason"
)


def _trace(file: str, row: str) -> str:
    return _TRACE.replace("{file}", file).replace("{row}", row)


_LINES = """
  from {lineitem} l
  join {orders} o on l.l_orderkey = o.o_orderkey
  join {part} p on l.l_partkey = p.p_partkey
"""
_CUSTOMERS = """
  join {customer} c on o.o_custkey = c.c_custkey
  join {nation} n on c.c_nationkey = n.n_nationkey
"""
_MONTH = (
    "concat(cast(year(o_orderdate) as string), '-', "
    "lpad(cast(month(o_orderdate) as string), 2, '0'))"
)

CLEAN = {
    "orders": f"""
select concat('O', cast(l.l_orderkey as string)) as order_id,
  cast(o.o_orderdate as date) as order_date,
  concat('P', cast(l.l_partkey as string)) as product_id,
  cast(l.l_quantity as bigint) as quantity,
  cast(p.p_retailprice as decimal(22,6)) as unit_price,
  concat('C', cast(o.o_custkey as string)) as customer_id,
  cast(l.l_discount as decimal(9,6)) as discount,
  case when n.n_nationkey % 4 = 0 then 'EUR' else 'USD' end as currency,
  n.n_name as country, o.o_orderpriority as sales_channel,
  case when o.o_orderstatus = 'P' then 'pending' else 'completed' end as order_status,
  {_trace("orders", "l.rn")}
{_LINES}{_CUSTOMERS}""",
    "products": f"""
select concat('P', cast(p_partkey as string)) as product_id, p_name as product_name,
  cast(cast(p_retailprice as decimal(18,2)) * 0.6 as decimal(22,6)) as purchase_cost,
  cast(cast(p_retailprice as decimal(18,2))
    * case when p_partkey % 37 = 5 then 0.5 else 1.0 end as decimal(22,6)) as recommended_price,
  case when p_partkey % 41 = 7 then null else p_type end as category,
  p_brand as supplier, cast(0.2 as decimal(9,6)) as vat_rate,
  {_trace("products", "rn")}
from {{part}}""",
    "inventory": f"""
select concat('P', cast(l_partkey as string)) as product_id,
  concat('W', cast(l_suppkey as string)) as warehouse,
  cast(case l_partkey % 5 when 0 then l_suppkey % 4 when 1 then l_suppkey % 9
    when 2 then l_suppkey % 30 when 3 then (l_partkey + l_suppkey) % 60
    else (l_partkey * 7 + l_suppkey * 13) % 300 end as bigint) as stock_quantity,
  cast((l_partkey + l_suppkey) % 3 as bigint) as reserved_quantity,
  cast((l_partkey * 3) % 25 as bigint) as reorder_level,
  make_date(2001, cast(1 + (l_partkey + l_suppkey) % 7 as int), cast(1 + l_partkey % 28 as int))
    as last_restock_date,
  {_trace("inventory", "min(rn)")}
from {{lineitem}} group by l_partkey, l_suppkey""",
    "returns": f"""
select concat('R', cast(l.rn as string)) as return_id,
  concat('O', cast(l.l_orderkey as string)) as order_id,
  concat('P', cast(l.l_partkey as string)) as product_id,
  cast(o.o_orderdate as date) + (1 + l.l_linenumber) as return_date,
  cast(1 + l.l_linenumber % cast(l.l_quantity as int) as bigint) as quantity,
  cast(cast(1 + l.l_linenumber % cast(l.l_quantity as int) as decimal(10,0))
    * cast(p.p_retailprice as decimal(12,2)) * (1 - cast(l.l_discount as decimal(4,2)))
    as decimal(22,6)) as refund_amount,
  case when l.rn % 11 = 0 then null when l.l_linestatus = 'F' then 'Damaged'
    when l.l_linenumber = 1 then 'Late' else 'Wrong size' end as return_reason,
  {_trace("returns", "l.rn")}
{_LINES} where l.l_returnflag = 'R'""",
    "monthly_targets": f"""
select month, cast(round(total * 1.05, 2) as decimal(22,6)) as revenue_target,
  cast(round(total * 0.4, 2) as decimal(22,6)) as profit_target,
  cast(orders as bigint) as orders_target,
  {_trace("monthly_targets", "row_number() over (order by month) - 1")}
from (select {_MONTH} as month, sum(cast(o_totalprice as decimal(18,2))) as total,
    count(*) as orders
  from {{orders}} group by {_MONTH}) by_month""",
}


def _day(column: str, style: str) -> str:
    year = f"cast(year({column}) as string)"
    month = f"cast(month({column}) as string)"
    day = f"cast(day({column}) as string)"
    padded = f"lpad({month}, 2, '0')", f"lpad({day}, 2, '0')"
    if style == "iso":
        return f"concat({year}, '-', {padded[0]}, '-', {padded[1]})"
    if style == "stamp":
        return f"concat({year}, '-', {padded[0]}, '-', {padded[1]}, ' 00:00:00')"
    if style == "slash":
        return f"concat({day}, '/', {month}, '/', {year})"
    return f"concat({padded[1]}, '.', {padded[0]}, '.', {year})"


_PRICE = "cast(cast(p_retailprice as decimal(12,2)) as string)"
_DISCOUNT = "cast(cast(l.l_discount as decimal(4,2)) as string)"
_PERCENT = "concat(cast(cast(round(l.l_discount * 100) as int) as string), '%')"
_QUANTITY = "cast(cast(l.l_quantity as int) as string)"
_RETURNED = "(1 + l.l_linenumber % cast(l.l_quantity as int))"
_STOCK = """(case l_partkey % 5 when 0 then l_suppkey % 4 when 1 then l_suppkey % 9
    when 2 then l_suppkey % 30 when 3 then (l_partkey + l_suppkey) % 60
    else (l_partkey * 7 + l_suppkey * 13) % 300 end)"""

RAW = {
    "orders": f"""
select case when l.rn % 263 = 12 then null
    else concat('  O', cast(l.l_orderkey as string), ' ') end as `Order Number`,
  case when l.rn % 241 = 6 then 'yesterday' when l.rn % 251 = 8 then null
    when l.rn % 4 = 0 then {_day("o.o_orderdate", "iso")}
    when l.rn % 4 = 1 then {_day("o.o_orderdate", "slash")}
    when l.rn % 4 = 2 then {_day("o.o_orderdate", "dots")}
    else {_day("o.o_orderdate", "stamp")} end as `Date`,
  case when l.rn % 269 = 13 then null when l.rn % 271 = 14 then 'P-UNKNOWN'
    else concat(' P', cast(l.l_partkey as string)) end as `SKU`,
  case when l.rn % 197 = 3 then 'many' when l.rn % 199 = 4 then '0'
    when l.rn % 229 = 9 then null when l.rn % 233 = 11 then '2.5'
    when l.rn % 5 = 0 then concat(' ', {_QUANTITY}, ' ')
    when l.rn % 5 = 1 then concat({_QUANTITY}, '.0') else {_QUANTITY} end as `Qty`,
  case when l.rn % 211 = 5 then 'n/a' when l.rn % 223 = 7 then null
    when l.rn % 227 = 3 then '-5.00'
    when l.rn % 7 = 0 then replace({_PRICE}, '.', ',')
    when l.rn % 7 = 1 then concat('$ ', {_PRICE})
    when l.rn % 7 = 2 then concat('0.', replace({_PRICE}, '.', ','))
    when l.rn % 7 = 3 then concat('0,', {_PRICE}) else {_PRICE} end as `Price`,
  concat('C', cast(o.o_custkey as string)) as customer_id,
  case when l.rn % 239 = 1 then '15' when l.rn % 13 = 2 then null
    when l.rn % 3 = 0 then {_PERCENT}
    when l.rn % 3 = 1 then replace({_DISCOUNT}, '.', ',') else {_DISCOUNT} end as `Discount Rate`,
  case when l.rn % 257 = 10 then 'XYZ' when l.rn % 6 = 0 then 'eur'
    when l.rn % 6 = 2 then null when l.rn % 6 = 3 then 'GBP'
    when l.rn % 6 = 4 then ' USD ' else 'usd' end as `Currency Code`,
  case n.n_nationkey when 0 then 'uk' when 1 then ' Deutschland ' when 2 then 'U.S.'
    when 3 then 'great   britain' when 4 then 'hellas' when 5 then 'new-land  o''neil'
    else n.n_name end as `Market`,
  case o.o_orderpriority when '1-URGENT' then 'Online' when '2-HIGH' then ' STORE '
    when '3-MEDIUM' then 'E-Commerce' when '4-NOT SPECIFIED' then 'pop_up  Shop'
    else o.o_orderpriority end as `Channel`,
  case o.o_orderstatus when 'F' then 'Complete' when 'O' then ' PAID '
    else 'in_progress' end as `Status`,
  concat('line ', cast(l.l_linenumber as string)) as `Note`,
  {_trace("orders", "l.rn")}
{_LINES}{_CUSTOMERS}""",
    "products": f"""
select product_id as `Product Code`, product_name as `Product`, purchase_cost as `Cost`,
  recommended_price as `RRP`, category as `Product Category`, supplier as `Vendor`,
  vat_rate as `VAT`, {_trace("products", "rn")}
from (
  select concat('P', cast(p_partkey as string), ' ') as product_id,
    case when rn % 101 = 3 then null else concat('  ', p_name) end as product_name,
    case when rn % 103 = 4 then 'free' when rn % 107 = 5 then '-1' when rn % 109 = 6 then null
      else cast(cast(cast(p_retailprice as decimal(18,2)) * 0.6 as decimal(12,2)) as string)
      end as purchase_cost,
    case when rn % 29 = 7 then '1,5' else concat('€', {_PRICE}) end as recommended_price,
    p_type as category, concat(p_brand, '  ') as supplier,
    case when rn % 113 = 8 then '1.5' when rn % 2 = 0 then '20%' else '0,2' end as vat_rate, rn
  from {{part}}
  union all
  select concat('P', cast(p_partkey as string)), 'second copy', '1', '2', p_type, p_brand, '5%',
    rn + 1000000000
  from {{part}} where p_partkey % 50 = 0
) copies""",
    "inventory": f"""
select case when row % 307 = 5 then 'P-UNKNOWN' when row % 311 = 6 then null
    else concat('P', cast(l_partkey as string)) end as `SKU`,
  concat(' W', cast(l_suppkey as string)) as `Location`,
  case when row % 313 = 7 then '-4' when row % 317 = 8 then 'lots'
    else cast({_STOCK} as string) end as `On Hand`,
  case when row % 331 = 9 then '100000' when row % 337 = 2 then '-1'
    else cast((l_partkey + l_suppkey) % 3 as string) end as `Reserved`,
  case when row % 347 = 4 then '-2' when row % 9 = 1 then null
    else cast((l_partkey * 3) % 25 as string) end as `Reorder Point`,
  case when row % 349 = 3 then 'soon' when row % 17 = 4 then null
    else concat(cast(1 + l_partkey % 28 as string), '/',
      cast(1 + (l_partkey + l_suppkey) % 7 as string), '/2001') end as `Last Restock`,
  {_trace("inventory", "row")}
from (select l_partkey, l_suppkey, min(rn) as row from {{lineitem}} group by l_partkey, l_suppkey)
  pairs""",
    "returns": f"""
select concat('R', cast(case when l.rn % 97 = 1 then l.rn - 1 else l.rn end as string))
    as `RMA`,
  case when l.rn % 83 = 5 then 'O-MISSING' when l.rn % 367 = 4 then null
    else concat('O', cast(l.l_orderkey as string)) end as `Order Reference`,
  case when l.rn % 89 = 6 then 'P-UNKNOWN'
    else concat('P', cast(l.l_partkey as string)) end as `Article`,
  case when l.rn % 353 = 2 then 'never'
    when l.rn % 61 = 2 then {_day("(cast(o.o_orderdate as date) - 5)", "iso")}
    else {_day("(cast(o.o_orderdate as date) + (1 + l.l_linenumber))", "slash")} end
    as `Returned On`,
  case when l.rn % 59 = 1 then cast({_RETURNED} + 100 as string)
    when l.rn % 359 = 7 then '0' else cast({_RETURNED} as string) end as `Qty`,
  case when l.rn % 373 = 8 then '-3,5' when l.rn % 379 = 9 then null
    else replace(cast(cast(cast({_RETURNED} as decimal(10,0)) * cast(p.p_retailprice as
      decimal(12,2)) * (1 - cast(l.l_discount as decimal(4,2))) as decimal(18,2)) as string),
      '.', ',') end as `Refund`,
  case when l.rn % 11 = 0 then null when l.l_linestatus = 'F' then ' Damaged '
    when l.l_linenumber = 1 then 'Late' else 'Wrong size' end as `Reason`,
  {_trace("returns", "l.rn")}
{_LINES} where l.l_returnflag = 'R'""",
    "monthly_targets": f"""
select month as `Period`, goal as `Revenue Goal`, profit as `Profit Goal`,
  volume as `Order Target`, {_trace("monthly_targets", "row")}
from (
  select case when place % 19 = 4 then '2001-13' when place % 3 = 0 then month
      when place % 3 = 1 then concat(month, '-15') else concat('01/', substr(month, 6, 2), '/',
      substr(month, 1, 4)) end as month,
    case when place % 23 = 5 then '-10' else cast(total as string) end as goal,
    case when place % 7 = 0 then null else '1000' end as profit,
    case when place % 29 = 6 then 'x' else cast(orders as string) end as volume, place as row
  from (select month, total, orders, row_number() over (order by month) - 1 as place
    from (select {_MONTH} as month, cast(sum(cast(o_totalprice as decimal(18,2))) as
      decimal(22,2)) as total, count(*) as orders from {{orders}} group by {_MONTH}) by_month)
    numbered
  union all select '1996-03', '1', '1', '1', 1000 from {{nation}} where n_nationkey = 0
) copies""",
}


class Sample:
    """Datasets of one sample folder.

    Only plans are kept between calls (a table's schema is read from its files once); no
    rows are cached.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._plans: dict[str, DataFrame] = {}
        self._paths: list[str] = []

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = build()
        return self._plans[name]

    def table(self, name: str) -> DataFrame:
        """A sample table with its row position as ``rn``."""
        return self._once(name, lambda: self._read(name))

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        frame = self.spark.read.parquet(path)
        self._paths.append(path)
        deal_by_size(self.spark, self._paths)
        return frame.select("*", F.col("_metadata.row_index").alias("rn"))

    def _select(self, text: str) -> DataFrame:
        used = {name: self.table(name) for name in TABLES if f"{{{name}}}" in text}
        return self.spark.sql(text, **used)

    def clean(self, kind: str) -> DataFrame:
        return self._once(f"clean {kind}", lambda: self._select(CLEAN[kind]))

    def raw(self, kind: str) -> DataFrame:
        return self._once(f"raw {kind}", lambda: self._select(RAW[kind]))

    @property
    def events(self) -> DataFrame:
        return self.table("events")
