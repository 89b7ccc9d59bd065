"""Dataset kinds, their columns, and the headings accepted for each column."""

from __future__ import annotations

from dataclasses import dataclass

from tillwise.errors import RetailDataError
from tillwise.functions.numeric import MONEY, RATE

ORDERS, PRODUCTS, INVENTORY = "orders", "products", "inventory"
RETURNS, TARGETS = "returns", "monthly_targets"
KINDS = (ORDERS, PRODUCTS, INVENTORY, RETURNS, TARGETS)
TRACE_COLUMNS = ("source_file", "source_row_number", "processing_status", "exclusion_reason")


@dataclass(frozen=True)
class Field:
    """One column: the converter that cleans it and the type it ends up with."""

    name: str
    converter: str
    data_type: str = "string"
    required: bool = False
    headings: tuple[str, ...] = ()


@dataclass(frozen=True)
class DatasetSchema:
    kind: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    latest_by: str | None = None
    amount: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.required)

    @property
    def optional(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if not f.required)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


def _need(name: str, converter: str, data_type: str, *headings: str) -> Field:
    return Field(name, converter, data_type, True, headings)


def _may(name: str, converter: str, data_type: str, *headings: str) -> Field:
    return Field(name, converter, data_type, False, headings)


# Column names and accepted headings of the five datasets.
SCHEMAS = {
    ORDERS: DatasetSchema(
        ORDERS,
        (
            _need("order_id", "id", "string", "Order Number", "Order No", "Order Reference"),
            _need("order_date", "date", "date", "Date", "Order Date", "Transaction Date"),
            _need("product_id", "id", "string", "Product Code", "SKU", "Article"),
            _need("quantity", "integer", "bigint", "Qty", "Units"),
            _need("unit_price", "number", MONEY, "Price", "Sales Price", "Selling Price"),
            _may("customer_id", "id", "string", "Customer Code", "Client ID"),
            _may("discount", "number", RATE, "Discount Rate", "Discount Percent"),
            _may("currency", "currency", "string", "Currency Code"),
            _may("country", "country", "string", "Market", "Customer Country"),
            _may("sales_channel", "channel", "string", "Channel", "Sales Source"),
            _may("order_status", "status", "string", "Status"),
        ),
        key=("order_id", "product_id"),
        latest_by="order_date",
        amount="unit_price",
    ),
    PRODUCTS: DatasetSchema(
        PRODUCTS,
        (
            _need("product_id", "id", "string", "Product Code", "SKU", "Article"),
            _need(
                "product_name", "text", "string", "Product", "Product Description", "Article Name"
            ),
            _need("purchase_cost", "number", MONEY, "Cost", "Unit Cost", "Purchase Price"),
            _need(
                "recommended_price", "number", MONEY, "RRP", "Retail Price",
                "Recommended Retail Price",
            ),
            _may("category", "text", "string", "Product Category"),
            _may("supplier", "text", "string", "Supplier Name", "Vendor"),
            _may("vat_rate", "number", RATE, "VAT", "Tax Rate"),
        ),
        key=("product_id",),
    ),
    INVENTORY: DatasetSchema(
        INVENTORY,
        (
            _need("product_id", "id", "string", "Product Code", "SKU", "Article"),
            _need("warehouse", "text", "string", "Warehouse Name", "Location"),
            _need("stock_quantity", "integer", "bigint", "Stock", "On Hand", "Quantity On Hand"),
            _may("reserved_quantity", "integer", "bigint", "Reserved", "Allocated Quantity"),
            _may("reorder_level", "integer", "bigint", "Reorder Point", "Minimum Stock"),
            _may("last_restock_date", "date", "date", "Last Restock", "Replenishment Date"),
        ),
        key=("product_id", "warehouse"),
        latest_by="last_restock_date",
    ),
    RETURNS: DatasetSchema(
        RETURNS,
        (
            _need("return_id", "id", "string", "Return Number", "RMA"),
            _need("order_id", "id", "string", "Order Number", "Order Reference"),
            _need("product_id", "id", "string", "Product Code", "SKU", "Article"),
            _need("return_date", "date", "date", "Date", "Returned On"),
            _need("quantity", "integer", "bigint", "Qty", "Returned Quantity"),
            _need("refund_amount", "number", MONEY, "Refund", "Refunded Value"),
            _may("return_reason", "text", "string", "Reason"),
        ),
        key=("return_id",),
        latest_by="return_date",
        amount="refund_amount",
    ),
    TARGETS: DatasetSchema(
        TARGETS,
        (
            _need("month", "month", "string", "Period", "Target Month"),
            _need("revenue_target", "number", MONEY, "Sales Target", "Revenue Goal"),
            _may("profit_target", "number", MONEY, "Profit Goal"),
            _may("orders_target", "integer", "bigint", "Order Target", "Volume Target"),
        ),
        key=("month",),
        latest_by="month",
    ),
}
# Columns that are cleaned in any dataset that happens to carry them.
SHARED_CONVERTERS = {
    "order_id": "id",
    "product_id": "id",
    "customer_id": "id",
    "return_id": "id",
    "product_name": "text",
    "category": "text",
    "supplier": "text",
    "warehouse": "text",
    "return_reason": "text",
    "country": "country",
    "order_status": "status",
    "sales_channel": "channel",
}


def dataset_kind(name: str) -> str:
    """Canonical dataset kind; ``targets`` is accepted for ``monthly_targets``."""
    kind = TARGETS if name == "targets" else name
    if kind not in SCHEMAS:
        raise RetailDataError(f"The dataset type '{name}' is not one of {', '.join(KINDS)}.")
    return kind


def schema_of(name: str) -> DatasetSchema:
    return SCHEMAS[dataset_kind(name)]
