"""Shared Spark session and small frames with hand-computed answers."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillwise.staging import Stage, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    builder = configure(SparkSession.builder.master("local[*]").appName("tests"))
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def stage(spark) -> Stage:
    return Stage(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Build a frame from a schema string and rows, with trace columns."""

    def build(schema: str, *rows: tuple, name: str = "file") -> DataFrame:
        full = f"{schema}, source_file string, source_row_number bigint"
        traced = [(*row, name, place) for place, row in enumerate(rows, start=2)]
        return spark.createDataFrame(traced, full)

    return build


@pytest.fixture(scope="session")
def orders(table) -> DataFrame:
    return table(
        "order_id string, order_date string, product_id string, product_name string, "
        "category string, country string, sales_channel string, currency string, "
        "order_status string, quantity bigint, unit_price double, discount double, "
        "purchase_cost double",
        ("A-70", "2031-03-04", "TEA", "Green tea", "Drinks", "Norway", "website", "USD", "completed",
         6, 4.5, 0.0, 1.25),
        ("A-71", "2031-03-04", "CUP", "Cup", "Kitchen", "Norway", "retail", "USD", "completed",
         3, 8.0, 0.25, 3.0),
        ("A-72", "2031-03-12", "POT", "Pot", "Kitchen", "Chile", "amazon", "EUR", "completed",
         1, 35.0, 0.1, 20.0),
        ("A-73", "2031-03-06", "TEA", "Green tea", "Drinks", "Norway", "website", "USD", "pending",
         50, 4.5, 0.0, 1.25),
    )


@pytest.fixture(scope="session")
def returns(table) -> DataFrame:
    return table(
        "return_id string, order_id string, product_id string, return_date string, "
        "quantity bigint, refund_amount double, return_reason string",
        ("B-5", "A-71", "CUP", "2031-03-07", 1, 6.0, "Broken"),
    )
