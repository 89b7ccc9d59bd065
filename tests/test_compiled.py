"""Usual cells take compiled expressions, odd ones get the same treatment by the slow way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillwise.functions import dates, numeric, text
from tillwise.operators.issues import issue, no_issues, raised
from tillwise.plans.catalog import Run
from tillwise.sources.schemas import ORDERS
from tillwise.staging import Stage


def _plan(frame) -> str:
    return frame._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    "parse", [numeric.whole_number, lambda cell: numeric.strict_number(cell, "bigint", True)]
)
def test_whole_numbers_need_no_lambda(spark, parse):
    assert "lambda" not in _plan(spark.range(1).select(parse(F.col("id"))))


def test_landing_does_not_shuffle(spark, tmp_path, monkeypatch):
    run = Run(spark, str(tmp_path))
    made = spark.range(10).selectExpr("id as source_row_number")
    monkeypatch.setattr(run.sample, "raw", lambda kind: made)
    landed = []
    monkeypatch.setattr(Stage, "write", lambda self, frame, name: landed.append(frame) or frame)
    run.raw(ORDERS)
    assert "Repartition" not in _plan(landed[0])


def test_staged_tables_are_packed(spark, stage):
    stage.write(spark.range(100).toDF("id"), "packed")
    files = spark.read.format("binaryFile").load(f"{stage.path}/packed-1/*.parquet").select("path")
    assert all(row["path"].endswith(".zstd.parquet") for row in files.collect())


def test_tidy_and_untidy_text(spark):
    cells = [
        None, "", " ", "a", " a ", "a b", "a  b", "\ta", "a\n", "\xa0a\xa0", "é", " é  b ", "a\xa0b", "\x1fA\x1f",
        "new-land  o'neil", "NATION_12", "o1 b2", "1a", "x　y", "great   britain", " U.S. ", "in_progress",
    ]
    rows = (
        spark.createDataFrame([(c,) for c in cells], "cell string")
        .select(
            "cell", text.strip(F.col("cell")).alias("strip"), text.clean_text(F.col("cell")).alias("clean"),
            text.squeeze(F.col("cell")).alias("squeeze"), text.country_name(F.col("cell")).alias("country"),
            text.order_status(F.col("cell")).alias("status"),
        )
        .collect()
    )
    for row in rows:
        cell = row["cell"]
        bare = None if cell is None else cell.strip()
        assert row["strip"] == bare
        assert row["clean"] == (bare or None)
        assert row["squeeze"] == (None if not bare else " ".join(bare.split()))
    country = {row["cell"]: row["country"] for row in rows}
    assert country["NATION_12"] == "Nation_12" and country["new-land  o'neil"] == "New-Land O'Neil"
    assert country["o1 b2"] == "O1 B2" and country["1a"] == "1A" and country[" "] is None
    assert country["great   britain"] == "United Kingdom" and country[" U.S. "] == "United States"
    assert {row["cell"]: row["status"] for row in rows}["in_progress"] in ("pending", "in-progress")


def test_dates_of_every_shape(spark):
    cells = ["2031-03-04", "4/3/2031", "04.03.2031", "2031-03-04 00:00:00", "4 March 2031", "31/31/2031", "", None]
    frame = spark.createDataFrame([(c,) for c in cells], "cell string")
    found = [r[0] for r in frame.select(dates.parse_text_date(F.col("cell")).cast("string")).collect()]
    assert found == ["2031-03-04"] * 5 + [None] * 3


def test_only_raised_issues_are_built(spark):
    frame = spark.createDataFrame([(0,), (1,), (3,)], "bits int")
    found = [
        F.when(F.col("bits").bitwiseAND(bit) > 0, issue(f"bit{bit}", "bits", "set", F.col("bits"), "clear"))
        for bit in (1, 2)
    ]
    rows = frame.select(raised(*found)["issue_code"].alias("codes")).collect()
    assert [row["codes"] for row in rows] == [[], ["bit1"], ["bit1", "bit2"]]
    assert frame.select(raised()).schema[0].dataType == frame.select(no_issues()).schema[0].dataType
