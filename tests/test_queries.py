"""Registered queries against their SQL on the smallest sample."""

from __future__ import annotations

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from oracles import oracle_queries
from tillwise.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
# One query per family; tools/check_oracles.py compares all of them.
NAMES = (
    "sales_kpis", "category_performance", "products_by_return_rate", "period_comparison",
    "inventory_metrics", "recommendations", "dedupe_keep_latest", "clean_orders",
    "all_issues", "excluded_rows", "processed_returns", "quality_summary", "run_history",
)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(str(value[i]) for i in order) for value in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    frame = spark_entry.queries()[name](spark, FOLDER)
    result = database.execute(spark_entry.oracle_sql()[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_queries())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry_without_the_text_package(tmp_path):
    top = Path(spark_entry.__file__).parent
    for name in ("oracles", "tillwise"):
        shutil.copytree(top / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    pipeline = top / "corpus_pipeline.py"
    for path in (top / "__spark_entry__.py", *[pipeline] * pipeline.exists()):
        shutil.copy(path, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES))] * 2


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
