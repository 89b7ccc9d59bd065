"""Running totals against plain sums."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillwise.operators.prefix import row_numbers, running_totals

SCHEMA = "g string, k long, w long, part string"


def test_totals_equal_plain_sums(spark, stage):
    random.seed(4)
    rows = [
        (random.choice(["a", "a", "a", "b", None]), k, random.choice([0, 3, 7, None]), "mine")
        for k in range(400)
    ]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {
        r["k"]: r["before"]
        for r in running_totals(frame, ["k"], "before", "w", ["g"], stage).collect()
    }
    for g, k, _, _ in rows:
        assert got[k] == sum(w or 0 for h, other, w, _ in rows if h == g and other < k)


def test_numbers_over_all_rows_descending(spark, stage):
    frame = spark.range(500).withColumn("_part", F.lit(1)).repartition(7)
    got = row_numbers(frame, [F.desc("id")], "n", stage=stage)
    assert got.columns == ["id", "_part", "n"]
    assert {r["id"]: r["n"] for r in got.collect()} == {i: 500 - i for i in range(500)}


def test_ties_get_numbers_of_their_own(spark, stage):
    frame = spark.createDataFrame([("a", 1, 2, "x")] * 5 + [("a", 0, 2, "x")], SCHEMA)
    got = row_numbers(frame, ["k"], "n", ["g"], stage).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(0, 1)] + [(1, n) for n in range(2, 7)]


def test_large_group_is_spread(spark, stage):
    frame = spark.range(8000).withColumn("g", F.lit("one"))
    # Small ranges would otherwise be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = row_numbers(frame, ["id"], "n", ["g"], stage)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.filter("n != id + 1").isEmpty() and got.count() == 8000
    spread = spark.read.parquet(f"{stage.path}/ranged-1").groupBy("_part").count().collect()
    assert len(spread) > 2 and max(r["count"] for r in spread) < 5000


@pytest.mark.parametrize("groups", [(), ("g",)])
def test_empty(spark, stage, groups):
    assert row_numbers(spark.createDataFrame([], SCHEMA), ["k"], "n", groups, stage).collect() == []
