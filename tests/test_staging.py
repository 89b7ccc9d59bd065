"""Parts of shuffles by the size of the input, and what is landed before the pipeline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tillwise import staging
from tillwise.plans import catalog, processing
from tillwise.sources.schemas import KINDS


def test_shuffles_start_with_parts_by_size(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "table.parquet")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).write.parquet(folder)
    before = spark.conf.get(staging._PARTS, None)
    try:
        spark.conf.unset(staging._PARTS)
        assert staging.deal_by_size(spark, [folder]) == 4  # as many as the session has
        assert spark.conf.get(staging._PARTS, None) is None
        monkeypatch.setattr(staging, "PART_BYTES", 100_000)
        parts = staging.deal_by_size(spark, [folder])
        assert parts > 10
        assert spark.conf.get(staging._PARTS) == str(parts)
        monkeypatch.setattr(staging, "PART_BYTES", 1 << 30)
        assert staging.deal_by_size(spark, [folder]) == parts
    finally:
        spark.conf.unset(staging._PARTS)
        if before is not None:
            spark.conf.set(staging._PARTS, before)


TABLES = {
    "region": ("r_regionkey int, r_name string", (0, "R")),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", (0, "N", 0)),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int", (1, "C", 0)),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", (1, "S", 0)),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
             (1, "P", "B", "T", 2.5)),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp, o_orderpriority string",
               (1, 1, "F", 5.0, datetime(1998, 3, 2), "2-HIGH")),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_discount double, l_returnflag string, l_linestatus string",
                 (1, 1, 1, 1, 2.0, 0.0, "R", "F")),
    "events": ("event_id bigint", (1,)),
}


def test_pipeline_reads_raw_tables_without_landing_them(spark, tmp_path, monkeypatch):
    for name, (schema, row) in TABLES.items():
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}
    monkeypatch.setattr(processing, "process_datasets", lambda tables, *rest, **named: seen.update(tables))
    run = catalog.Run(spark, str(tmp_path))
    assert run.result is None
    assert set(seen) == set(KINDS)
    assert not run._raw
    assert seen["orders"].count() == 1
    assert all(str(tmp_path) in name for frame in seen.values() for name in frame.inputFiles())


def test_packed_tables_are_not_broadcast_by_their_files(spark, stage):
    session = spark.newSession()
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    session.conf.set(limits[0], "8MB")
    session.conf.unset(limits[1])
    catalog.run_of(session, "/a folder that is not read")
    assert [session.conf.get(name) for name in limits] == ["256k", "8MB"]
    packed = staging.Stage(session, stage.path).write(session.range(400_000).withColumn("x", F.lit("x" * 99)), "packed")
    joined = session.range(9).join(packed, "id", "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 9
    few = session.range(9).withColumn("x", F.lit("x"))
    joined = session.range(400_000).join(staging.Stage(session, stage.path).write(few, "few"), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    session.conf.set(limits[0], "-1")
    staging.broadcast_by_rows(session)
    assert session.conf.get(limits[0]) == "-1"
