import hashlib

import pytest

from tillwise.llm import warc
from tillwise.llm.queries import op9_warc

LONG = "<p>" + "x" * 200


def brute(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            least.setdefault(data, []).append(page)
    out = []
    done = set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (html or "").encode()
        group = least.get(data, [])
        known = [p for p in group if p is not None]
        first = min(known) if known else None
        response = len(group) < 2 or (page == first and data not in done)
        if response:
            done.add(data)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit",
                    None if response else first))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/5", LONG), (2, "http://a/ 2\n", LONG), (9, None, LONG), (1, "u", "short"), (3, "u", "short"),
    (4, "u", None), (6, "u", ""), (7, "u", "é" * 49 + "a"), (8, "u", "é" * 50), (10, "u", "é" * 50),
    (11, "u", "again" * 40), (11, "u", "again" * 40), (None, "u", "null" * 40), (None, "u", "null" * 40),
    (None, "u", LONG), (12, "u", "\r\n\r\n" * 60), (13, "u", "y" * 300_000),
]
SCHEMA = "page_id long, url string, html string"


def test_query_matches_brute_force(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op9_warc(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_equal_input_makes_equal_files(spark, tmp_path):
    seen = []
    for name, parts in (("one", 1), ("two", 4)):
        pages = spark.createDataFrame(ROWS[:12], SCHEMA).repartition(parts)
        folder = warc.write_archives(pages, f"{tmp_path}/{name}", file_bytes=700)
        files = spark.read.parquet(f"{folder}/manifest").orderBy("file").collect()
        assert len(files) > 3 and sum(f.records for f in files) == 12
        for f in files:
            with open(f"{folder}/{f.file}", "rb") as file:
                assert hashlib.sha256(file.read()).hexdigest() == f.sha256
        seen.append(files)
    assert seen[0] == seen[1]


def test_damage_and_missing_manifest(spark, tmp_path):
    folder = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/x")
    file = spark.read.parquet(f"{folder}/manifest").first().file
    with open(f"{folder}/{file}", "r+b") as out:
        out.seek(400)
        out.write(b"\x00\x01\x02\x03")
    with pytest.raises(Exception):  # noqa: B017
        warc.read_archives(spark, folder).collect()
    with pytest.raises(Exception, match="manifest|PATH_NOT_FOUND"):
        warc.read_archives(spark, f"{tmp_path}/none").collect()


def test_empty_table_and_other_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_archives(spark, warc.write_archives(empty, f"{tmp_path}/e")).count() == 0
    more = spark.createDataFrame(ROWS[:3], SCHEMA).selectExpr("*", "1 as digest", "2 as first", "3 as whole")
    assert warc.read_archives(spark, warc.write_archives(more, f"{tmp_path}/m")).count() == 3
