"""Readers, page envelopes, row numbers, and profiles."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tillwise.errors import ConfigError, SourceError
from tillwise.sources import dialects, files, pages
from tillwise.staging import Stage


@pytest.mark.parametrize(
    ("content", "encoding", "delimiter"),
    [
        ("a;b;c\n1;2,5;3\n4;5,1;6\n".encode(), "UTF-8", ";"),
        ("a\tb\n1\t2\n".encode(), "UTF-8", "\t"),
        ("only\nvalue, here\n".encode(), "UTF-8", ","),
        ('a,b\n"x;y",2\n3,4\n'.encode(), "UTF-8", ","),
        ('"x;y;z",b\n1,2\n'.encode(), "UTF-8", ","),
        ("\n \na|b|c\n1|2\n1,1|2,2|3,3\n".encode(), "UTF-8", "|"),
        ("a;b\né;1\n".encode("cp1252"), "cp1252", ";"),
        ("a;b\né;1\n".encode("utf-16"), "UTF-16", ";"),
        ("a,b\né,1\n".encode("utf-8-sig"), "UTF-8", ","),
    ],
)
def test_dialects(spark, tmp_path, content, encoding, delimiter):
    path = tmp_path / "one file.csv"
    path.write_bytes(content)
    (found,) = dialects.read_dialects(spark, str(path))
    assert (found.encoding, found.delimiter) == (encoding, delimiter)
    assert found.files[0].endswith("/one file.csv")


def test_files_of_many_dialects_are_one_table(spark, tmp_path, stage):
    root = tmp_path / "in [here]" / "orders.csv"
    root.mkdir(parents=True)
    (root / "a.csv").write_bytes("id;name;price\n1;Zoë;1,5\n2;NULL;n/a\n3\n".encode())
    (root / "b.csv").write_bytes("id,name,price\n4,Café,2\n5,\"x,y\",NA\n".encode("cp1252"))
    (root / "c+d.csv").write_bytes("price\tid\n3\t6\n".encode("utf-16"))
    (root / "e.csv").write_bytes(b"")
    source = files.load_source(spark, dialects.literal_paths([str(root)])[0])
    assert (source.delimiter, source.encoding, len(source.parts)) == (None, None, 3)
    rows = sorted(tuple(r) for r in source.frame.select("id", "name", "price").collect())
    assert rows == [
        ("1", "Zoë", "1,5"), ("2", None, None), ("3", None, None), ("4", "Café", "2"), ("5", "x,y", None), ("6", None, "3")
    ]
    assert source.frame.select("id").count() == 6
    traced = files.traced(source, stage).select("id", "source_file", "source_row_number").collect()
    assert {r["id"]: r["source_row_number"] for r in traced} == {"1": 2, "2": 3, "3": 4, "4": 2, "5": 3, "6": 2}
    profile = {r["filename"].rpartition("/")[2]: r for r in files.source_profile(source, "orders").collect()}
    facts = {n: (r["detected_encoding"], r["detected_delimiter"], r["row_count"], r["column_count"]) for n, r in profile.items()}
    assert facts == {"a.csv": ("UTF-8", ";", 3, 3), "b.csv": ("cp1252", ",", 2, 3), "c+d.csv": ("UTF-16", "\t", 1, 2)}


def test_long_rows_fail_with_their_file(spark, tmp_path, stage):
    root = tmp_path / "rows.csv"
    root.mkdir()
    (root / "a.csv").write_text('a,b\n1,2\n3\n"4,4",5\n')
    (root / "b.csv").write_text("a,b\n1,2\n1,2,3\n")
    source = files.load_source(spark, str(root))
    for columns in (["a"], ["b"], ["a", "b"]):
        with pytest.raises(Exception, match="more fields than the heading in file .*b.csv: 1,2,3"):
            source.frame.select(*columns).collect()
    (row,) = files.long_rows(spark, str(root), stage).collect()
    assert tuple(row) == ("b.csv", 3, "1,2,3")
    (root / "b.csv").write_text("a,b\n1,2\n")
    assert files.long_rows(spark, str(root), stage).collect() == []
    rows = files.load_source(spark, str(root)).frame.collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("1", "2"), ("3", None), ("4,4", "5")]


def test_csv_is_read_as_text(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_bytes("id;name;price\n1;Café;€1,5\n2;;2\n".encode("cp1252"))
    source = files.load_source(spark, str(path))
    assert (source.delimiter, source.encoding) == (";", "cp1252")
    assert [tuple(r) for r in source.frame.collect()] == [("1", "Café", "€1,5"), ("2", None, "2")]
    profile = files.source_profile(source, "orders").first()
    assert (profile["filename"], profile["row_count"], profile["column_count"]) == ("orders.csv", 2, 3)
    assert profile["file_size"] == path.stat().st_size


def test_utf16_and_marked_utf8(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-16"), ("b.csv", "utf-8-sig")):
        path = tmp_path / name
        path.write_bytes("id,name\n1,Zoë\n2,Ana\n".encode(encoding))
        rows = files.load_source(spark, str(path)).frame
        assert rows.columns == ["id", "name"]
        assert [tuple(r) for r in rows.collect()] == [("1", "Zoë"), ("2", "Ana")]


def test_bad_sources_are_rejected(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(SourceError):
        files.load_source(spark, str(empty))
    with pytest.raises(SourceError):
        files.load_source(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(SourceError):
        files.load_source(spark, str(tmp_path / "book.xlsx"))


def test_rows_are_numbered_per_file_in_file_order(spark, tmp_path, stage):
    folder = tmp_path / "lines.csv"
    folder.mkdir()
    for name, count in (("a", 2500), ("b", 40)):
        body = "\n".join(f"{i},{'x' * 40}" for i in range(count))
        (folder / f"{name}.csv").write_text(f"n,fill\n{body}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = files.number_rows(files.load_source(spark, str(folder)).frame, stage)
        assert numbered.select(F.col("source_file")).distinct().count() == 2
        wrong = numbered.filter(F.col("n").cast("bigint") + 2 != F.col("source_row_number"))
        assert numbered.count() == 2540 and wrong.isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


COLUMNS = ["return_id", "order_id", "product_id", "return_date", "quantity", "refund_amount"]


def _page(number, ids, total, following, columns=COLUMNS):
    items = [{name: f"{name}-{i}" for name in columns} for i in ids]
    return {"items": items, "columns": columns, "page": number, "page_size": 2, "total": total,
            "next_page": following}


def _land(path, *envelopes):
    path.write_text("\n".join(json.dumps(envelope) for envelope in envelopes))
    return str(path)


def test_pages_become_rows(spark, tmp_path):
    path = _land(tmp_path / "p.json", _page(1, [1, 2], 3, 2), _page(2, [3], 3, None))
    rows = pages.read_api_pages(spark, path, "returns")
    assert rows.columns == COLUMNS
    assert sorted(r["return_id"] for r in rows.collect()) == [f"return_id-{i}" for i in (1, 2, 3)]
    numbered = pages.read_api_pages(spark, path, "returns", trace=True)
    places = {r["return_id"]: r["source_row_number"] for r in numbered.collect()}
    assert places == {f"return_id-{i}": i + 1 for i in (1, 2, 3)}


@pytest.mark.parametrize(
    ("envelopes", "problem"),
    [
        ((_page(1, [1, 2], 4, 2), _page(2, [3], 4, None)), "total is wrong"),
        ((_page(1, [1, 2], 3, 3), _page(2, [3], 3, None)), "page sequence"),
        ((_page(1, [1], 3, 2), _page(2, [2], 3, 8), _page(3, [3], 3, None)), "page sequence"),
        ((_page(1, [1, 2], 3, 2), _page(2, [3], 5, None)), "total changed"),
        ((_page(1, [1, 2], 3, 2), _page(2, [3], 3, None), _page(2, [], 3, None)), "page sequence"),
        ((_page(1, [1, 2, 3], 3, None),), "malformed"),
        ((_page(2, [1], 1, None),), "page sequence"),
        ((_page(1, [1], 1, None, ["return_id"]),), "lack required"),
    ],
)
def test_inconsistent_pages_are_rejected(spark, tmp_path, envelopes, problem):
    with pytest.raises(SourceError, match=problem):
        pages.read_api_pages(spark, _land(tmp_path / "p.json", *envelopes), "returns")


def test_chain_over_many_ranges(spark, tmp_path):
    """Breaks inside a range and at its borders are found, wherever they lie."""
    sound = [_page(n, [2 * n, 2 * n + 1], 240, n + 1 if n < 120 else None) for n in range(1, 121)]
    path = _land(tmp_path / "p.json", *reversed(sound))
    rows = pages.read_api_pages(spark, path, "returns", trace=True)
    numbers = {r["return_id"]: r["source_row_number"] for r in rows.collect()}
    assert numbers == {f"return_id-{i}": i for i in range(2, 242)}
    assert "json" not in rows._jdf.queryExecution().executedPlan().toString().lower().replace("api_returns.json", "")
    for place in (0, 30, 61, 119):
        missing = sound[:place] + sound[place + 1 :]
        repeated = [*sound, sound[place]]
        looping = [*sound[:place], {**sound[place], "next_page": 1}, *sound[place + 1 :]]
        for at, (broken, problem) in enumerate(
            ((missing, "page sequence"), (repeated, "page sequence"), (looping, "malformed"))
        ):
            landed = _land(tmp_path / f"{place}-{at}.json", *broken)
            parsed = pages.parsed_pages(spark, landed, Stage(spark))
            assert any(problem in found for found in pages.page_problems(parsed)), (place, problem)


def test_no_pages(spark, tmp_path):
    for name, body in (("empty", ""), ("nothing", json.dumps(_page(1, [], 0, None, [])))):
        (tmp_path / f"{name}.json").write_text(body)
        with pytest.raises(SourceError, match="No pages"):
            pages.read_api_pages(spark, str(tmp_path / f"{name}.json"), "returns")


def test_items_must_match_the_columns(spark, tmp_path):
    page = _page(1, [1], 1, None)
    page["items"][0]["extra"] = "1"
    with pytest.raises(SourceError, match="malformed"):
        pages.read_api_pages(spark, _land(tmp_path / "p.json", page), "returns")


def test_source_choice(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n")
    named = {name: str(path) for name in ("orders", "products", "inventory", "returns")}
    assert set(files.load_sources(spark, named)) == set(named)
    with pytest.raises(ConfigError):
        files.load_sources(spark, {"orders": str(path)}, {"returns": str(path)})
    with pytest.raises(ConfigError):
        files.load_sources(spark, {"orders": str(path)})


def test_equal_file_names_in_two_folders_are_told_apart(spark, tmp_path):
    from tillwise.sources.files import load_source, source_profile, traced
    from tillwise.staging import Stage

    for kind, write in (("parquet", "parquet"), ("csv", "csv")):
        root = tmp_path / f"orders.{kind}"
        for day in ("a", "b"):
            frame = spark.createDataFrame([("o1", day)], "order_id string, product_id string").coalesce(1)
            target = f"{root}/day={day}"
            getattr(frame.write.option("header", True), write)(target)
            part = next((root / f"day={day}").glob(f"part-*.{kind}"))
            part.rename(part.with_name(f"part-0.{kind}"))
        source = load_source(spark, str(root))
        rows = traced(source, Stage(spark)).select("source_file", "source_row_number").collect()
        assert sorted(rows) == [(f"day=a/part-0.{kind}", 2), (f"day=b/part-0.{kind}", 2)]
        assert source_profile(source, "orders").count() == 2


def test_late_accents_decide_the_encoding(spark, tmp_path):
    from tillwise.sources.files import read_csv_source

    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"plain,1\n" * 4000 + "Café,2\n".encode("cp1252"))
    assert read_csv_source(spark, str(path)).frame.where("a = 'Café'").count() == 1
