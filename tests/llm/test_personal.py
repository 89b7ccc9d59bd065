"""Personal data against plain regular expressions, and the model on votes of known makers."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import personal
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def fine(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text or "")
        if fine(kind, m.group())
    ]


def found(frame, rows):
    out = personal.find_personal_data(frame(rows), keep=["doc_id"])
    base, spans = (personal.listed(F.col(f"personal.{x}")).alias(x) for x in ("base", "spans"))
    return {r["doc_id"]: (r["base"], r["spans"]) for r in out.select("doc_id", base, spans).collect()}


TEXTS = [
    "Write to a.b+c@mail.example.org. or x@y.z_w@v.u-t.s", "a@b a@b. a@b.c.d..e @x.y é%@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3",
    "001.0255.3.4 9999999999999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111110000",
    "+1 (980) 555-6268 +1 2 + 3 +12345678 +1234567890123456 (+49) 30-12 34 56 78", "é😀 4111111111111111 ñ 10.0.0.1 a@b.cd",
    "x" * 5000 + "@a.bc " + "1" * 5000 + " " + "+1" + " " * 5000 + "2", "a@b" + ".c" * 20_000, "1 " * 30_000 + "1.1.1.1", "7" * 40_000,
    "a@b.c\n" * 900 + "8.8.8.8 ", "", None, "nothing here",
]


def test_base_spans_equal_plain_expressions(frame):
    source = random.Random(2)
    letters = "0123456789 0123456789.@+-()aZ_%é\n"
    texts = TEXTS + ["".join(source.choice(letters) for _ in range(300)) for _ in range(150)]
    got = found(frame, list(enumerate(texts)))
    for i, text in enumerate(texts):
        assert got[i][0].split(",") == (base_spans(text) or [""]), text
        assert set(got[i][0].split(",")) - {""} <= set(got[i][1].split(","))


def test_query_equals_plain_expressions(spark):
    import duckdb

    given = dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())
    rows = QUERIES["op13_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(given)
    for r in rows:
        spans = base_spans(given[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_written_out_forms_are_added_and_failed_checks_are_not(frame):
    rows = [(i, f"Mail me{i}@host.example.org or call +1 (980) 555-{6000 + i}, host 10.0.{i}.7.") for i in range(60)]
    rows += [(100 + i, f"card 411111111111{1112 + i}, ip 300.1.1.{i}, +12 {i}") for i in range(40)]
    rows += [
        (201, "contact: joe (at) mail (dot) org"), (202, "host 10[.]0[.]0[.]9"), (203, "call (980) 555-6200 now"),
        (204, "order 4111_1111_1111_1112x"), (205, "build x300[.]1[.]1[.]1y"),
    ]
    got = found(frame, rows)
    assert got[201] == ("", "email:9:32") and got[202] == ("", "ip:5:19") and got[203] == ("", "phone:5:19")
    assert got[204] == got[205] == ("", "")
    for i in range(40):
        expected = ",".join(base_spans(rows[60 + i][1]))
        assert got[100 + i] == (expected, expected)


def test_overlapped_candidates_stay_out(frame):
    text = "a at b dot c@d.ef and +1 (980) 555-6268"
    got = found(frame, [(1, text)] * 3)
    assert got[1] == (",".join(base_spans(text)),) * 2


def test_rows_of_all_sorts(spark, frame):
    rows = [(None, "a@b.cd"), (1, None), (1, None), (2, ""), (3, "z" * 200_000)]
    out = personal.find_personal_data(frame(rows).withColumn("candidates", F.lit(1)).withColumn("personal", F.lit(2)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "candidates", "personal"]
    assert sorted(len(r["personal"]["base"]) for r in out.collect()) == [0, 0, 0, 0, 1]
    assert personal.find_personal_data(frame([])).collect() == []


def test_no_python_in_the_plan(spark, frame):
    plan = personal.find_personal_data(frame([(1, "a@b.cd")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_estimation_finds_reliabilities():
    source = np.random.default_rng(5)
    truth = source.random(20_000) < 0.4
    right = np.array([1.0, 0.9, 0.75, 0.6])
    votes = np.where((source.random((20_000, 4)) < right) == truth[:, None], 1, -1)
    votes[:, 0] = np.where(truth & (source.random(20_000) < 0.5), 1, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, agree = personal.estimate(patterns, counts.astype(float))
    assert np.abs(agree[1:] - right[1:]).max() < 0.05
    assert p[(patterns == [0, 1, 1, 1]).all(axis=1)] > 0.8 > 0.2 > p[(patterns == [0, -1, -1, -1]).all(axis=1)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_totals(spark, n):
    row = spark.range(1).select(personal._ends(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda x: x.cast("long"))).alias("e"))
    if n:
        assert row.first()["e"] == [i * (i + 1) // 2 for i in range(1, n + 1)]
    else:
        assert spark.range(1).select(personal._ends(F.array().cast("array<long>")).alias("e")).first()["e"] == []
