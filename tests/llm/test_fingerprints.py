import hashlib
import random

from pyspark.sql import functions as F

from tillwise.llm.fingerprints import fingerprint, likeness
from tillwise.llm.queries import op7_fingerprints


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_query_follows_the_contract(spark, frame, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"wö{i}" for i in range(400)]
    rows = [(i * 3 - 20, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 9, 300, 700])))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "abc"), (503, "x " * 30_000), (None, "no id here at all")]
    frame(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, row = text or "", after or "", got[doc]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, row.near_edited), (after, row.near_next)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.2, (doc, near, true)


def test_rows_that_repeat_and_equal_texts(spark, frame, tmp_path):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other"), (2, "Other"), (2, None)]
    frame(rows).selectExpr("*", "1 as key", "2 as n", "3 as next").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "2"]
    assert len({r.fingerprint for r in got}) == 3  # "other" and "Other" have the same words
    assert got.count(next(r for r in got if r.n_chars > 20)) == 2


def test_empty_table(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_fingerprints(spark, str(tmp_path)).count() == 0


def test_likeness_is_unbiased(spark):
    rng = random.Random(1)
    rows = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(12):
            both, left, right = (
                [rng.getrandbits(60) for _ in range(n)] for n in (int(600 * share), *[int(300 * (1 - share))] * 2)
            )
            text = lambda part: " ".join(f"{x} a b c {x}" for x in part)
            rows.append((share, text(both + left), text(both + right)))
    made = spark.createDataFrame(rows, "share double, a string, b string").select(
        "share", "a", "b", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("near")
    )
    error = [
        r.near - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in made.collect()
    ]
    assert abs(sum(error) / len(error)) < 0.03 and max(map(abs, error)) < 0.2
