"""Whitening against plain linear algebra and whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tillwise.llm import whitening
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, place int, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 7, "old") for i, x in rows], SCHEMA)


def expected(rows):
    """n, deviations and the whitened values of all rows, by whole numbers and an eigensolver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, found = np.linalg.eigh(y.T @ y / n)
    values, found = values[::-1], found[:, ::-1]
    return n, deviations, values, y @ (found / np.sqrt(np.maximum(values, 1e-300)))


def random_rows(n, d, seed):
    source = np.random.default_rng(seed)
    mix = source.normal(size=(d, d)) * np.linspace(0.1, 2, d)
    return (source.normal(size=(n, d)) @ mix).astype(np.float32)


def same_up_to_sign(ours, theirs):
    sign = np.sign((ours * theirs).sum(axis=0))
    return np.abs(ours - sign * theirs).max()


def test_equals_eigensolver(spark):
    rows = random_rows(300, 7, 1)
    frame = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rows)]).repartition(5)
    model = whitening.fit(frame, components=5)
    n, deviations, values, whitened = expected(rows)
    assert (model.n, model.size) == (n, 7)
    assert np.allclose(model.values, values[:5], rtol=1e-12)
    assert np.allclose(model.explained, values[:5] / values.sum(), rtol=1e-12)
    assert model.identity_error < 1e-10
    got = {r["vec_id"]: r["whitened"] for r in whitening.add_whitened(frame, model).collect()}
    assert [got[i]["deviation"] for i in range(n)] == deviations
    assert same_up_to_sign(np.array([got[i]["values"] for i in range(n)]), whitened[:, :5]) < 1e-9


def test_query_equals_eigensolver(spark):
    import duckdb

    given = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet' order by 1").fetchall()
    n, deviations, values, whitened = expected([v for _, v in given])
    rows = QUERIES["op12_whitening"](spark, FOLDER).collect()
    assert len(rows) == 32 * n
    got, place = np.zeros((n, 32)), {v: i for i, (v, _) in enumerate(given)}
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviations[place[r["vec_id"]]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
        assert r["identity_error"] < 1e-9
    assert same_up_to_sign(got, whitened[:, :32]) < 1e-7


def test_rows_that_go_and_rows_that_stay(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, 0.25]), (None, [1.5, 0.0, 0.25]), (1, [0.5, 1.0, 0.25]), (2, [0.0, -3.0, 0.25]),
        (3, None), (4, []), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]),
        (8, [1e30, 0.0, 0.0]), (9, [1.0, 2.0]),
    ]
    frame = vectors(spark, rows)
    model = whitening.fit(frame)
    # The third dimension never changes, so two components are left.
    assert (model.n, model.size, len(model.values)) == (4, 3, 2)
    out = whitening.add_whitened(frame, model)
    assert out.columns == ["vec_id", "embedding", "place", "whitened"]
    got = sorted(out.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [r["vec_id"] for r in got] == [1, 1, 2, None] and got[0] == got[1]
    n, deviations, _, whitened = expected([v for _, v in rows[:4]])
    assert [r["whitened"]["deviation"] for r in got] == [deviations[i] for i in (0, 2, 3, 1)]
    ours = np.array([r["whitened"]["values"] for r in got])
    assert same_up_to_sign(ours, whitened[[0, 2, 3, 1], :2]) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    frame = vectors(spark, rows)
    model = whitening.fit(frame)
    out = whitening.component_rows(whitening.add_whitened(frame, model, keep=["vec_id"]), model)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 5)), float(i)]) for i in range(20)]
    frame = vectors(spark, rows)
    model = whitening.fit(frame)
    _, deviations, _, _ = expected([v for _, v in rows])
    got = {r["vec_id"]: r["whitened"]["deviation"] for r in whitening.add_whitened(frame, model).collect()}
    assert [got[i] for i in range(20)] == [d if d < 2**63 else None for d in deviations]


def test_graded_columns_keep_small_eigenvalues():
    source = np.random.default_rng(3)
    q, _ = np.linalg.qr(source.normal(size=(6, 6)))
    true = np.array([1e6, 1e3, 1.0, 1e-2, 1e-3, 1e-4])
    values, found = whitening.rotate_columns(whitening.pivoted_cholesky(q @ np.diag(true) @ q.T, 0.0))
    assert np.allclose(values, true, rtol=1e-5)
    assert np.allclose(found.T @ found, np.eye(6), atol=1e-12)
