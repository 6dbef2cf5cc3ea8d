"""Whitening against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrove.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)


def expected(vectors, k=4):
    """n, deviations, absolute whitened values and shares, by dense algebra."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), np.abs((x - s / n) @ axes / np.sqrt(values)), values


def test_equals_dense_algebra_with_copies_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    own = rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5]
    hot = [own[0].tolist()] * 200
    vectors = own.tolist() + hot
    n, deviation, values, share = expected(vectors)
    for entries, heavy in ((1 << 19, 1024), (60, 2)):
        monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(whitening, "HEAVY", heavy)
        df = frame(spark, vectors).repartition(5).withColumns(
            {c: F.lit(1) for c in ("x", "w", "index", "place", "copies", "part")}
        )
        rows = whitening.whiten(df).orderBy("vec_id", "component").collect()
        assert len(rows) == 4 * len(vectors)
        assert {r["n"] for r in rows} == {n}
        assert [r["deviation"] for r in rows[::4]] == deviation.tolist()
        got = np.abs(np.array([r["whitened"] for r in rows]).reshape(-1, 4))
        assert np.allclose(got, values, rtol=1e-9, atol=1e-9)
        assert {r["component"] for r in rows} == {1, 2, 3, 4}
        assert max(r["identity_error"] for r in rows) < 1e-9
        shares = [r["explained"] for r in rows[:4]]
        x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 256)
        fit = np.unique(x, axis=0)
        assert np.allclose(shares, share / np.trace(np.cov(fit.T, bias=True)), rtol=1e-9)


def test_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(50, 3)).tolist()
    rows = whitening.whiten(frame(spark, vectors), components=1).orderBy("vec_id").collect()
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 256)
    w = np.array([r["whitened"] for r in rows])
    assert abs(abs(np.corrcoef(w, x @ np.linalg.lstsq(x - x.mean(0), w, rcond=None)[0])[0, 1]) - 1) < 1e-9


def test_dropped_rows_and_degenerate_tables(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0, -inf], [], [1.0, 2.0, 3.0]]
    good = [[1.0, 2.0], [3.0, 2.5], [-1.0, 0.25], [1.0, 2.0]]
    rows = whitening.whiten(frame(spark, bad + good)).collect()
    assert {r["vec_id"] for r in rows} == set(range(len(bad), len(bad) + 4)) and len(rows) == 8
    assert {r["n"] for r in rows} == {3}
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, bad[:6])).count() == 0
    (one, two) = whitening.whiten(frame(spark, [[1.0, 2.0]])).collect()
    assert one["whitened"] is None and one["explained"] is None and one["identity_error"] is None
    assert (one["n"], one["deviation"]) == (1, 0) and {one["component"], two["component"]} == {1, 2}
    flat = whitening.whiten(frame(spark, [[1.0, 7.0], [2.0, 7.0], [4.0, 7.0]])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert all(math.isclose(r["explained"], 1.0 if r["component"] == 1 else 0.0, abs_tol=1e-9) for r in flat)


def test_deviation_beyond_a_long_is_null(spark):
    rows = whitening.whiten(frame(spark, [[1e9], [-1e9], [3e8]])).collect()
    assert all(r["deviation"] is None for r in rows if r["vec_id"] < 2)


@pytest.mark.parametrize("rows", [1, 7])
def test_sums_beyond_a_long_are_exact(spark, rows):
    big = (1 << 62) + 12345
    df = spark.createDataFrame([([big, -big],)] * rows, "x array<bigint>")
    assert whitening.exact_sums(df, 2) == (rows, [rows * big, -rows * big])
