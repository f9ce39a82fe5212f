"""Whitening against NumPy, on hostile vectors, and on degenerate fits."""

import numpy as np
import pytest

from driftline.llm import whitening as W

KINDS = "vec_id long, embedding array<float>, whitened string, _x string, n long, n_ string"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, "own", "x", 7, "y") for i, v in enumerate(vectors)], KINDS)


def brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    cov = np.cov((x - x.mean(0)).T, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    n, s = len(x), [int(v) for v in x.sum(0)]
    return (x - x.mean(0)) @ u / np.sqrt(e), e / e.sum(), [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]


def test_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 40)) * np.linspace(0.1, 3, 40)).astype(np.float32)
    good[100:200] = good[100]  # a hot vector
    bad = [None, [], [1.0] * 39, [None] + [1.0] * 39, [float("nan")] * 40, [1.0] * 39 + [float("inf")], [3e38] + [0.0] * 39]
    df = frame(spark, [v.tolist() for v in good]).union(frame(spark, bad, 1000))
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op13_embedding_whitening(spark, str(tmp_path)).toPandas().sort_values(["vec_id", "component"])
    z, share, deviation = brute(good)
    assert got.vec_id.tolist() == np.repeat(np.arange(300), 32).tolist() and got.component.tolist() == list(range(1, 33)) * 300
    mine = got.whitened.to_numpy().reshape(300, 32)
    sign = np.sign((mine * z[:, :32]).sum(0))
    assert np.abs(mine - z[:, :32] * sign).max() < 1e-8
    assert np.abs(got.explained.to_numpy()[:32] / share[:32] - 1).max() < 1e-9
    assert got.deviation.tolist() == np.repeat(deviation, 32).tolist()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and set(got.n) == {300}


def test_own_columns_stay(spark):
    out, _, error = W.whitened(frame(spark, np.random.default_rng(0).normal(size=(50, 3)).tolist()))
    assert out.columns == ["vec_id", "embedding", "_x", "n", "n_", "whitened", "deviation"] and error < 1e-9
    row = out.first()
    assert (row["_x"], row["n"], row["n_"], len(row["whitened"])) == ("x", 7, "y", 3)


def test_wide_values_stay_exact(spark):
    vectors = [[2.0**50, 1.0], [-(2.0**50), 2.0], [0.5, -1.0], [3.0, 9.0]]
    out, w, error = W.whitened(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    assert w.sums == s
    assert {r["vec_id"]: int(r["deviation"]) for r in out.collect()} == {i: sum((4 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    # the second component is beyond the digits of a double beside the first
    assert error == 1.0


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 3, [[1.0, 2.0]], [[0.0, 1.0], [1.0, 0.0]]])
def test_components_without_variance(spark, vectors):
    out, w, error = W.whitened(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    rows = np.array([r["whitened"] for r in out.collect()])
    assert np.isfinite(rows).all() and abs(error - 1) < 1e-9 and (rows[:, 1] == 0).all() and w.n == len(vectors)


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = W.op13_embedding_whitening(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_products_in_several_aggregations(spark, monkeypatch):
    df = frame(spark, np.random.default_rng(1).normal(size=(60, 6)).tolist())
    one = W.whitened(df)[1].covariance
    monkeypatch.setattr(W, "PAIRS", 4)
    assert (W.whitened(df)[1].covariance == one).all()
