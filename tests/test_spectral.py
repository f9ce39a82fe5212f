"""Spectral clustering over a sparse graph against the decomposition of the whole matrix."""

import numpy as np
import pytest

from driftline.operators import density as D
from driftline.operators import neighbours as N
from driftline.operators import spectral as S
from driftline.operators.storage import Store


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, embedding array<float>")


def vectors(n, groups, seed, noise=0.25):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, 16))[r.integers(0, groups, n)] + noise * r.normal(size=(n, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def whole(x, keep):
    """The normalised graph as a matrix."""
    n = len(x)
    a = (2 - D.distances(x, "cosine")) / 2
    np.fill_diagonal(a, -1)
    cut = np.zeros_like(a)
    rows = np.arange(n)[:, None]
    top = np.argsort(-a, axis=1, kind="stable")[:, :keep]
    cut[rows, top] = a[rows, top]
    a = np.maximum(cut, cut.T)
    s = 1 / np.sqrt(a.sum(1))
    return s[:, None] * a * s


def partition(labels):
    return sorted(sorted(np.flatnonzero(np.array(labels) == l).tolist()) for l in set(labels))


@pytest.mark.parametrize("width", [120, 30])
def test_eigenvectors_span_the_same_space(spark, monkeypatch, width):
    """Also where the basis starts again several times."""
    monkeypatch.setattr(S, "WIDTH", width)
    monkeypatch.setattr(N, "GROUP", 100)
    x = vectors(240, 5, 4)
    points = frame(spark, x)
    value, vector = np.linalg.eigh(whole(x, 12))
    value, vector = value[::-1], vector[:, ::-1]
    with Store(spark) as store:
        found, got, k = S.leading(S.normalised(store(S.affinities(points, 12)), store), points, store, 8)
        v = np.array([r["v"] for r in found.orderBy("seq").collect()])
    assert k == max(2, int((-np.diff(value[:9])).argmax()) + 1)
    assert np.abs(got[:k] - value[:k]).max() < 1e-9
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-7
    # the projections on both spaces are one: rotation and sign are free
    assert np.abs(v @ v.T - vector[:, :k] @ vector[:, :k].T).max() < 1e-5


def test_same_clusters_as_the_whole_matrix(spark):
    x = vectors(120, 4, 1)
    points = frame(spark, x)
    got = {r["seq"]: r["pred"] for r in S.cluster(points, share=0.20).collect()}
    assert all(got[p] == p for p in got.values())
    assert partition([got[i] for i in range(120)]) == partition(D.spectral(x).tolist())


def test_separate_parts_few_and_equal_points(spark):
    far = np.kron(np.eye(3), np.ones((10, 1))).astype(np.float32) + np.float32(0.01) * np.random.default_rng(0).normal(size=(30, 3)).astype(np.float32)
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    got = {r["seq"]: r["pred"] for r in S.cluster(frame(spark, far), near=4).collect()}
    assert partition([got[i] for i in range(30)]) == [list(range(10)), list(range(10, 20)), list(range(20, 30))]
    one = np.array([[0.6, 0.8]] * 7, np.float32)
    assert sorted(r["seq"] for r in S.cluster(frame(spark, one)).collect()) == list(range(7))
    assert [r["pred"] for r in S.cluster(frame(spark, one[:2])).collect()] == [-1, -1]
    assert S.cluster(spark.createDataFrame([], "seq long, embedding array<float>")).count() == 0


def test_edges_are_not_shuffled_by_a_product(spark):
    with Store(spark) as store:
        graph = S.normalised(store(S.affinities(frame(spark, vectors(60, 3, 2)), 5)), store)
        block = graph.select(graph["j"].alias("seq")).distinct().selectExpr("seq", "array(1d, 2d) AS q").hint("merge")
        plan = S.product(graph, block, 2)._jdf.queryExecution().executedPlan().toString()
    join = plan.index("Join")
    edges = [line for line in plan[join:].splitlines() if "Exchange" in line and "w#" in line]
    assert not edges and "Bucketed: true" in plan
