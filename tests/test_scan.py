"""The scan of nearest others against the whole matrix, and the spanning tree where lists of neighbours end too early."""

import numpy as np
import pytest
from test_hierarchy import blobs, frame, kruskal

from driftline.operators import hierarchy as H
from driftline.operators import scan as S


def brute(x, k, metric, digits):
    n = len(x)
    i, j = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    d = S.exact(x[i].astype(float), x[j].astype(float), metric, digits).reshape(n, n)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [[(float(d[i, j]), int(j)) for j in row if np.isfinite(d[i, j])] for i, row in enumerate(order)]


@pytest.mark.parametrize("metric,k", [("cosine", 3), ("euclidean", 20)])
def test_nearest_with_copies_and_several_bundles(spark, monkeypatch, metric, k):
    x = blobs(200, dim=6)
    x[50:90], x[120:130] = x[3], x[4] + np.float32(1e-6)
    monkeypatch.setattr(S, "BUNDLE", 6 * 64)
    monkeypatch.setattr(S, "LEAST_ROWS", 60)
    got = {r["i"]: [tuple(n) for n in r["near"]] for r in S.nearest(frame(spark, x), k, metric, 9).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, k, metric, 9)


def test_few_points_have_all_others(spark):
    x = blobs(4)
    assert [len(r["near"]) for r in S.nearest(frame(spark, x), 9).collect()] == [3] * 4
    assert S.nearest(frame(spark, x[:1]), 9).count() == 0


@pytest.mark.parametrize("level", [1 << 20, 40])
def test_tree_of_copies_and_near_copies(spark, monkeypatch, level):
    """Lists are full of copies, so that components must look outside; rounds in a task and in tables."""
    x = blobs(110, dim=6, seed=3)
    x[10:40] = x[9]
    x[60:85] = x[59] + np.float32(1e-3) * np.random.default_rng(5).normal(size=(25, 6)).astype(np.float32)
    monkeypatch.setattr(H, "NEAR", 4)
    monkeypatch.setattr(H, "LEVEL", level)
    got = sorted(map(tuple, H.spanning_tree(frame(spark, x), 2).collect()), key=lambda e: (e[2], e[0], e[1]))
    want = kruskal(x, 2, "cosine")
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])
