"""The spanning tree, the condensed tree and the labels as a dataflow, against the sequential functions."""

import numpy as np
import pytest

from driftline.operators import density as D
from driftline.operators import hierarchy as H
from driftline.operators import neighbours as N
from driftline.operators.storage import Store


def blobs(n, dim=8, seed=0, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))
    x[: n // 5] = r.normal(size=(n // 5, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, embedding array<float>").repartition(4)


def kruskal(x, k, metric):
    """The tree by all edges in order."""
    d = H.distance_rows(x.astype(float), x.astype(float), metric)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(core[:, None], core), d)
    a, b = np.triu_indices(len(x), 1)
    root, out = list(range(len(x))), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.lexsort((b, a, w[a, b])):
        p, q = find(a[i]), find(b[i])
        if p != q:
            root[p] = q
            out.append((int(a[i]), int(b[i]), float(w[a[i], b[i]])))
    return out


def same_partition(a, b):
    pairs = {(x, y) for x, y in zip(a, b)}
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and {(x < 0) == (y < 0) for x, y in pairs} == {True}


@pytest.mark.parametrize("metric,n", [("cosine", 120), ("euclidean", 500)])
def test_tree_and_labels(spark, monkeypatch, metric, n):
    monkeypatch.setattr(N, "GROUP", n // 3)
    monkeypatch.setattr(N, "TILE", 50)
    monkeypatch.setattr(H, "LEVEL", 250)
    x = blobs(n)
    tree = H.spanning_tree(frame(spark, x), 2, metric)
    want = kruskal(x, 2, metric)
    got = sorted(map(tuple, tree.collect()), key=lambda e: (e[2], e[0], e[1]))
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])
    labels = {r["seq"]: r["cluster"] for r in H.extract(tree, 4).collect()}
    mine = [-1 if labels[i] is None else -labels[i] for i in range(len(x))]
    assert same_partition(mine, D.extract(np.array(want), len(x), 4).tolist())
    assert len(set(mine)) > 2


@pytest.mark.parametrize("seed", range(2))
def test_labels_of_random_trees(spark, seed):
    """Several levels, least sizes and shapes of trees, a chain included."""
    r = np.random.default_rng(seed)
    n = 60
    edges = sorted([(float(r.random()), int(r.integers(0, i)) if seed else i - 1, i) for i in range(1, n)])
    tree = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double")
    for least in (2, 5):
        want = D.extract(np.array([(a, b, w) for w, a, b in edges]), n, least)
        for level in (20,):
            got = {s: c for s, c in H.extract(tree, least, level).collect()}
            assert same_partition([-1 if got[i] is None else -got[i] for i in range(n)], want.tolist())


def test_forest_of_a_graph_in_parts(spark):
    edges = [(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.5), (7, 8, 0.1), (8, 9, 0.1), (7, 9, 0.2)]
    with Store(spark) as store:
        got = H.boruvka(spark.createDataFrame(edges, "a long, b long, w double"), store).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.5), (1, 3, 0.5), (7, 8, 0.1), (8, 9, 0.1)]


def test_few_and_equal_points(spark):
    one = np.array([[1.0, 0.0]] * 9, np.float32)
    for n, want in ((0, []), (1, [-1]), (3, [-1] * 3), (9, [-1] * 9)):
        got = H.cluster(frame(spark, one[:n]) if n else spark.createDataFrame([], "seq long, embedding array<float>")).collect()
        assert [r["pred"] for r in got] == want
