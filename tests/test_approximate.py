"""Approximate neighbours: recall against the exact ones, work, hot buckets, few points."""

import numpy as np
import pytest

from driftline.operators import approximate as A
from driftline.operators import neighbours as N
from driftline.operators.storage import Store


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, embedding array<float>").repartition(4)


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(5)
    return unit(r.normal(size=(60, 32))[r.integers(0, 60, 3000)] + 0.35 * r.normal(size=(3000, 32)))


def test_recall_and_work(spark, clustered):
    points = frame(spark, clustered)
    found = A.nearest(points, 5, tables=8, probes=6, bucket=100)
    assert A.recall(found, N.nearest(points, 5)).first()["recall"] >= 0.9
    rows = A.asked(points, A.planes(3000, 100), 8, 6)
    counts = rows.groupBy("t", "code").agg({"stands": "count"}).count()
    assert counts <= 8 * 2 ** A.planes(3000, 100)
    pairs = sum(r["n"] * r["m"] for r in rows.selectExpr("t", "code", "cast(stands as int) s").groupBy("t", "code").agg({"s": "sum", "*": "count"}).toDF("t", "code", "n", "m").collect())
    assert pairs < 8 * 3000 * 3000 / 2


def test_distances_are_exact_and_seeded(spark, clustered):
    points = frame(spark, clustered[:400])
    one, two = (A.nearest(points, 4, bucket=50).orderBy("i").collect() for _ in range(2))
    assert one == two
    x = clustered[:400].astype(float)
    for r in one[:50]:
        assert r["i"] not in [n["j"] for n in r["near"]] and len({n["j"] for n in r["near"]}) == len(r["near"])
        assert all(abs(n["distance"] - (1 - np.clip(x[r["i"]] @ x[n["j"]], -1, 1))) < 1e-9 for n in r["near"])


def test_a_hot_bucket_is_dealt_to_parts_and_loses_nothing(spark):
    x = np.concatenate((np.tile(unit(np.ones((1, 8))), (90, 1)), unit(np.random.default_rng(1).normal(size=(60, 8)))))
    points = frame(spark, x)
    with Store(spark) as store:
        rows = store(A.asked(points, 2, 3, 1))
        whole, parts = (sorted(map(tuple, A.compared_in_buckets(rows, 3, store, p).collect())) for p in (1000, 25))
        top = lambda found: {r["i"]: [(n["distance"], n["j"]) for n in r["near"]] for r in N.top(spark.createDataFrame(found, "i long, distance double, j long"), 3).collect()}
        a, b = top(whole), top(parts)
    assert a.keys() == b.keys() and all([j for _, j in a[i]] == [j for _, j in b[i]] for i in a)
    assert len(parts) > len(whole)


def test_few_points(spark):
    assert A.nearest(spark.createDataFrame([], "seq long, embedding array<float>"), 2).count() == 0
    assert A.nearest(frame(spark, unit(np.ones((1, 4)))), 2).count() == 0
    assert [len(r["near"]) for r in A.nearest(frame(spark, unit(np.ones((2, 4)))), 5).collect()] == [1, 1]
