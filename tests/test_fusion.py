"""Rounds of fusion against the loop over one stream."""

import numpy as np
import pytest

from driftline.operators import density, fusion


def rows_of(spark, sizes, seed=4, d=8):
    r, rows = np.random.default_rng(seed), []
    for s, n in enumerate(sizes):
        x = r.normal(size=(3, d))[r.integers(0, 3, n)] + 0.2 * r.normal(size=(n, d))
        rows += [(f"s{s}", 10 * i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, seq long, embedding array<float>").repartition(3), rows


def loop(rows, cap, label):
    held = [(seq, np.array(v, np.float32), [seq]) for _, seq, v in rows]
    while len(held) > cap:
        held.sort(key=lambda r: r[0])
        labels = label(held)
        pairs = [(-round(float(a[1].astype(float) @ b[1].astype(float)), 6), labels[i], a[0], b[0], i, j) for i, a in enumerate(held) for j, b in enumerate(held) if i < j and labels[i] == labels[j] >= 0]
        if not pairs:
            break
        *_, i, j = min(pairs)
        v = held[i][1].astype(float) + held[j][1].astype(float)
        held = [r for k, r in enumerate(held) if k not in (i, j)] + [(held[-1][0] + 1, (v / np.linalg.norm(v)).astype(np.float32), held[i][2] + held[j][2])]
    return {tuple(m): v for _, v, m in held}


def clustered(held):
    return density.cluster(np.array([v for _, v, _ in held]), "hdbscan").tolist()


def test_as_the_loop_with_refits(spark):
    points, rows = rows_of(spark, [27, 25, 24, 6])
    got = {}
    for r in fusion.compress(points, 24).collect():
        got.setdefault(r["stream_id"], {})[tuple(r["members"])] = np.array(r["embedding"])
    for s in ("s0", "s1", "s2", "s3"):
        want = loop([r for r in rows if r[0] == s], 24, clustered)
        assert got[s].keys() == want.keys() and all(np.allclose(got[s][m], want[m], atol=1e-6) for m in want)
        assert sorted(m for ms in got[s] for m in ms) == [seq for sid, seq, _ in rows if sid == s]


def test_without_a_pair_and_empty(spark):
    points, rows = rows_of(spark, [6])
    noise = lambda df: df.selectExpr("stream_id", "seq", "-1L as pred")
    assert fusion.compress(points, 3, noise).count() == 6
    apart = lambda df: df.selectExpr("stream_id", "seq", "seq as pred")
    assert fusion.compress(points, 3, apart).count() == 6
    one = lambda df: df.selectExpr("stream_id", "seq", "0L as pred")
    got = {tuple(r["members"]) for r in fusion.compress(points, 3, one).collect()}
    assert got == set(loop(rows, 3, lambda held: [0] * len(held)))
    assert fusion.compress(points.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        fusion.compress(points, 0)


def test_a_stream_of_a_thousand_reaches_the_cap(spark):
    points, _ = rows_of(spark, [1000])
    out = fusion.compress(points, 997)
    assert out.count() == 997 and out.selectExpr("sum(size(members))").first()[0] == 1000
