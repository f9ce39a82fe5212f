"""Frozen models against the fold that predicts, prefixes against fits one after the other."""

import numpy as np
import pytest

from driftline.operators import density, frozen
from driftline.plans import methods, prefixes


def streams_of(spark, sizes, seed=3, d=8):
    r, rows = np.random.default_rng(seed), []
    for s, n in enumerate(sizes):
        x = r.normal(size=(3, d))[r.integers(0, 3, n)] + 0.15 * r.normal(size=(n, d))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        rows += [(f"s{s}", 1000 * s + i, v.tolist(), 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, seq long, embedding array<float>, label long").repartition(3), rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_as_the_fold(spark, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(frozen, "FEW_BYTES", 0)
    points, rows = streams_of(spark, [90, 60, 20])
    got = {r["seq"]: r["pred"] for r in frozen.predict(points, frozen.fit(points)).collect()}
    for s in ("s0", "s1", "s2"):
        m = methods.method("approx_predict", methods.Config())
        mine = [(seq, v) for sid, seq, v, _ in rows if sid == s]
        for _, v in mine:
            m.update(np.asarray(v, np.float32))
        want = dict(zip((seq for seq, _ in mine), m.labels))
        assert {k: got[k] for k in want} == want
        assert s == "s2" or any(want[seq] >= 0 for seq, _ in mine[20:])


def test_noise_short_streams_and_one_cluster(spark):
    points, rows = streams_of(spark, [25, 7])
    one = frozen.model(frozen.warm(points), "label")
    assert [r["stream_id"] for r in one.collect()] == ["s0"] and one.first()["reach"] == {0: float("inf")}
    got = {r["seq"]: (r["pred"], r["reach"]) for r in frozen.predict(points, one).collect()}
    assert len(got) == 32 and all(got[s][0] == (0 if sid == "s0" else -1) for sid, s, _, _ in rows)
    assert all((got[s][1] is None) == (sid == "s1" or s < 20) for sid, s, _, _ in rows)
    none = frozen.model(frozen.warm(points).selectExpr("stream_id", "seq", "embedding", "-1L as label"), "label")
    assert {r["pred"] for r in frozen.predict(points, none).collect()} == {-1}
    empty = points.limit(0)
    assert frozen.predict(empty, frozen.fit(empty)).count() == 0


@pytest.mark.parametrize("backend", ["hdbscan", "ahc"])
def test_prefixes_side_by_side(spark, backend):
    points, rows = streams_of(spark, [47, 20, 1])
    fits = prefixes.refit(points, backend, 20)
    got = {}
    for r in fits.collect():
        got.setdefault((r["stream_id"], r["upto"]), {})[r["seq"]] = r["pred"]
    assert set(got) == {("s0", 20), ("s0", 40), ("s0", 47), ("s1", 20), ("s2", 1)}
    for (s, upto), labels in got.items():
        mine = [(seq, v) for sid, seq, v, _ in rows if sid == s][:upto]
        want = density.cluster(np.array([v for _, v in mine], np.float32), backend)
        assert [labels[seq] for seq, _ in mine] == want.tolist() and len(labels) == upto
    work = {r["stream_id"]: (r["recompute_count"], r["fitted_points"], r["distance_comparisons"]) for r in prefixes.work(fits).collect()}
    assert work == {"s0": (3, 107, 190 + 780 + 1081), "s1": (1, 20, 190), "s2": (1, 1, 0)}
    assert prefixes.quality(fits).count() == 5
    with pytest.raises(ValueError):
        prefixes.prefixes(points, 0)
