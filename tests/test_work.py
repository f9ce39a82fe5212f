"""Methods run once for all their figures, and average linkage does not search the whole matrix for each merge."""

import time

import numpy as np
import pytest

from driftline.operators import density as D
from driftline.plans import harness as H
from driftline.sources import streams as S


@pytest.mark.parametrize("of, rows", [("run", 3), ("trace", 30), ("rate_sweep", 6), ("multi_seed", 3)])
def test_methods_run_once(spark, monkeypatch, tmp_path, of, rows):
    """A stream's summary, or each of its ten trace rows, is made once."""
    path = str(tmp_path / "rows")

    def noted(f):
        def note(batches):
            for pdf in batches:
                with open(path, "a") as out:
                    out.write("row\n" * len(pdf))
                yield pdf

        return lambda *args: (lambda df: df.mapInPandas(note, df.schema))(f(*args))

    for name in ("measured", "replay"):
        monkeypatch.setattr(H, name, noted(getattr(H, name)))
    pdf = S.synthetic(3, 10, 8, 1)
    points = spark.createDataFrame([(f"s{i % 3}", int(i), [float(e) for e in v], int(l)) for i, v, l in zip(pdf["seq"], pdf["embedding"], pdf["label"])], "stream_id string, seq long, embedding array<float>, label long")
    out = H.rate_sweep(points, [1, 20], ["diart_style"]) if of == "rate_sweep" else H.multi_seed(points, ["diart_style"])[1] if of == "multi_seed" else getattr(H, of)(points, ["diart_style"])
    assert out.collect() and open(path).read().count("row") == rows


def linkage(x, threshold, clusters):
    """The least of the whole matrix, merge by merge."""
    n = len(x)
    d = D.distances(x, "cosine")
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > clusters:
        i, j = sorted(divmod(int(d.argmin()), n))
        if threshold is not None and d[i, j] >= threshold:
            break
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_average_linkage():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 90):
        for x in (unit(r.normal(size=(n, 6))), unit(r.integers(1, 3, (n, 3)).astype(float)), np.ones((n, 1), np.float32)):
            for threshold, clusters in ((0.7, 1), (0.2, 1), (None, 1), (None, 4)):
                assert D.average_linkage(x, threshold, clusters).tolist() == linkage(x, threshold, clusters).tolist()
    x = unit(r.normal(size=(1000, 8)))
    a = time.perf_counter()
    got = D.average_linkage(x, None, 1)
    b = time.perf_counter()
    want = linkage(x, None, 1)
    assert got.tolist() == want.tolist() and (b - a) * 2 < time.perf_counter() - b


def tree(d, k):
    n = len(d)
    core = np.partition(d, min(k, n - 1), axis=1)[:, min(k, n - 1)]
    near, link, done, at, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        done[at] = True
        w = np.maximum(np.maximum(core[at], core), d[at])
        closer = ~done & (w < near)
        near[closer], link[closer] = w[closer], at
        nxt = int(np.where(done, np.inf, near).argmin())
        out.append((link[nxt], nxt, near[nxt]))
        at = nxt
    edges = np.array(out).reshape(-1, 3)
    return edges[np.argsort(edges[:, 2], kind="stable")]


def test_spanning_tree():
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 80):
        for x in (unit(r.normal(size=(n, 6))), unit(r.integers(1, 3, (n, 3)).astype(float)), np.ones((n, 1), np.float32)):
            d = D.distances(x, "cosine")
            assert (D.spanning_tree(d, 2) == tree(d, 2)).all()


def test_streams_are_not_put_together(spark):
    """Small streams keep the session's number of tasks."""
    from pyspark.sql import functions as F

    from driftline.plans import methods as P

    pdf = S.synthetic(4, 20, 8, 1)
    points = spark.createDataFrame([(f"s{i % 40}", int(i), [float(e) for e in v], int(l)) for i, v, l in zip(pdf["seq"], pdf["embedding"], pdf["label"])], "stream_id string, seq long, embedding array<float>, label long")
    for rows in (P.replay(points, ["diart_style"]), P.measured(points, ["diart_style"])):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_lags_share_fits(spark, monkeypatch):
    """The runs of a stream at several lags are those of one lag each, and fit each number of arrivals once."""
    import dataclasses

    from driftline.plans import methods as P

    pdf, config, chosen = S.synthetic(3, 20, 8, 1), P.Config(batch_size=4, least=3), ["adaptive_fishdbc_async", "fishdbc", "compressed_hdbscan"]
    points = spark.createDataFrame([(f"s{i % 2}", int(i), [float(e) for e in v], int(l)) for i, v, l in zip(pdf["seq"], pdf["embedding"], pdf["label"])], "stream_id string, seq long, embedding array<float>, label long")
    timed = lambda df: df.drop(*[c for c in df.columns if "_ms" in c or c == "peak_python_mb"])
    got = sorted(map(str, timed(P.measured(points, chosen, config, lags=[10, 1])).collect()))
    want = [f"Row(lag={lag}, " + str(r)[4:] for lag in (10, 1) for r in timed(P.measured(points, chosen, dataclasses.replace(config, commit_lag=lag))).collect()]
    assert got == sorted(want) and len(got) == 12
    fits, memo = [], {}
    monkeypatch.setattr(P.D, "cluster", lambda x, *a, f=P.D.cluster: fits.append(len(x)) or f(x, *a))
    for lag in (10, 1):
        for name in chosen[:2]:
            m = P.method(name, dataclasses.replace(config, commit_lag=lag))
            m.memo = memo
            for v in pdf["embedding"]:
                m.update(np.asarray(v, np.float32))
                m.evaluation()
            m.finish()
    assert len(fits) == len(set(fits)) and m.saved > 0
