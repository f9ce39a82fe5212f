"""Metrics, trees, methods and streams against brute force and closed forms."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from driftline import queries
from driftline.operators import density as D
from driftline.operators import metrics as M
from driftline.plans import methods as P
from driftline.sources import streams as S


def frame(spark, pdf, name="s"):
    return spark.createDataFrame(pdf.assign(stream_id=name, embedding=pdf["embedding"].map(lambda v: v.tolist())), "seq long, embedding array<float>, label long, stream_id string")


def test_assign():
    r = np.random.default_rng(1)
    for _ in range(60):
        m = r.integers(0, 9, r.integers(1, 6, 2))
        s = m if m.shape[0] <= m.shape[1] else m.T
        assert M.assign(m) == max(sum(s[i, p[i]] for i in range(len(s))) for p in itertools.permutations(range(s.shape[1]), len(s)))


def test_quality_by_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(4), r.randrange(-1, 4)) for i in range(40)]
    q = M.quality(spark.createDataFrame(rows, "seq long, label long, pred long")).first()
    pairs = [(a[1] == b[1], a[2] == b[2] >= 0) for a, b in itertools.combinations(rows, 2)]
    tp, placed, same = sum(t and p for t, p in pairs), sum(p for _, p in pairs), sum(t for t, _ in pairs)
    assert abs(q.pairwise_precision - tp / placed) < 1e-8 and abs(q.pairwise_recall - tp / same) < 1e-8
    assert abs(q.false_merge_rate - (placed - tp) / (len(pairs) - same)) < 1e-8
    one = M.quality(spark.createDataFrame([(0, 1, 1)], "seq long, label long, pred long")).first()
    assert one.ari == one.nmi == one.pairwise_recall == 0


def test_accuracy_of_random_tables(spark):
    """Against a matching on the whole table, every noise row a cluster of its own."""
    r = random.Random(8)
    rows, want = [(0, i, l, p) for i, (l, p) in enumerate([(0, 2), (0, -1)] + [(1, 2)] * 5)], {}
    for t in range(1, 200):
        rows += [(t, i, r.randrange(4), r.choice([-1, -1, 0, 1, 2, 3])) for i in range(r.randrange(1, 14))]
    for t in range(200):
        mine = [(l, p) for u, _, l, p in rows if u == t]
        full = [(l, p if p >= 0 else 100 + i) for i, (l, p) in enumerate(mine)]
        best = lambda cells: M.assign(pd.crosstab([a for a, _ in cells], [b for _, b in cells]).to_numpy()) if cells else 0
        real = [c for c in mine if c[1] >= 0]
        want[t] = (best(real) / len(mine), best(real) / len(real) if real else 0, best(full) / len(mine))
    got = M.accuracy(spark.createDataFrame(rows, "t long, seq long, label long, pred long"), ("t",)).collect()
    assert all(np.allclose((g.cluster_accuracy, g.cluster_accuracy_non_noise, g.cluster_accuracy_noise_singletons), want[g.t], atol=1e-8) for g in got) and len(got) == 200
    assert abs(want[0][2] - 6 / 7) < 1e-9


def test_spanning_tree_weight():
    x = np.random.default_rng(2).normal(size=(30, 4))
    d, k = D.distances(x, "euclidean"), 3
    core = np.sort(d, 1)[:, k]
    w = np.maximum(np.maximum(core[:, None], core), d)
    root, total = list(range(30)), 0.0
    for i, j in sorted(itertools.combinations(range(30), 2), key=lambda p: w[p]):
        if root[i] != root[j]:
            total, root = total + w[i, j], [root[i] if c == root[j] else c for c in root]
    assert abs(D.spanning_tree(d, k)[:, 2].sum() - total) < 1e-9


@pytest.mark.parametrize("backend", ["hdbscan", "fishdbc", "ahc"])
def test_backends_find_separate_groups(backend):
    pdf = S.synthetic(5, 24, 32, 3, mode=0.05, noise=0.05, outliers=0.0)
    got = D.cluster(np.stack(pdf["embedding"].to_list()), backend)
    table = pd.crosstab(pdf["label"], got)
    assert (table.to_numpy() > 0).sum(1).max() == 1 and table.shape[0] == table.shape[1] == 5


def test_counters(spark):
    n = 60
    out = P.replay(frame(spark, S.synthetic(5, 12, 16, 1)), list(P.METHODS), P.Config(tradeoff_warmup=20, cap=30)).where("last").groupBy("method").agg({c: "max" for c in P.Method.counters}).toPandas()
    out = out.set_index("method").rename(columns=lambda c: c[4:-1])
    assert out.loc["full_hdbscan", "distance_comparisons"] == n * (n * n - 1) // 6
    assert out.loc["fishdbc", "distance_comparisons"] == sum(range(4, n + 1))
    for m in ("adaptive_tradeoff", "adaptive_fishdbc", "adaptive_fishdbc_async", "diart_style"):
        assert out.loc[m, "cheap_update_count"] == out.loc[m, "local_update_count"] > 0
    assert out.loc["diart_style", "cheap_update_count"] == n and out.loc["fishdbc", "local_update_count"] == 0
    assert out.loc["ahc", "full_trigger_count"] == out.loc["sc_pna", "full_trigger_count"] == 0 < out.loc["full_hdbscan", "full_trigger_count"]
    assert out.loc["adaptive_fishdbc_async", "risk_flush_count"] == out.loc["adaptive_fishdbc_async", "uncertainty_count"]
    for m in ("adaptive_fishdbc", "adaptive_fishdbc_async"):
        assert out.loc[m, "incremental_cluster_count"] == out.loc[m, "recompute_count"]
        assert out.loc[m, "cheap_update_count"] + out.loc[m, "uncertainty_count"] == n - 20
    assert out.loc["approx_predict", "prediction_count"] == n - 20 and out.loc["approx_predict", "recompute_count"] == 1


def test_flushed_labels_agree(spark):
    out = P.replay(frame(spark, S.synthetic(4, 15, 16, 2)), ["fishdbc", "adaptive_fishdbc", "adaptive_fishdbc_async"]).where("last").toPandas()
    by = {m: g.sort_values("seq")["pred"].tolist() for m, g in out.groupby("method")}
    assert by["fishdbc"] == by["adaptive_fishdbc"] == by["adaptive_fishdbc_async"]


def test_stream_agrees_with_batch(spark, tmp_path):
    from driftline.streaming.gate import assign_stream

    points = frame(spark, S.synthetic(4, 15, 16, 5))
    for i in range(3):
        points.where(f"floor(seq / 20) = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(points.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = assign_stream(src).writeStream.format("memory").queryName("assigned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r.pred for r in spark.table("assigned").collect()}
    want = P.replay(points, ["diart_style"]).where("last").toPandas()
    assert got == dict(zip(want["seq"], want["pred"]))


def test_configuration():
    with pytest.raises(ValueError):
        P.Config(margin=0)


def test_generators():
    a, b = S.drifting(8, 80, 16, 1), S.drifting(8, 80, 16, 1)
    assert a["label"].tolist() == b["label"].tolist() and set(a["label"][:40]) == {0, 1, 2, 3} and set(a["label"][40:]) == set(range(8))
    # without noise: the last arrivals of a speaker are its unit centre moved by nearly the whole drift, the first by nearly none
    still = S.drifting(4, 400, 16, 1, drift=0.5, noise=0.0)
    x = np.stack(still["embedding"].to_list())
    ends = [x[still["label"] == k][[0, -1]] for k in range(4)]
    assert all(0.8 < e[0] @ e[1] < 1 for e in ends) and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    # without noise and outliers all points of a speaker are one vector: centre plus its share of the second direction
    flat = S.synthetic(3, 10, 16, 2, mode=0.3, noise=0.0, outliers=0.0)
    assert all(len({v.tobytes() for v in g["embedding"]}) == 1 for _, g in flat.groupby("label"))
    main = S._centres(np.random.default_rng(5), 6, 16, 0.45)
    assert (main @ main.T - np.eye(6)).max() < 0.45


def test_every_query_has_rows(spark):
    for name in ("dataset_profile", "confidence_gate", "hungarian_accuracy"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_tiles_agree_with_brute_force(spark, monkeypatch):
    from driftline.operators import neighbours as N

    monkeypatch.setattr(N, "GROUP", 20)
    monkeypatch.setattr(N, "TILE", 7)
    pdf = S.synthetic(5, 18, 16, 3)
    points = frame(spark, pdf)
    x = np.stack(pdf["embedding"].to_list()).astype(float)
    d = 1 - np.clip(x @ x.T, -1, 1)
    got = {(r.i, r.j): r.distance for r in N.pairs(points).collect()}
    assert got.keys() == {(i, j) for i in range(90) for j in range(i + 1, 90)} and all(abs(got[k] - d[k]) < 1e-12 for k in got)
    np.fill_diagonal(d, np.inf)
    near = {r.i: [(n.distance, n.j) for n in r.near] for r in N.nearest(points, 3).collect()}
    for i in range(90):
        order = np.lexsort((np.arange(90), d[i]))[:3]
        assert [j for _, j in near[i]] == order.tolist()
    best = {r.label: (r.i, r.j) for r in N.best_pair(points).collect()}
    label = pdf["label"].to_numpy()
    for l in range(5):
        s = np.where((label[:, None] == l) & (label == l) & np.triu(np.ones((90, 90), bool), 1), np.round(x @ x.T, 6), -np.inf)
        assert best[l] == tuple(np.argwhere(s == s.max())[0])


def test_runs(spark, tmp_path):
    """Summaries, a failed method beside others, traces, sweeps and files."""
    from driftline.plans import harness as H

    points = frame(spark, S.synthetic(4, 12, 16, 3))

    rows = {r.method: r for r in H.run(points, ["unknown", "diart_style", "window_hdbscan", "adaptive_fishdbc_observed"], P.Config(cap=20)).collect()}
    bad = rows["unknown"]
    assert bad.status == "failed" and "unknown" in bad.error and bad.ari is None and bad.wall_ms >= 0
    ok = rows["diart_style"]
    assert ok.status == "ok" and ok.n_input == 48 and ok.cheap_update_rate == 1 and ok.ari is not None and ok.p95_step_ms >= 0 and ok.cold_start_steps_excluded == 1
    assert rows["window_hdbscan"].evaluation_points == 20 and rows["window_hdbscan"].checkpoint_mean_active_points == (10 + 20 * 4) / 5
    assert rows["adaptive_fishdbc_observed"].recompute_count == 48
    trace = H.trace(points, ["diart_style"]).orderBy("step").collect()
    assert [r.step for r in trace] == [10, 20, 30, 40, 48] and trace[-1].action == "finalize" and [r.evaluation_points for r in trace] == [10, 20, 30, 40, 48]
    sweep = H.rate_sweep(points, [1, 20], ["fishdbc"]).collect()
    assert {r.interval_ms for r in sweep} == {1.0, 20.0} and all(r.recompute_count == 48 for r in sweep)
    stored = H.store(spark, points, ["diart_style", "unknown"], P.Config(), f"{tmp_path}/run")
    assert stored.count() == 2 and S.results(spark, f"{tmp_path}/run/trace").count() == 5
    assert H.preset("async")[1].batch_size == 4


def test_sources(spark, tmp_path):
    import wave

    (tmp_path / "m.csv").write_text("path,speaker,speaker_id,digit,utterance_id,sample_rate_hz,num_samples\n")
    with pytest.raises(ValueError):
        S.manifest(spark, str(tmp_path / "m.csv"))
    with open(tmp_path / "m.csv", "a") as f:
        f.write("/root/x/a.wav,ann,0,3,7,8000,100\n")
    rows = S.manifest(spark, str(tmp_path / "m.csv"))
    assert rows.select(S.relative("path", "/root/x/")).first()[0] == "a.wav" and rows.select(S.relative("path", "/other")).first()[0] == "/root/x/a.wav"
    with wave.open(str(tmp_path / "3_ann_7.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 10)
    files = S.wav_files(spark, str(tmp_path))
    assert (files.first().digit, files.first().speaker, files.first().utterance) == (3, "ann", 7)
    assert S.stale(files, files).count() == 0 and S.stale(files, files.withColumn("sha256", files.path)).count() == 1
    np.savez(tmp_path / "x.npz", X=np.eye(3, dtype=np.float32), y=np.arange(3))
    assert [r.label for r in S.npz(spark, str(tmp_path)).orderBy("seq").collect()] == [0, 1, 2]
    picked = S.permuted(spark.createDataFrame([(g, i) for g in "ab" for i in range(5)], "g string, i long"), "g", "i", 2, 1).orderBy("position").collect()
    assert [r.g for r in picked] == ["a", "b", "a", "b"]
