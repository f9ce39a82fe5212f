"""Jobs of the command line on small files, what they store, and the comparison's cases."""

import numpy as np
import pytest

from driftline.__main__ import chosen, main, parser
from driftline.plans import reports
from driftline.sources import streams as S


@pytest.fixture(scope="module")
def points(tmp_path_factory):
    """One stream of 40 points in an NPZ file."""
    rows = S.synthetic(4, 10, 8, 1)
    at = tmp_path_factory.mktemp("points")
    np.savez(at / "one.npz", X=np.stack(rows["embedding"].to_list()), y=rows["label"].to_numpy())
    return str(at)


def test_flags_go_over_the_preset():
    args = parser().parse_args(["run", "--points", "p", "--out", "o", "--preset", "async", "--batch-size", "7", "--no-repair"])
    methods, config = chosen(args)
    assert methods == ["adaptive_fishdbc_async", "fishdbc"]
    assert (config.batch_size, config.repair, config.tradeoff_warmup, config.margin) == (7, False, 20, 0.02)
    with pytest.raises(SystemExit):
        parser().parse_args(["run", "--points", "p", "--out", "o", "--methods", "none_such"])
    with pytest.raises(ValueError):
        chosen(parser().parse_args(["run", "--points", "p", "--out", "o", "--margin", "0"]))


def test_run_then_compare(spark, points, tmp_path):
    out = f"{tmp_path}/out"
    rows = main(["run", "--points", points, "--npz", "--methods", "full_hdbscan", "diart_style", "--checkpoint", "20", "--out", out], spark)
    assert sorted(r["method"] for r in rows.collect()) == ["diart_style", "full_hdbscan"]
    assert S.summaries(spark, f"{out}/summary", lines=True).count() == 2
    got = {r["method"]: r for r in main(["compare", "--full", f"{out}/summary", "--candidates", f"{out}/summary", "--out", f"{tmp_path}/c"], spark).collect()}
    assert got["full_hdbscan"]["speedup_vs_full"] == 1 and got["full_hdbscan"]["delta_ari"] == 0
    mine, full = (next(r for r in rows.collect() if r["method"] == m) for m in ("diart_style", "full_hdbscan"))
    assert got["diart_style"]["delta_nmi"] == mine["nmi"] - full["nmi"]
    assert got["diart_style"]["distance_comparisons_per_input"] == mine["distance_comparisons_per_input"]
    assert S.results(spark, f"{tmp_path}/c/comparison_csv").count() == 2


def test_sweeps_are_stored(spark, points, tmp_path):
    rows = main(["sweep", "--points", points, "--npz", "--methods", "diart_style", "window_hdbscan", "--intervals", "1", "5", "--out", f"{tmp_path}/s"], spark)
    assert sorted((r["interval_ms"], r["method"]) for r in rows.collect()) == [(1.0, "diart_style"), (1.0, "window_hdbscan"), (5.0, "diart_style"), (5.0, "window_hdbscan")]
    assert all(0 <= r["acc"] <= 1 for r in rows.collect())
    mean = main(["seeds", "--points", points, "--npz", "--methods", "diart_style", "--seeds", "1", "2", "3", "--out", f"{tmp_path}/m"], spark).collect()
    runs = S.results(spark, f"{tmp_path}/m/seeds").toPandas()
    assert len(mean) == 1 and len(runs) == 3
    assert abs(mean[0]["ari_mean"] - runs["ari"].mean()) < 1e-6 and abs(mean[0]["ari_std"] - runs["ari"].std(ddof=0)) < 1e-6


def test_means_of_all_steps_stand_in(spark):
    kind = "method string, status string, mean_step_ms double, p95_step_ms double, steady_mean_step_ms double, ari double, full_trigger_rate double"
    full = spark.createDataFrame([("full_hdbscan", "ok", 8.0, 9.0, None, 0.5, 1.0)], kind)
    others = spark.createDataFrame([("fishdbc", "ok", 3.0, 4.0, 2.0, 0.75, None), ("ahc", "failed", None, None, None, None, None), ("full_hdbscan", "ok", 1.0, 1.0, 1.0, 0.0, 0.0)], kind)
    got = {r["method"]: r.asDict() for r in reports.compare_to_full(full, others, ["ari"]).collect()}
    assert set(got) == {"full_hdbscan", "fishdbc", "ahc"}
    assert (got["fishdbc"]["speedup_vs_full"], got["fishdbc"]["steady_p95_step_ms"], got["fishdbc"]["full_steady_p95_step_ms"]) == (4.0, 4.0, 9.0)
    assert (got["fishdbc"]["full_trigger_rate"], got["full_hdbscan"]["full_trigger_rate"], got["fishdbc"]["delta_ari"]) == (0.0, 1.0, 0.25)
    assert (got["ahc"]["speedup_vs_full"], got["ahc"]["steady_mean_step_ms"], got["ahc"]["delta_ari"]) == (0.0, 0.0, None)
    with pytest.raises(ValueError):
        reports.compare_to_full(others.where("method = 'ahc'"), others, ["ari"])
    with pytest.raises(Exception, match="has no mean"):
        reports.compare_to_full(full.drop("mean_step_ms"), others, ["ari"]).collect()


def test_what_is_stale(spark):
    kind = "path string, sha256 string, model string, n long"
    rows = spark.createDataFrame([("a", "1", "m", 5), ("b", "2", "m", 5), ("c", "3", None, 5), ("d", None, "m", 5), ("e", "5", "m", 5)], kind)
    done = spark.createDataFrame([("a", "1", "m", 5), ("a", "1", "m", 5), ("b", "2", "old", 5), ("c", "3", None, 5), ("d", None, "m", 5), ("e", "5", "m", 4)], kind)
    left = lambda *also: sorted(r["path"] for r in S.stale(rows, done, also=also).collect())
    assert left() == ["d"]
    assert left("model") == ["b", "d"]
    assert left("model", "n") == ["b", "d", "e"]


def test_summary_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"method": "a",\n "ari": 0.5},\n {"method": "b"}]')
    (tmp_path / "one.json").write_text('{"method": "c",\n "ari": 1.0}')
    assert sorted(((r["method"], r["ari"]) for r in S.summaries(spark, f"{tmp_path}/*.json").collect()), key=str) == [("a", 0.5), ("b", None), ("c", 1.0)]


def test_groups_with_too_few_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, i long")
    assert S.round_robin(rows, "g", "i", 1).count() == 2
    with pytest.raises(Exception, match="too few rows"):
        S.round_robin(rows, "g", "i", 2).collect()
