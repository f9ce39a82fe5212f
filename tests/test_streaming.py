"""Two queries of the deferred method over restarts; the count window's state against the fold."""

import numpy as np
import pytest

from driftline.operators import density
from driftline.plans.methods import Config
from driftline.streaming import window
from driftline.streaming.deferred import Deferred

POINTS = "stream_id string, seq long, embedding array<float>"


def arrivals(streams, sizes, seed=2, d=8):
    """Parts of arrivals: clusters that are far from each other, a new one in the last part."""
    r = np.random.default_rng(seed)
    centres, out, seq = np.eye(d), [], 0
    for part, n in enumerate(sizes):
        rows = []
        for s in streams:
            for i in range(n):
                x = centres[(i % 2) + (2 if part == len(sizes) - 1 else 0)] + 0.05 * r.normal(size=d)
                rows.append((s, seq + i, (x / np.linalg.norm(x)).astype(np.float32).tolist()))
        seq += n
        out.append(rows)
    return out


def add(spark, rows, folder):
    spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(folder)


def once(query):
    query.awaitTermination()
    assert query.exception() is None


def test_a_commit_changes_later_labels_only(spark, tmp_path):
    source, folder = str(tmp_path / "source"), f"file://{tmp_path}/tables"
    first, second, third = arrivals(["a", "b"], [20, 6, 12])

    def gate(m):
        once(m.gate(spark.readStream.schema(POINTS).parquet(source), availableNow=True))
        return {(r["stream_id"], r["seq"]): (r["version"], r["pred"], r["action"]) for r in m.table("decisions", "stream_id string, seq long, version long, pred long, action string", "batch").collect()}

    add(spark, first, source)
    m = Deferred(spark, folder)
    one = gate(m)
    assert len(one) == 40 and set(one.values()) == {(-1, -1, "warmup")} and m.version() == -1
    once(m.maintenance(availableNow=True))
    assert m.version() == 0 and m.reps(0).count() == 4
    # restarted: the new arrivals are sure, the decisions made before stand
    add(spark, second, source)
    m = Deferred(spark, folder)
    two = gate(m)
    assert {k: v for k, v in two.items() if k in one} == one
    assert {(v, a) for k, (v, _, a) in two.items() if k not in one} == {(0, "buffer")}
    labels = {(r["stream_id"], r["seq"]): r["pred"] for r in m.labels().collect()}
    assert all(labels["a", i] == labels["a", i % 2] >= 0 for i in range(26)) and labels["a", 0] != labels["a", 1]
    # decided before the maintenance of the second part comes: by version 0, so the new clusters are unsure
    add(spark, third, source)
    m = Deferred(spark, folder)
    three = gate(m)
    assert {k: v for k, v in three.items() if k in two} == two
    assert {v for k, v in three.items() if k not in two} == {(0, -1, "risk_flush")}
    once(m.maintenance(availableNow=True))
    assert m.version() == 1 and m.reps(1).count() == 8
    assert gate(m) == three
    rows = m.labels().collect()
    assert len(rows) == len({(r["stream_id"], r["seq"]) for r in rows}) == 76
    for s, part in (("a", first + second + third), ("b", first + second + third)):
        x = np.array([v for sid, _, v in part if sid == s], np.float32)
        got = [r["pred"] for r in sorted(rows, key=lambda r: r["seq"]) if r["stream_id"] == s]
        assert got == density.cluster(x, "fishdbc").tolist()
    # nothing new: no version; a repeated micro-batch writes nothing
    once(m.maintenance(availableNow=True))
    m.commit(1, 2)
    assert m.version() == 1


def test_streams_that_are_not_due_keep_their_representatives(spark, tmp_path):
    source = str(tmp_path / "source")
    first, second = arrivals(["a", "b"], [16, 12])
    m = Deferred(spark, f"file://{tmp_path}/tables")
    for rows in (first + [("short", 900 + i, [1.0] + [0.0] * 7) for i in range(5)], [r for r in second if r[0] == "a"]):
        add(spark, rows, source)
        once(m.gate(spark.readStream.schema(POINTS).parquet(source), availableNow=True))
        once(m.maintenance(availableNow=True))
    reps = [{(r["stream_id"], r["label"]): r["rep"] for r in m.reps(v).collect()} for v in (0, 1)]
    assert {s for s, _ in reps[0]} == {"a", "b"} and len(reps[1]) == 6
    assert all(reps[1]["b", i] == reps[0]["b", i] for i in (0, 1))
    assert {r["stream_id"] for r in m.table("labels", "stream_id string, seq long, pred long, upto long", "version").where("version = 1").collect()} == {"a"}


def test_the_window_is_the_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", window.STORE)
    source, out, c = str(tmp_path / "source"), str(tmp_path / "out"), Config(cap=10)
    parts = arrivals(["a", "b"], [7, 9, 4])
    try:
        for rows in parts:
            add(spark, rows, source)
            q = window.window_stream(spark.readStream.schema(POINTS).parquet(source), c)
            once(q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["stream_id"], r["seq"]): (r["pred"], r["held"]) for r in spark.read.parquet(out).collect()}
    assert len(got) == 40
    for s in ("a", "b"):
        x = np.array([v for rows in parts for sid, _, v in rows if sid == s], np.float32)
        for i in range(20):
            w = x[max(0, i - 9) : i + 1]
            assert got[s, i] == (density.cluster(w, "hdbscan")[-1], len(w))
