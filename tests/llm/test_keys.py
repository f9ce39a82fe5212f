"""Scores and classes where blocks go through several levels and short keys collide."""

import duckdb
import numpy as np
import pytest

from driftline.llm import blocks, jaccard, lm


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, " ".join(f"v{(i * j * j + j) % 97}" for j in range(60))) for i in range(20)], "doc_id long, text string").repartition(5)


def want(docs, min_count=2):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return {r[0]: r[2] for r in con.execute(lm.SQL.replace(">= 2", f">= {min_count}")).fetchall()}


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_scores_count_by_all_bits(docs, monkeypatch, min_count):
    monkeypatch.setattr(lm, "FILTER_BITS", -100)  # keys of 32 bits
    expect = want(docs, min_count)
    got = {r.doc_id: r.mean_log_score for r in lm.scores(docs, min_count=min_count).collect()}
    assert got.keys() == expect.keys() and all(abs(got[i] - expect[i]) < 2e-6 for i in expect)


def test_levels(docs, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 2)
    monkeypatch.setattr(lm, "RANGE_BYTES", 700)
    expect = want(docs)
    got = {r.doc_id: r.mean_log_score for r in lm.scores(docs).collect()}
    assert got.keys() == expect.keys() and all(abs(got[i] - expect[i]) < 2e-6 for i in expect)


def test_jaccard_levels(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(6)
    whole = sorted(map(tuple, jaccard.link(rows).collect()))
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(blocks.ranges, "__defaults__", (20_000,))
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    assert sorted(map(tuple, jaccard.link(rows).collect())) == whole


def test_rows_of_the_exchange_follow_the_blocks():
    """A block has FAN runs at most, whatever number of ranges there is."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 200_000, dtype=np.uint64))
    for n in (128, 200, 5_000, 1 << 20):
        kind = blocks.Keys(n, 48, bool, bool, blocks.any_of, blocks.in_several)
        step = blocks.top_step(n)
        runs = list(kind.split(keys, np.zeros(len(keys), bool), step))
        assert len(runs) <= blocks.FAN and sum(len(blocks.unpack_keys(r)[0]) for _, r in runs) == len(keys)
        assert all((int(k) * n >> 48) // step == part for part, r in runs for k in blocks.unpack_keys(r)[0][[0, -1]])


def test_a_bundle_holds_no_more_than_a_few_blocks(spark, monkeypatch, tmp_path):
    """Just above FAN ranges there were FAN blocks in a bundle of two parts: a task held half of all their keys."""
    monkeypatch.setattr(blocks, "FAN", 32)
    units, each, seen = 64, 1000, str(tmp_path / "seen")

    def combine(keys, values):
        with open(seen, "a") as f:
            f.write(f"{len(keys)}\n")
        return blocks.any_of(keys, values)

    n = 40
    kind = blocks.Keys(n, 64, bool, bool, combine, blocks.in_several)
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, each, dtype=np.uint64))
    rows = [(u, part, bytearray(run)) for u in range(units) for part, run in kind.split(keys, np.zeros(each, bool), blocks.top_step(n))]
    out = blocks.answer(spark.createDataFrame(rows, blocks.RUNS), kind, units).toPandas()
    assert all(blocks.in_order(a, bool).all() and len(blocks.in_order(a, bool)) == each for _, a in out.groupby("unit")) and out["unit"].nunique() == units
    assert max(map(int, open(seen).read().split())) <= 4 * each


def test_parts_of_all_levels_are_as_many(monkeypatch):
    assert blocks.top_step(500) == 1  # 6 GB of text in ranges of 12 MB
    for n in (129, 5_000, 20_000, 1 << 20):
        parts, levels = blocks.fan(n)
        assert parts <= blocks.FAN and (parts - 1) ** levels < n <= parts**levels and parts ** (levels - 1) == blocks.top_step(n)
