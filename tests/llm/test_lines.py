"""Line dedup against plain loops: single lines, and runs of several."""

import hashlib
import random

import pytest

import __spark_entry__ as E
from driftline.llm import linededup as L

ROWS = [(1, "a b\nsame line\nc"), (2, "d\nsame line\n\ne"), (3, "same line"), (4, "f\nf"), (5, None), (6, "")]


def test_single_lines(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in E.queries()["op7_single_lines"](spark, str(tmp_path)).collect()}
    seen, want = set(), {}
    for i, text in ROWS:
        held, rest, lines = 0, [], (text or "").split("\n")
        for line in lines:
            late = bool(line.strip()) and line in seen
            held += bool(line.strip())
            seen.add(line)
            rest += [] if late else [line]
        gone = len(lines) - len(rest)
        left = "" if gone and gone == held else "\n".join(rest)
        want[i] = (held, gone, hashlib.sha256(left.encode()).hexdigest())
    assert got == want
    assert {i: n for i, (_, n, _) in got.items()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def brute(rows, run):
    """Lines of later windows of `run` non-blank lines, by the contract's order; the numbers of removed lines of each document."""
    seen, gone = set(), {}
    for i, text in sorted(rows):
        lines = [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()]
        for s in range(len(lines) - run + 1):
            key = tuple(x for _, x in lines[s : s + run])
            if key in seen:
                gone.setdefault(i, set()).update(k for k, _ in lines[s : s + run])
            seen.add(key)
    return gone


def passages(n, seed=0):
    """Documents of own lines with passages of 3 to 9 lines that others hold too, and a line that stands in all."""
    r = random.Random(seed)
    shared = [[f"passage {p} line {k}" for k in range(r.randrange(3, 10))] for p in range(6)]
    rows = []
    for i in range(n):
        lines = [f"own {i} {k}" for k in range(r.randrange(12))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(lines) + 1)
            lines[at:at] = r.choice(shared)
        lines.insert(r.randrange(len(lines) + 1), "in all")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("run", [1, 2, 5])
def test_runs_of_any_length(spark, run):
    rows = passages(60, run)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in L.repeated_windows(docs, run=run).collect():
        got.setdefault(r["_id"], set()).update(r["_lines"])
    assert got == brute(rows, run) and got


def test_only_fingerprints_are_written_and_they_decide(spark):
    rows = passages(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = L.fingerprints(docs, run=5)
    windows = sum(max(0, len([x for x in t.split("\n") if x.strip()]) - 4) for _, t in rows)
    assert found.columns == ["_print", "_id", "_at"] and 0 < found.count() < 0.7 * windows
    places = L.matched(found)
    # documents without a shared fingerprint aren't looked at again, and without fingerprints nothing is found
    assert 0 < places.count() < len([1 for _, t in rows if len(t.split("\n")) >= 5])
    assert L.extended(docs, places.limit(0), run=5).count() == 0
    assert L.extended(docs, places, run=5).count() < windows
