"""Periodic runs against brute force on random, planted and hostile texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from driftline.llm import runs as R


def brute(w):
    """All runs: for each period the stretches in which words q apart are equal, smallest periods only."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def contract(i, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    found = brute(w)
    best = min(found, key=lambda r: (-(r[1] - r[0]), r[0], r[2])) if found else None
    gone = {x for s, e, q in found for x in range(s + q, e)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 30])
def test_equals_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = [rng.randrange(letters) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(4)):
            p = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (p * 9)[: rng.randrange(2 * len(p), 5 * len(p) + 1)]
        assert R.find(np.array(w, np.uint64)) == brute(w), w


def test_words_with_many_runs():
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    assert R.find(np.array(b, np.uint64)) == brute(b)
    thue = [bin(i).count("1") & 1 for i in range(400)]
    assert R.find(np.array(thue, np.uint64)) == brute(thue)


def test_query_on_hostile_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "x", "a b " * 6, "a b " * 5 + "a", "é ü z " * 8, "a\x0bb\x0c" * 9, "same " * 3000, " ".join(str(rng.randrange(4)) for _ in range(300))]
    texts += [" ".join(str(rng.randrange(9)) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, "own", 1) for i, t in enumerate(texts)] + [(4, texts[4], "own", 1), (None, "q r " * 9, "own", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op12_periodic_runs(spark, str(tmp_path)).collect()
    planted = sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    assert len(got) == len(rows) and planted > 20
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, 0, 18, 2)
        else:
            assert tuple(r)[1:] == contract(r["doc_id"], texts[r["doc_id"]]), r


def test_real_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = R.op12_periodic_runs(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        if len((texts[r["doc_id"]] or "").split()) < 700:
            assert tuple(r)[1:] == contract(r["doc_id"], texts[r["doc_id"]])


def test_a_very_long_periodic_text():
    w = np.tile(np.random.default_rng(0).integers(0, 500, 5000), 12).astype(np.uint64)
    assert R.find(w)[0] == (0, 60000, 5000)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert R.op12_periodic_runs(spark, str(tmp_path)).count() == 0
