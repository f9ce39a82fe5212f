"""The distributed sort against all 50-byte strings of small corpora."""

import hashlib
import random

from driftline.llm import suffixes as S


def brute(rows):
    names = [S.LAST if i is None else i for i, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    least = {}
    for d, b in zip(names, data):
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(d, least.get(s, d))
    out = []
    for (i, _), d, b in zip(rows, names, data):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        spans = [x for x in bytes(gone).split(b"\0") if x]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def own(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, body string").repartition(3)
    out = S.spans(df).selectExpr("coalesce(doc_id, -1)", "n_bytes", "aggregate(spans, 0L, (s, x) -> s + x.end - x.start)", "cast(size(spans) as long)", "sha2(kept, 256)")
    return sorted(tuple(r) for r in out.collect())


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\0 ") for _ in range(r.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(r.randrange(8, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passage)[r.randrange(9) :] if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(30))) for _ in range(r.randrange(6))]
        rows.append((r.choice([i, i, i, None, 7]), " ".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(4, None), (5, ""), (200, "a" * 300), (201, "a" * 49), (202, "a" * 77), (203, passage[0] * 30), rows[0], (300, "ab" * 40), (301, "b" + "ab" * 40)]
    return rows


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert own(spark, rows) == brute(rows)


def test_levels(spark, monkeypatch):
    """Bundles of bundles of blocks, as a corpus of many ranges has them."""
    monkeypatch.setattr(S.B, "FAN", 2)
    monkeypatch.setattr(S.B, "RANGE_BYTES", 600)
    monkeypatch.setattr(S, "BLOCK_BYTES", 900)
    monkeypatch.setattr(S.B.ranges, "__defaults__", (600,))
    rows = corpus(5)
    assert own(spark, rows) == brute(rows)


def test_even_ranges():
    """Anchors are the least hashes, but no range holds over 1.5 times the mean of their keys."""
    r = random.Random(9)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(200_000)).encode()
    gram = S.anchors(S.np.frombuffer(text, S.np.uint8), S.np.array([0, len(text)]))[4]
    held = S.np.bincount(S.B.range_of(gram >> S.np.uint64(16), 100, 48), minlength=100)
    assert len(gram) > 50_000 and held.max() < 1.5 * held.mean()


def test_empty_table(spark):
    assert own(spark, [(1, None)]) == brute([(1, None)])
    assert S.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree():
    r = random.Random(3)
    for n in (1, 2, 3, 7):
        lists = [sorted({bytes(r.choice(b"ab") for _ in range(5)) + b"x" * (S.KEY - 5) for _ in range(r.randrange(20))}) for _ in range(n)]
        lists = [x for x in lists if x] or [[b"q" * S.KEY]]
        runs = [S.Run(*S.front_coded(S.np.frombuffer(b"".join(x), S.np.uint8).reshape(-1, S.KEY)), S.np.zeros(len(x), S.np.int64)) for x in lists]
        got, last = [], b""
        for key, h, _, _ in S.merged(runs):
            if got:
                common = next((i for i in range(S.KEY) if key[i] != last[i]), S.KEY)
                assert h == common
            got.append(key)
            last = key
        assert got == sorted(k for x in lists for k in x)
