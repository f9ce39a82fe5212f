"""DivideSkip and its classes against all pairs."""

import random

import numpy as np

from driftline.llm import jaccard as J


def brute(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(a, sets[j]))
            if 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_classes():
    r = random.Random(1)
    for seed in range(60):
        sets = []
        for _ in range(r.randrange(1, 8)):
            base = [r.randrange(1 << 40) for _ in range(r.randrange(1, 40))]
            if r.random() < 0.5 and sets:
                base += sets[-1].tolist()[: r.randrange(1, 30)]
            for _ in range(r.choice([1, 3, 30])):
                s = [x for x in base if r.random() > 0.08] + [r.randrange(1 << 40) for _ in range(r.randrange(4))]
                sets.append(np.unique(np.array(s or [1], np.uint64)))
        r.shuffle(sets)
        groups = {}
        for i, c in enumerate(J.classes(sets)):
            groups.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == brute(sets), seed


def test_search():
    r = random.Random(2)
    for _ in range(200):
        index, sets = J.Index(), [sorted(r.sample(range(40), r.randrange(1, 30))) for _ in range(20)]
        for i, s in enumerate(sets):
            index.add(i, s)
        q = sorted(r.sample(range(40), r.randrange(1, 30)))
        for t in (1, 2, len(q) // 2 + 1, len(q)):
            want = [(i, o) for i, s in enumerate(sets) if (o := len(set(s) & set(q))) >= t]
            assert list(index.search(q, t)) == want


def test_search_rising():
    """A threshold that rises with the id, from some id on."""
    r = random.Random(4)
    for _ in range(200):
        index, sets = J.Index(), sorted((sorted(r.sample(range(40), r.randrange(1, 30))) for _ in range(20)), key=len)
        for i, s in enumerate(sets):
            index.add(i, s)
        q = sorted(r.sample(range(40), r.randrange(1, 30)))
        lo = r.randrange(21)
        rising = lambda i: -(-3 * (len(q) + len(sets[i])) // 7)  # noqa: E731, B023
        want = [(i, o) for i, s in enumerate(sets) if i >= lo and (o := len(set(s) & set(q))) >= rising(i)]
        assert list(index.search(q, 1, rising, lo)) == want


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (3, long.upper()), (9, long + " x"), (None, long), (1, None), (2, ""), (4, " \n"), (7, "a b"), (8, "A  b"), (7, "a b"), (11, "other words are here today now")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, id int")
    got = {(r.doc_id, r.component_id) for r in J.link(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, 3), (1, 1), (2, 2), (4, 4), (7, 7), (8, 7), (11, 11)}
    assert J.link(df).count() == len(rows)
    assert J.link(df.limit(0)).count() == 0


def test_parts(spark, monkeypatch):
    """A component dealt to pairs of parts gives the same classes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, J.link(docs).collect()))
    monkeypatch.setattr(J, "GROUP_BYTES", 1200)
    assert sorted(map(tuple, J.link(docs).collect())) == whole
    assert any(c != d for d, _, c in whole)


def test_classes_without_single_tokens():
    """Sizes stand for tokens left out, and the order of tokens does not matter."""
    r = random.Random(3)
    for seed in range(40):
        base = [r.randrange(1 << 40) for _ in range(r.randrange(4, 40))]
        sets = [np.unique(np.array([x for x in base if r.random() > 0.1] + [r.randrange(1 << 40) for _ in range(r.randrange(6))], np.uint64)) for _ in range(25)]
        count = {}
        for s in sets:
            for x in s.tolist():
                count[x] = count.get(x, 0) + 1
        kept = [np.array(sorted((x for x in s.tolist() if count[x] > 1), key=lambda x: (count[x], x)), np.uint64) for s in sets]
        groups = {}
        for i, c in enumerate(J.classes(kept, count=[len(s) for s in sets])):
            groups.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == brute(sets), seed


def test_spread():
    a, b = J.spread([np.array([1, 5], np.uint64), np.array([5, 9], np.uint64)], [np.array([1, 2], np.uint8), np.array([1, 1], np.uint8)])
    assert a[0] == b[1] == 0 and a[1] == b[0] > 0
