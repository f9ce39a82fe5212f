"""Proximity matches against brute force."""

import random

from driftline.llm import decontaminate as D


def brute(docs, items, slop, window):
    out = set()
    for name, text in items:
        t = text.split()
        for i in range(max(1, len(t) - window + 1)):
            w = t[i : i + window]
            for d, body in docs:
                b = body.split()
                for s in range(max(0, len(b) - len(w)) + 1):
                    if set(w) <= set(b[max(0, s - slop) : s + len(w) + slop]):
                        out.add((d, s, name))
    return out


def found(spark, docs, items, slop, window):
    got = D.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), slop, window=window)
    return {(r.doc_id, r.start, i) for r in got.collect() for i in r["items"]}


def test_rarest_word_moved_to_the_end(spark):
    ten = [f"w{i}" for i in range(10)]
    docs = [(1, " ".join(ten[1:] + ten[:1])), (2, " ".join(["x"] * 5 + ten[::-1])), (3, " ".join(["w1", "w2"] * 4)), (4, " ".join(ten[:9]))]
    assert found(spark, docs, [("a", " ".join(ten))], 0, 10) == {(1, 0, "a"), (2, 5, "a")}


def test_brute_force(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.randrange(1, 25)))) for i in range(60)]
    items = [(f"i{i}", " ".join(r.choices("abcdefgh", k=r.choice((2, 4, 6, 9))))) for i in range(6)]
    for slop in (0, 1, 3):
        want = brute(docs, items, slop, 4)
        assert want and found(spark, docs, items, slop, 4) == want
