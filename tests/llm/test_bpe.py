"""The tree encoder against the tiktoken library, and round trips."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from driftline.llm import bpe

PATH, PATTERN = bpe.vocabulary()


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Encoder(PATH, PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    yield from ("", " ", "\n\n x", "a" * 1000, "ab" * 333, "\x1c \x85　 é", "don't  stop\t\n", "𝕏🏳️‍🌈 日本語テキスト", "0" * 77)
    for _ in range(300):
        yield "".join(r.choice("abcdeinorst éñ.日1'\n") for _ in range(r.randrange(400)))
    for _ in range(200):
        yield "".join(r.choice("abcdeinorstuvéñöüaeioantheing") for _ in range(r.randrange(600)))
    for c in "aeo=-*.0 ":
        yield c * r.randrange(3000, 5000)


def test_as_tiktoken(both):
    own, lib = both
    for t in texts():
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_join_is_associative(both):
    own = both[0].bpe
    r = random.Random(6)
    for _ in range(200):
        s = bytes(r.choice(b"theingaouer") for _ in range(90))
        a, b, c = (own.tree(s[i : i + 30]) for i in (0, 30, 60))
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own.merged(s)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "a b", 7), (2, "", 7)], "doc_id long, text string, ids int")
    out = bpe.encode(df, PATH, PATTERN)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert sorted(bytes(r.data) for r in bpe.decode(out, PATH, PATTERN).collect()) == [b"", b"", b"", b"a b"]
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
