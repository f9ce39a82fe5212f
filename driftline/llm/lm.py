"""Corpus language model: stupid-backoff scores computed relationally.

The n-gram counts of all documents are a table partitioned by the n-gram's hash; each
block of documents is joined to the counts of its own exploded n-grams, and the log
scores are summed per document.  With counts c and corpus size N, the score of a word w
after u v is c(uvw)/c(uv) if c(uvw) >= MIN_COUNT, else ALPHA * c(vw)/c(v) if c(vw) >=
MIN_COUNT, else ALPHA**2 * c(w)/N; a document's first words begin at the lower orders.
An n-gram seen once is in no other text, so MIN_COUNT is 2; 1 is the plain backoff.

A row for each n-gram would take many times the corpus's size on disk, so the rows of
the table and of the join are packed runs (`blocks`), in two rounds.  In the first one
short keys tell which n-grams can't occur twice; a chance collision only lets an n-gram
through to the second, which counts by all 64 bits of the hash.  An n-gram that is left
out has the count 1.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  Counts cover whole texts of all
documents.  The number of n-grams a hash range receives from a block is the block's
distinct n-grams: frequent ones take one entry.

Defined cases: null and texts without words get n_words 0 and a null score; repeated
rows count twice; very long texts are taken whole; an empty table gives no rows; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .common import table, written

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
RANGE_BYTES = 12 << 20
#: Bits beyond those that number the corpus's bytes, of the keys that tell which n-grams occur once.
FILTER_BITS = 6


def grams(texts, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order 1..n its gram hashes and their texts' offsets; and the numbers of words."""
    buf, off = K.texts(texts)
    out = [([], [np.zeros(1, np.int64)]) for _ in range(order)]
    words, base = [], [0] * order
    for a, b in K.pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        st, en, wo = K.words(part, o, K.SPACED)
        h = K.span_hash(K.prefix(part, K.FOLDED), st, en)
        words.append(np.diff(wo))
        for k in range(order):
            at, so = K.window_starts(wo, k + 1)
            out[k][0].append(K.gram_hash(h, at, k + 1))
            out[k][1].append(so[1:] + base[k])
            base[k] += int(so[-1])
    none = np.zeros(0, np.uint64)
    return [(np.concatenate(x) if x else none, np.concatenate(y)) for x, y in out], np.concatenate(words) if words else np.zeros(0, np.int64)


def _first(s: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return new


def _table(found) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and their counts."""
    s = np.sort(np.concatenate([h for h, _ in found]))
    start = np.flatnonzero(_first(s))
    return s[start], np.diff(np.append(start, len(s)))


def _total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, of = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(of, counts, len(uniq)).astype(np.int64)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """The corpus counts of each run's keys."""
    uniq, total = _total(np.concatenate(keys), np.concatenate(counts))
    return [total[np.searchsorted(uniq, k)] for k in keys]


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score (null without words)."""
    packed = B.pack(docs, doc_id, text)
    units, size = B.totals(packed)
    n, bits = B.ranges(size, RANGE_BYTES), min(64, max(32, size.bit_length() + FILTER_BITS))
    cut, step = np.uint64(64 - bits), B.top_step(n)
    places, counts = B.Keys(n, bits, bool, bool, B.any_of, B.in_several), B.Keys(n, 64, np.int64, np.int64, _total, _totals)

    def places_of(ids, null, texts):
        keys, c = _table(grams(texts, order)[0])
        short = keys >> cut
        start = np.flatnonzero(_first(short))
        return short[start], (np.add.reduceat(c, start) > 1) if len(start) else np.zeros(0, bool)

    shared = written(B.answer(B.send(packed, places, places_of), places, units), "none")

    def often(keys, hit):
        """Which of the block's sorted keys may be in the corpus more than once."""
        return hit[np.cumsum(_first(keys >> cut)) - 1] if len(keys) else np.zeros(0, bool)

    def emit(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        keys, c = _table(grams(B.unpack(b["body"].iloc[0])[2], order)[0])
        use = often(keys, B.in_order(a, bool))
        return pd.DataFrame([(b["block"].iloc[0], part, run) for part, run in counts.split(keys[use], c[use], step)], columns=["unit", "part", "run"])

    runs = packed.select("block", "body").groupBy("block").cogroup(shared.groupBy("unit")).applyInPandas(emit, B.RUNS)
    tagged = shared.withColumn("kind", F.lit(0)).union(B.answer(runs, counts, units).withColumn("kind", F.lit(1)))
    corpus = _corpus_words(packed)

    def use(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        ids, null, texts = B.unpack(b["body"].iloc[0])
        found, words = grams(texts, order)
        every = np.concatenate([h for h, _ in found])
        at = np.argsort(every)
        new = _first(every[at])
        keys = every[at[new]]
        total = np.ones(len(keys), np.int64)
        total[often(keys, B.in_order(a[a["kind"] == 0], bool))] = B.in_order(a[a["kind"] == 1], np.int64)
        # the corpus count of each n-gram of the block, in the texts' order
        c = np.empty(len(every), np.int64)
        c[at] = total[np.cumsum(new) - 1]
        c = np.split(c, np.cumsum([len(h) for h, _ in found])[:-1])
        # score of the last word of each gram by the grams of its order or less
        whole = np.log(np.maximum(c[0], 1)) - np.log(max(corpus, 1))
        starts = found[0][1][:-1]
        for k in range(1, order):
            h, so = found[k]
            count = np.diff(so)
            # the index of the word that ends each gram, and of the gram before it
            end = np.arange(len(h)) + np.repeat(starts - so[:-1], count) + k
            prev = np.arange(len(h)) + np.repeat(found[k - 1][1][:-1] - so[:-1], count)
            hit = c[k] >= min_count
            whole[end] = np.where(hit, np.log(np.maximum(c[k], 1)) - np.log(np.maximum(c[k - 1][prev], 1)), np.log(alpha) + whole[end])
        total_of = np.array([whole[x:y].sum() for x, y in zip(starts, found[0][1][1:])], float)
        mean = np.divide(total_of, words, out=np.full(len(words), np.nan), where=words > 0)
        return pd.DataFrame({"doc_id": B.joined(ids, null), "n_words": words, "log_score": total_of, "mean_log_score": mean})

    out = packed.select("block", "body").groupBy("block").cogroup(tagged.groupBy("unit")).applyInPandas(use, "doc_id long, n_words long, log_score double, mean_log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("mean_log_score")))


def _corpus_words(packed: DataFrame) -> int:
    """N: a sum of one number for each block."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for body in batch.column("body"):
                buf, off = K.texts(B.unpack(body.as_buffer())[2])
                yield pa.RecordBatch.from_pydict({"words": pa.array([sum(len(K.words(buf[off[a] : off[b]], off[a : b + 1] - off[a], K.SPACED)[0]) for a, b in K.pieces(off))], pa.int64())})

    return packed.select("body").mapInArrow(run, "words long").agg(F.sum("words")).first()[0] or 0


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


SQL = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, w, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT g.doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n / cuv.n)
  WHEN c2.n >= 2 THEN ln(c2.n / cv.n) + (CASE WHEN g.u IS NOT NULL THEN ln(0.4) ELSE 0 END)
  ELSE ln(c1.n / (SELECT count(*) FROM w)) + (CASE WHEN g.u IS NOT NULL THEN ln(0.4) ELSE 0 END) + (CASE WHEN g.v IS NOT NULL THEN ln(0.4) ELSE 0 END) END AS s
  FROM g JOIN c1 USING (w) LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN c1 AS cv ON g.v = cv.w
  LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w LEFT JOIN c2 AS cuv ON g.u = cuv.v AND g.v = cuv.w),
t AS (SELECT doc_id, count(*) AS n, avg(s) AS m FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(m, 6) AS mean_log_score FROM documents d LEFT JOIN t USING (doc_id)
"""
