"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon in plain and in
normalised words (look-alike digits and signs read as letters, signs inside words
dropped), what only the normalised words show, second-person words and how near they
are to lexicon words, capitals, punctuation, obfuscation and length rates.  The text is
all that a score is made from.

Training uses at most SAMPLE labelled rows (the least by a hash of the id), never those
with crc32(id) mod 4 = 2.  They fall in FOLDS folds by hash and are cross-fitted: a row's
features for training use the lexicon of the other folds, and its raw score for the
calibration comes from trees of the other folds, so that no row is judged on what it
has taught and all rows teach the lexicon, the trees and the calibration.

Defined cases: null and empty texts have features of zero and get a score like any
other; a very long text is read whole; rows with one id share its label, the largest if
there are several, and of its texts the least in order teaches; a null id has no label and
isn't held out; without labels in two folds every score is 0; an empty table gives no
rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table, written

#: At most so many labelled rows train the model.
SAMPLE = 24_000
FOLDS = 3
#: At most so many learned words, each in so many toxic texts.
LEARNED, LEAST_TEXTS = 400, 4
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.1, 32, 5

#: Common insults, and second-person words.
INSULTS = "idiot moron stupid scum clown pathetic worthless trash garbage loser dumb disgusting filth vermin imbecile fool hate ugly pig crap bastard idiote imbecile debile abruti ordure dumm depp trottel abschaum estupido imbecil basura escoria tonto".split()
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tus vosotros".split()

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[65:91] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
SIGNS = np.zeros(256, bool)
SIGNS[33:48] = SIGNS[58:65] = SIGNS[91:97] = SIGNS[123:127] = True
#: Signs and digits that stand for letters.
LOOKS = np.arange(256, dtype=np.uint8)
for _a, _b in zip("0134578@$!|", "oieastbasii"):
    LOOKS[ord(_a)] = ord(_b)
LOOKS[65:91] = LOOKS[97:123]

FEATURES = 20
NEAR, FAR = 5, 20


def word_hashes(words: list[str]) -> np.ndarray:
    buf, off = K.texts(pa.array(words))
    return np.sort(K.span_hash(K.prefix(buf, K.FOLDED), off[:-1], off[1:]))


#: Learned lexicon entries are words, or beginnings of words of so many bytes.
STEMS = (4, 6, 8)


def units(pre: np.ndarray, st: np.ndarray, en: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, hashes): whole words, and beginnings of longer ones."""
    out = [(np.arange(len(h)), h)]
    for n in STEMS:
        i = np.flatnonzero(en - st > n)
        out.append((i, K.span_hash(pre, st[i], st[i] + n) ^ K.COEF[n]))
    return out


def weigh(parts: list[tuple[np.ndarray, np.ndarray]], n: int, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The largest learned weight of each word's units, 0 without any."""
    out = np.zeros(n)
    if len(learned):
        for i, h in parts:
            at = member(h, learned)
            hit = at >= 0
            out[i[hit]] = np.maximum(out[i[hit]], weights[at[hit]])
    return out


def plain(part: np.ndarray, o: np.ndarray):
    st, en, wo = K.words(part, o, K.ALNUM)
    pre = K.prefix(part, K.FOLDED)
    h = K.span_hash(pre, st, en)
    return h, st, en, wo, units(pre, st, en, h)


def normalised(part: np.ndarray, o: np.ndarray):
    """Word hashes and offsets after look-alikes are read as letters and other signs are dropped."""
    table_ = LOOKS[part]
    keep = ~SIGNS[table_]
    places = np.concatenate(([0], np.cumsum(keep)))
    buf, off = table_[keep], places[o]
    st, en, wo = K.words(buf, off, K.SPACED)
    pre = K.prefix(buf, K.FOLDED)
    h = K.span_hash(pre, st, en)
    return h, wo, units(pre, st, en, h)


def member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions in the sorted table `of`, or -1."""
    if not len(of):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(of, h), len(of) - 1)
    return np.where(of[at] == h, at, -1)


_FIXED, _SECOND = word_hashes(INSULTS), word_hashes(SECOND)


def features(column: pa.Array, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    buf, off = K.texts(column)
    out = np.zeros((len(off) - 1, FEATURES))
    for a, b in K.pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        h, st, en, wo, hu = plain(part, o)
        g, go, gu = normalised(part, o)
        per = lambda x, at: np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=float)))[at])
        words, size = np.maximum(1, np.diff(wo)), np.maximum(1, np.diff(o))
        gwords = np.maximum(1, np.diff(go))
        fixed, nfixed = member(h, _FIXED) >= 0, member(g, _FIXED) >= 0
        w, nw = weigh(hu, len(h), learned, weights), weigh(gu, len(g), learned, weights)
        bad = fixed | (w > 0)
        second = member(h, _SECOND) >= 0
        # distance in words from each bad word to the next second-person word of its text
        near = np.full(len(h), FAR)
        mine = np.flatnonzero(second)
        if len(mine) and bad.any():
            text = np.searchsorted(wo, np.arange(len(h)), "right") - 1
            i = np.flatnonzero(bad)
            at = np.searchsorted(mine, i)
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(mine) - 1)):
                j = mine[side]
                near[i] = np.where(text[j] == text[i], np.minimum(near[i], np.abs(j - i)), near[i])
        caps = np.concatenate(([0], np.cumsum(CAPITALS[part])))
        digs = np.concatenate(([0], np.cumsum(DIGITS[part])))
        shout = (caps[en] - caps[st] == en - st) & (en - st > 1)
        mixed = (digs[en] > digs[st]) & (digs[en] - digs[st] < en - st)
        inner = SIGNS[part]
        inner[1:-1] &= LETTERS[part[:-2]] & LETTERS[part[2:]] if len(part) > 2 else False
        run = np.zeros(len(part), bool)
        run[2:] = (part[2:] == part[1:-1]) & (part[2:] == part[:-2]) & LETTERS[part[2:]]
        hits, nhits = per(fixed, wo), per(nfixed, go)
        f = out[a:b]
        f[:, 0], f[:, 1] = hits / words, np.log1p(hits)
        f[:, 2], f[:, 3] = nhits / gwords, np.log1p(nhits)
        f[:, 4], f[:, 5] = per(w, wo) / words, np.log1p(per(w, wo))
        f[:, 6], f[:, 7] = per(nw, go) / gwords, np.log1p(per(nw, go))
        f[:, 8] = np.maximum(0, nhits + per(nw > 0, go) - hits - per(w > 0, wo))
        f[:, 9] = per(second, wo) / words
        f[:, 10] = per(near <= NEAR, wo)
        f[:, 11] = per(np.where(bad, 1.0 / (1 + near), 0), wo) / words
        f[:, 12] = per(CAPITALS[part], o) / size
        f[:, 13] = per(shout, wo) / words
        f[:, 14] = per(part == 33, o) / size
        f[:, 15] = per(SIGNS[part], o) / size
        f[:, 16] = per(inner, o) / size
        f[:, 17] = per(mixed, wo) / words
        f[:, 18] = per(run, o) / size
        f[:, 19] = np.log1p(np.diff(wo))
    return out


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of fixed depth on binned features, logistic loss: {base, edges, trees}."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), int)
        splits = []
        for depth in range(DEPTH):
            level = []
            for k in range(1 << depth):
                rows = node == k
                best, pick = 1e-9, (0, 1 << 30)
                if rows.sum() >= 2 * LEAST_LEAF:
                    total_g, total_h = g[rows].sum(), hess[rows].sum()
                    for c in range(x.shape[1]):
                        bc = binned[rows, c]
                        n = len(edges[c]) + 1
                        gs, hs, ns = (np.cumsum(np.bincount(bc, v, n))[:-1] for v in (g[rows], hess[rows], None))
                        ok = (ns >= LEAST_LEAF) & (rows.sum() - ns >= LEAST_LEAF)
                        if ok.any():
                            gain = np.where(ok, gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1), -1)
                            if gain.max() > best:
                                best, pick = gain.max(), (c, int(gain.argmax()))
                level.append(pick)
            splits.append(level)
            right = binned[np.arange(len(node)), np.array([c for c, _ in level])[node]] > np.array([s for _, s in level])[node]
            node = 2 * node + right
        leaf = np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + 1) * RATE
        raw += leaf[node]
        trees.append((splits, leaf))
    return {"base": base, "edges": edges, "trees": trees}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(model["edges"], x.T)], 1)
    raw, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for level in splits:
            node = 2 * node + (binned[rows, np.array([c for c, _ in level])[node]] > np.array([s for _, s in level])[node])
        raw += leaf[node]
    return raw


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve from raw scores to probabilities."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # mean, weight, lowest and highest score
    for s, v in zip(score[order], y[order]):
        pools.append([float(v), 1.0, s, s])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, w, _, hi = pools.pop()
            q = pools[-1]
            q[0], q[1], q[3] = (q[0] * q[1] + m * w) / (q[1] + w), q[1] + w, hi
    return np.array([x for p in pools for x in p[2:]]), np.array([p[0] for p in pools for _ in (0, 1)])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model, from at most `sample` labelled rows that aren't held out; None without any."""
    of = F.xxhash64("doc_id")
    rows = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = written(rows.orderBy(of, "doc_id").limit(sample).select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")))
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    texts = written(texts.select("text", "toxic", "fold"))

    def count(batches):
        for batch in batches:
            toxic, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "fold"))
            buf, off = K.texts(batch.column("text"))
            for a, b in K.pieces(off):
                _, go, parts = normalised(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                cut = [np.searchsorted(i, go) for i, _ in parts]
                uniq = [np.unique(np.concatenate([h[c[d] : c[d + 1]] for (_, h), c in zip(parts, cut)])) for d in range(b - a)]
                each = np.concatenate(uniq)
                many = [len(u) for u in uniq]
                for f in range(FOLDS):
                    mine = np.repeat(fold[a:b] == f, many)
                    h, inv = np.unique(each[mine], return_inverse=True)
                    n, t = np.bincount(inv, minlength=len(h)), np.bincount(inv, np.repeat(toxic[a:b], many)[mine], len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), f, np.int32)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], names=["word", "fold", "n", "t"])

    sizes = {r.fold: (r.n, r.t) for r in texts.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    if len(sizes) < 2:
        return None
    by = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in "nt"]
    found = texts.mapInArrow(count, "word long, fold int, n long, t long").groupBy("word").agg(*by)
    found = written(found.where(sum((F.col(f"t{f}") for f in range(FOLDS)), F.lit(0)) >= LEAST_TEXTS))

    def lexicon(folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Words and weights learned from these folds: those that their toxic texts have clearly more often."""
        size, bad = (sum(sizes.get(f, (0, 0))[i] for f in folds) for i in (0, 1))
        n, t = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in "nt")
        odds = F.log((t + 0.5) / (bad + 1.0)) - F.log((n - t + 0.5) / (max(1, size - bad) + 1.0))
        z = odds / F.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5))
        top = found.where(t >= LEAST_TEXTS).select("word", odds.alias("odds"), z.alias("z")).where("z > 3.5 and odds > 1").orderBy(F.desc("z"), "word").limit(LEARNED).collect()
        h, w = np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.odds for r in top], float)
        order = np.argsort(h)
        return h[order], w[order]

    every = list(range(FOLDS))
    others = [lexicon([g for g in every if g != f]) for f in every]

    def feature_rows(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, FEATURES))
            for f in np.unique(fold):
                mine = fold == f
                x[mine] = features(batch.column("text").filter(pa.array(mine)), *others[f])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold")], names=["x", "toxic", "fold"])

    got = texts.mapInArrow(feature_rows, "x array<double>, toxic int, fold int").toPandas()
    x, y, fold = np.stack(got["x"].to_list()), got["toxic"].to_numpy(float), got["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in sizes:
        raw[fold == f] = raw_scores(boost(x[fold != f], y[fold != f]), x[fold == f])
    learned, weights = lexicon(every)
    return boost(x, y) | {"curve": isotonic(raw, y), "learned": learned, "weights": weights}


def score(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each whole text."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            p = np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                p = np.interp(raw_scores(model, features(batch.column("text"), model["learned"], model["weights"])), *model["curve"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
