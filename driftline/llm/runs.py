"""Periodic runs of words by a suffix automaton with small-to-large merging of end positions.

A run is a stretch of consecutive words with smallest period q and length >= max(12, 2*q)
that no neighbouring word extends keeping period q.

1. Words become numbers, document by document.  A run of 12 words or more, and of two periods
   or more, is covered by six-word windows that occur again in it, one period on.  So words
   that no such window covers are in no run; what is left falls into stretches, and all runs
   of a text lie within its stretches.  (Windows are compared by 64-bit hashes: equal windows
   have equal hashes, so that a clash of hashes could only leave more words in.)
2. Of each stretch a suffix automaton is built.  Along its suffix links, from the longest
   states up, each state's ordered set of end positions is merged, the smaller set into the
   larger.  Where two positions become neighbours in a state of length l at a distance d <= l,
   the l + d words up to the later one have period d: they hold a square.
3. Such a seed starts where its run starts, since l is the longest common suffix of the two
   prefixes; to the right it is extended word by word.  Of equal stretches the least period is
   kept.  Every run has a seed with its smallest period: the two ends at which its longest
   border's occurrences end are neighbours in the state where they meet.

Texts are rows and stay where they are: nothing is shuffled.  A text is one task's work, of
some 1 KB of memory a word in the stretches and n log n set operations.

Defined cases: a null or empty text, and one without words, has no words and no runs; words
are separated by \\x20 and \\x09-\\x0D only and compared by their bytes; very long texts are
taken whole; repeated rows are judged each by itself; a null id stays null; an empty table
gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The shortest run, and the words of the windows that must occur again in one.
SHORTEST, WINDOW = 12, 6
#: Bytes of text that are held as rows of results before they are passed on.
HELD = 4 << 20


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text that can hold runs: (first word, end) of each."""
    n = len(ids)
    if n < SHORTEST:
        return []
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    # windows that touch or overlap cover one stretch
    new = np.flatnonzero(np.diff(at) > WINDOW) + 1
    first, last = at[np.concatenate(([0], new))], at[np.concatenate((new - 1, [len(at) - 1]))] + WINDOW
    return [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= SHORTEST]


def automaton(w: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of each state, and the state of each prefix; state 0 is the root."""
    link, length, move, ends = [-1], [0], [{}], []
    last = 0
    for c in w:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        move.append({})
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                move.append(move[q].copy())
                link[q] = link[new] = copy
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
        ends.append(new)
        last = new
    return link, length, ends


def seeds(w: list[int]) -> dict[tuple[int, int], int]:
    """(period, first word) of each repetition that a new pair of neighbours shows, with the later end position."""
    link, length, ends = automaton(w)
    held: list[list[int] | None] = [None] * len(link)
    for i, s in enumerate(ends):
        held[s] = [i]
    found: dict[tuple[int, int], int] = {}
    # states by falling length: children before their parents
    order = np.argsort(-np.array(length), kind="stable").tolist()
    for s in order:
        p = link[s]
        if p <= 0:
            held[s] = None
            continue
        small, large, l = held[s], held[p], length[p]
        held[s] = None
        if large is None:
            held[p] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        # new neighbours are one of each set: two of one set have met in a longer state
        n = len(large)
        places = [bisect_left(large, e) for e in small]
        for k, (e, i) in enumerate(zip(small, places)):
            if i and (k == 0 or places[k - 1] < i):
                d = e - large[i - 1]
                if d <= l and found.get(at := (d, e - d - l + 1), -1) < e:
                    found[at] = e
            if i < n and (k + 1 == len(places) or places[k + 1] > i):
                d = large[i] - e
                if d <= l and found.get(at := (d, e - l + 1), -1) < e + d:
                    found[at] = e + d
        if len(small) * 8 > n:
            large += small
            large.sort()
        else:
            for e, i in zip(reversed(small), reversed(places)):
                large.insert(i, e)
        held[p] = large
    return found


def find(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end, period) of each run, in order of first word, then period."""
    out = []
    for a, b in stretches(ids):
        w = np.unique(ids[a:b], return_inverse=True)[1].tolist()
        n, least = len(w), {}
        for (d, s), e in seeds(w).items():
            e += 1
            while e < n and w[e] == w[e - d]:
                e += 1
            if e - s >= max(SHORTEST, 2 * d):
                least[s, e] = min(d, least.get((s, e), d))
        out += [(a + s, a + e, d) for (s, e), d in least.items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list) -> np.ndarray:
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", replay: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>>, collapsed (the words that stay, joined by spaces).

    A word goes if a run contains it after that run's first period.  replay(id, words), if given,
    puts other words in their place first.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    of_run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds, names = [pa.int64(), of_run, pa.string()], ["doc_id", "n_words", "runs", "collapsed"]

    def one(name, value: str):
        words = value.encode().split()
        if replay:
            words = replay(name, words)
        found = find(numbered(words)) if len(words) >= SHORTEST else []
        n = len(words)
        if found:
            edge = np.zeros(n + 1, np.int64)
            for s, e, q in found:
                edge[s + q] += 1
                edge[e] -= 1
            words = [w for w, gone in zip(words, np.cumsum(edge).tolist()) if not gone]
        return n, [{"start": s, "length": e - s, "period": q} for s, e, q in found], b" ".join(words).decode()

    def run(batches):
        for batch in batches:
            rows, first, held = [], 0, 0
            for at, (name, value) in enumerate(zip(batch.column("doc_id"), batch.column("text")), 1):
                rows.append(one(name.as_py(), value.as_py()))
                held += len(rows[-1][2]) + 64 * len(rows[-1][1])
                if held >= HELD or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
                    rows, first, held = [], at, 0

    return src.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def replayed(name, words: list) -> list:
    """op12's texts: where crc32(id) ends in 0, words from a = g % n on repeat those from a on with period p."""
    h = zlib.crc32(str(name).encode()) if name is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs(table(spark, sf_dir, "documents"), replay=replayed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
