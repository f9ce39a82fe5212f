"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the classes it links.

A text's set is its distinct 5-word shingles (fewer words: the whole sequence as one).
Sets link when intersection / union >= 75 / 100; the result is the connected classes.

1. Equal sets are one node.  Blocks exchange their distinct shingles and learn how frequent
   each is; a text that shares less than three quarters of its shingles with others has no
   link and is done.  Of the others, shingles that no other set has are left out of the
   lists (the size keeps them), and the rest is ordered by frequency, rarest first.
2. Each set's rarest len - ceil(0.75 len) + 1 shingles are joined: sets that link share at
   least one of these.  The components of that graph hold all links, and a passage that
   many different documents share does not join them.
3. In each component, sets are taken by size and searched in an inverted index of the
   classes found so far: with T the least overlap, the longest lists are put aside, the
   short ones are merged with a heap that skips ahead, and candidates are probed in the
   long ones by binary search.  As ids follow sizes, T grows with the candidates' size.
   A class is left at its first link, so a group of thousands of near copies costs each
   member about one search.  Components of more than GROUP_BYTES are dealt to pairs of
   parts, so that a task's memory is bounded.

Defined cases: null and empty texts, and texts without words, have empty sets and are
their own classes; repeated rows are copies; a null id never is a class's id unless it
is alone; a very long text is taken whole, and its set is sent in pieces as any other's; an
empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .common import small, table, written

SHINGLE, PERCENT = 5, 75
#: A component of sets beyond this is dealt to several tasks; its inverted lists take some five times as much.
GROUP_BYTES = 32 << 20
#: DivideSkip's weight of a binary probe against a step of the merge.
PROBE = 0.0085
#: Bytes of text in a block: all its sets are held at once.
BLOCK_BYTES = 4 << 20
#: Classes from this size on have an index of their own.
LARGE = 16


def least(n: int, percent: int = PERCENT) -> int:
    """Least overlap with a set of n of any set that links with it."""
    return -(-percent * n // 100)


class Index:
    """Inverted lists of sets, ids ascending."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.ids: list[int] = []

    def add(self, i: int, tokens: list[int]) -> None:
        """Adds a set with the largest id so far."""
        self.ids.append(i)
        for t in tokens:
            self.lists.setdefault(t, []).append(i)

    def insert(self, i: int, tokens: list[int]) -> None:
        insort(self.ids, i)
        for t in tokens:
            insort(self.lists.setdefault(t, []), i)

    def remove(self, i: int, tokens: list[int]) -> None:
        del self.ids[bisect_left(self.ids, i)]
        for t in tokens:
            l = self.lists[t]
            if len(l) == 1:
                del self.lists[t]
            else:
                del l[bisect_left(l, i)]

    def take(self, other: Index) -> None:
        self.ids = list(heapq.merge(self.ids, other.ids))
        for t, l in other.lists.items():
            own = self.lists.get(t)
            self.lists[t] = list(heapq.merge(own, l)) if own else l

    def search(self, tokens: list[int], t: int, rising: Callable[[int], int] | None = None, lo: int = 0):
        """(id, overlap) of sets, from id lo on, that share at least t tokens, by DivideSkip.

        rising(id), if given, is the least overlap with that set; it doesn't fall as ids
        grow, so the threshold rises while the merge goes on.
        """
        start = bisect_left(self.ids, lo)
        if start == len(self.ids):
            return
        if rising:
            t = rising(self.ids[start])
        lists = [l for x in tokens if (l := self.lists.get(x)) and l[-1] >= lo]
        if len(lists) < t:
            return
        lists.sort(key=len)
        aside = min(t - 1, int(t / (PROBE * log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        heap = [(l[at], k, at) for k, l in enumerate(short) if (at := bisect_left(l, lo)) < len(l)]
        heapq.heapify(heap)
        while heap:
            top, same = heap[0][0], []
            if rising:
                t = rising(top)
            need = t - aside
            if len(heap) < need:
                return
            while heap and heap[0][0] == top:
                same.append(heapq.heappop(heap))
            if len(same) >= need:
                o = len(same)
                for rest, l in zip(range(len(long) - 1, -1, -1), long):
                    if o + rest + 1 < t:
                        break
                    at = bisect_left(l, top)
                    o += at < len(l) and l[at] == top
                if o >= t:
                    yield top, o
                to = top + 1
            else:
                # fewer heads than needed: the next candidate is not below the need-th head
                while len(same) < need - 1:
                    same.append(heapq.heappop(heap))
                to = heap[0][0]
            for _, k, at in same:
                l = short[k]
                at = bisect_left(l, to, at)
                if at < len(l):
                    heapq.heappush(heap, (l[at], k, at))


def compact(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with small numbers for tokens, without those that one set alone has; each set's order stays."""
    if not sets:
        return []
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1).astype(np.int32)[of]
    ends = np.cumsum([len(s) for s in sets])
    return [x[x >= 0] for x in np.split(number, ends[:-1])]


def classes(sets: list[np.ndarray], percent: int = PERCENT, count: list[int] | None = None) -> list[int]:
    """For each set the position of a set that stands for its class.

    `count` gives the sets' sizes, if tokens that no other set has are left out of them.
    Sets of classes under LARGE share one index; a larger class has its own, which is left at the first link.
    """
    count = [len(s) for s in sets] if count is None else count
    sets = compact(sets)
    order = sorted(range(len(sets)), key=lambda i: count[i])
    sizes = [count[i] for i in order]
    members: dict[int, list[int]] = {}
    of = list(range(len(sets)))  # class of each, by rank in size
    rest, large = Index(), {}
    for at, i in enumerate(order):
        tokens = sets[i].tolist()
        n, t = sizes[at], least(sizes[at], percent)
        if len(tokens) < t:
            continue
        # the least overlap at which sets of n and of sizes[j] link
        rising = lambda j: -(-percent * (n + sizes[j]) // (100 + percent))  # noqa: E731, B023
        lo = bisect_left(sizes, t)
        linked = set()
        for c, index in large.items():
            if 100 * sizes[index.ids[-1]] >= percent * n and any(x in index.lists for x in tokens[: len(tokens) - t + 1]):
                if next(index.search(tokens, t, rising, lo), None) is not None:
                    linked.add(c)
        linked.update(of[j] for j, _ in rest.search(tokens, t, rising, lo))
        name = max(linked, key=lambda c: len(members[c]), default=at)
        own = members.setdefault(name, [])
        own.append(at)
        of[at] = name
        joined = [c for c in linked if c != name]
        for c in joined:
            for j in members[c]:
                of[j] = name
            own += members[c]
        if name not in large and len(own) < LARGE:
            rest.add(at, tokens)
        else:
            if name not in large:
                large[name] = Index()
                loose = [j for j in own if j != at]
            else:
                loose = [j for c in joined if c not in large for j in members[c]]
            for c in joined:
                if c in large:
                    large[name].take(large.pop(c))
                    loose = [j for j in loose if j not in set(members[c])]
            for j in sorted(loose):
                held = sets[order[j]].tolist()
                rest.remove(j, held)
                large[name].insert(j, held)
            large[name].add(at, tokens)
        for c in joined:
            del members[c]
    root = list(range(len(sets)))
    for at, i in enumerate(order):
        root[i] = order[of[at]]
    return root


def components(edges: DataFrame) -> DataFrame:
    """id, root: the least id reachable over edges (a, b), by large and small stars; each round is written out."""
    e = written(edges.where("a <> b").distinct())
    mark = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least_of = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least_of, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least_of.select("a", F.col("m").alias("b"))).distinct()
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
        mark = now


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run of several: each key with its count, 255 at most."""
    uniq, of = np.unique(keys, return_inverse=True)
    return uniq, np.minimum(255, np.bincount(of, counts, len(uniq)))


def spread(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each run's keys 0 if one set alone has the key, else a number that grows with how many have it."""
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    level = np.minimum(255, 8 * np.log2(np.bincount(of, np.concatenate(counts), 1))).astype(np.uint8)[of]
    return np.split(level, np.cumsum([len(k) for k in keys])[:-1])


def _sets(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node binary (equal for equal sets), tokens binary, all rows.

    tokens: the shingles that others may have, rarest first; null for sets without a link.
    """
    packed = B.pack(docs, doc_id, text, BLOCK_BYTES)
    units, size = B.totals(packed)
    bits = B.key_bits(size)
    kind = B.Keys(B.ranges(size), bits, np.uint8, np.uint8, summed, spread)
    cut = np.uint64(64 - bits)

    def of_block(texts):
        sets = K.shingles(*K.texts(texts), k)
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        first = {x: i for i, x in reversed(list(enumerate(nodes)))}
        distinct = [sets[i] >> cut for i in first.values() if len(sets[i])]
        keys, counts = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return sets, nodes, first, keys, counts

    def keys_of(ids, null, texts):
        *_, keys, counts = of_block(texts)
        return keys, np.minimum(counts, 255)

    def use(ids, null, texts, levels):
        sets, nodes, first, keys, _ = of_block(texts)
        tokens = []
        for i, s in enumerate(sets):
            linked = None
            if first[nodes[i]] == i and len(s):
                level = levels[np.searchsorted(keys, s >> cut)]
                at = np.flatnonzero(level)
                if len(at) >= least(len(s), percent):
                    linked = s[at[np.argsort(level[at], kind="stable")]].tobytes()
            tokens.append(linked)
        return pd.DataFrame({"doc_id": B.joined(ids, null), "n_shingles": [len(s) for s in sets], "node": nodes, "tokens": tokens})

    return written(B.back(packed, B.answer(B.send(packed, kind, keys_of), kind, units), np.uint8, use, "doc_id long, n_shingles long, node binary, tokens binary"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rows = _sets(docs, doc_id, text, k, percent)
    # a row for each set that may link, with a short id
    sets = rows.where("tokens is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "lz4")

    def prefixes(batches):
        for batch in batches:
            ids, out = [], []
            for i, n, t in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens")):
                s = np.frombuffer(t.as_buffer(), np.uint64)
                s = s[: len(s) - least(n, percent) + 1]
                ids.append(np.full(len(s), i))
                out.append(s.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out))], names=["id", "token"])

    tokens = sets.select("id", "n", "tokens").mapInArrow(prefixes, "id long, token long")
    roots = tokens.groupBy("token").agg(F.min("id").alias("b"), F.max("id").alias("z")).where("b <> z").select("token", "b")
    near = components(tokens.join(roots, "token").select(F.col("id").alias("a"), "b"))
    near = near.union(near.select(F.col("root").alias("id"), "root").distinct())
    # parts of each component from the sets' sizes; the sets themselves are shuffled once
    sizes = written(sets.select("id", F.length("tokens").alias("size")).join(near, "id"))
    parts = sizes.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(GROUP_BYTES)).cast("int").alias("parts"))
    dealt = written(sizes.join(parts, "root").select("id", "root", "parts"))
    pairs = sets.select("id", "n", "tokens").join(dealt, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    pairs = pairs.withColumn("other", F.explode(other)).select("id", "root", "n", "tokens", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id").to_numpy()
        of = classes([np.frombuffer(t.as_buffer(), np.uint64) for t in group.column("tokens")], percent, group.column("n").to_pylist())
        return pa.table({"a": ids, "b": ids[of]})

    linked = written(pairs.groupBy("root", "p", "q").applyInArrow(verify, "a long, b long").where("a <> b"))
    final = components(linked)
    final = final.union(final.select(F.col("root").alias("id"), "root").distinct())
    heads = sets.select("id", "node").join(final, "id").select("node", "root")
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    of = ids.join(heads, "node", "left")
    roots = of.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    named = of.join(roots, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each class: that of the least id, null ids last, then of the least text hash.

    Rows are told apart by a number of their own, so ids may be null or repeat; a text without shingles is no copy.
    """
    held = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    of = link(held.select("row", F.col("doc.text").alias("text")), "row").where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("text"), "row")
    kept = of.join(held.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order")["row"].alias("row"))
    late = small(written(of.join(kept, "row", "left_anti").select("row")))
    return held.join(late, "row", "left_anti").select("doc.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS z FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.z)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(z) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""
