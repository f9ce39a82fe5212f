"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Every byte goes that is covered by a MATCH-byte string which also starts in a document
with a smaller id; strings are judged on the input.

Which suffixes are sorted: of each MATCH-byte string the smallest GRAM-byte string in it
(by hash, leftmost on ties) is its anchor, so equal strings have anchors at the same
place, and only suffixes that start at anchors need an order: a sparse suffix array.
As in prefix-doubling sorts, a first exchange of fingerprints finds the suffixes whose
first GRAM bytes are in one document only; these can match nothing and are left out.

Sort: each block sorts its suffixes, cut at the furthest byte a match can reach and
followed by the bytes before the anchor a match can reach; equal ones collapse with
their least document.  The order is that of (range of the first GRAM bytes, bytes), with
ranges dealt by a second hash of these bytes: suffixes with GRAM common bytes stay
neighbours, and no range is larger than another by the anchors' choice.  The sorted runs
are front-coded (length of the prefix shared with the one before, then the rest) and
exchanged by range.  A range merges its runs with a loser tree that holds each head's
common prefix with the last winner: the head with the longer one is smaller, and on
equal lengths bytes are compared from there on, so that no known prefix is compared
again.  The prefix lengths that the tree gives also decide the matches: a string that
starts o bytes before its anchor is equal in two suffixes if all neighbours between them
share MATCH - o bytes and the o bytes before are equal too, which an order of the bytes
before the anchors tells.  No hash takes part in a verdict.  The least document of every
string is found so, and a mask of the strings with a smaller document goes back to each
run.

Hot suffixes take one entry of a block at most, whatever number of copies there is.  The
suffixes of one gram (GRAM equal bytes) with different surroundings meet in one task,
some 300 bytes each.

Defined cases: null and empty texts have no bytes; texts under MATCH bytes lose none;
rows with one id are one document, so that a repeated row loses nothing by its twin; a
null id counts as larger than all; very long texts are taken whole; an empty table gives
no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .common import table, written

MATCH, GRAM = 50, 32
#: String starts that can share an anchor; bytes before an anchor that belong to its strings.
SPAN = MATCH - GRAM + 1
BEFORE = SPAN - 1
#: Bytes of a sort key: MATCH from the anchor on, BEFORE before it, and the numbers of each that are in the text.
KEY = MATCH + BEFORE + 2
#: Bytes of text in a block: its keys are Python objects while they are sorted.
BLOCK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: The mask of all strings.
EVERY = np.uint32((1 << SPAN) - 1)
DEAL = K.COEF[50]


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, document, first and last string start, and gram key of each anchor."""
    out = []
    for a, b in K.pieces(off, 1 << 18):
        lo, part, o = int(off[a]), buf[off[a] : off[b]], off[a : b + 1] - off[a]
        n = len(part)
        if n < MATCH:
            continue
        pre = K.prefix(part, K.BYTE)
        h = K.mix((pre[GRAM:] - pre[: n + 1 - GRAM]) * K.powers(n + 1)[1][: n + 1 - GRAM])
        bits = np.uint64(n.bit_length())
        low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the anchor of the string at each position
        ok = np.ones(len(at) + 1, bool)
        for x, y in zip(o[:-1].tolist(), o[1:].tolist()):
            ok[max(x, y - MATCH + 1) : y] = False
        ok[-1] = False
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = at[1:] != at[:-1]
        i = np.flatnonzero(ok[:-1] & (new[:-1] | ~np.concatenate(([False], ok[:-2]))))
        j = np.flatnonzero(ok[:-1] & (new[1:] | ~ok[1:]))
        # the anchors are the least hashes, so ranges are dealt by another one
        out.append((at[i] + lo, np.searchsorted(o, at[i], "right") - 1 + a, i + lo, j + lo, K.mix(h[at[i]] ^ DEAL)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def in_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where each distinct key begins in it, and the distinct keys, rising."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, start, keys[start]


def sort_keys(buf: np.ndarray, off: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row of KEY bytes for each anchor."""
    after = np.minimum(off[doc + 1] - at, MATCH)
    before = np.minimum(at - off[doc], BEFORE)
    padded = np.concatenate((np.zeros(BEFORE, np.uint8), buf, np.zeros(MATCH, np.uint8)))
    rows = np.empty((len(at), KEY), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + MATCH)[at] if len(at) else np.zeros((0, BEFORE + MATCH), np.uint8)
    rows[:, :MATCH] = np.where(np.arange(MATCH) < after[:, None], view[:, BEFORE:], 0)
    rows[:, MATCH : MATCH + BEFORE] = np.where(np.arange(BEFORE) >= BEFORE - before[:, None], view[:, :BEFORE], 0)
    rows[:, -2], rows[:, -1] = after, before
    return rows


def front_coded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Front coding of sorted distinct rows: common prefix lengths and the bytes after them."""
    lcp = np.zeros(len(m), np.uint8)
    if len(m) > 1:
        lcp[1:] = (m[1:] != m[:-1]).argmax(1)
    return lcp, m[np.arange(KEY) >= lcp[:, None]]


class Run:
    """A front-coded run, read key by key."""

    def __init__(self, lcp: np.ndarray, rest: np.ndarray, docs: np.ndarray):
        self.lcp, self.docs, self.rest = lcp.tolist(), docs.tolist(), rest.tobytes()
        self.i, self.at, self.key = -1, 0, b""

    def step(self) -> int:
        """To the next key; its common prefix with the one before, or -1 at the end."""
        self.i += 1
        if self.i == len(self.lcp):
            self.key = None
            return -1
        h = self.lcp[self.i]
        end = self.at + KEY - h
        self.key = self.key[:h] + self.rest[self.at : end]
        self.at = end
        return h


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, Run, int]]:
    """(key, common prefix with the key before, run, position in it), in order, by a loser tree.

    Each loser keeps the length of its common prefix with the winner of its node; on the way up
    from a new head, whose prefix with the last winner its run knows, all lengths are against that
    winner, and bytes are compared only where the lengths are equal, from there on.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    # a loser is (prefix length, run or None); None has ended
    losers: list[tuple[int, Run | None]] = [(0, None)] * size

    def play(x, hx, y, hy):
        """(winner, its length, loser, its length against the winner)."""
        if y is None:
            return x, hx, y, 0
        if x is None:
            return y, hy, x, 0
        if hx > hy:
            return x, hx, y, hy
        if hy > hx:
            return y, hy, x, hx
        # only what is beyond the known prefix is looked at
        a, b = x.key[hx:], y.key[hx:]
        if a == b:
            return x, hx, y, KEY
        h = len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        return (x, hx, y, hx + h) if a[h] < b[h] else (y, hy, x, hx + h)

    for r in runs:
        r.step()
    heads = [(r if r.key is not None else None, 0) for r in runs] + [(None, 0)] * (size - n)
    node = {size + i: x for i, x in enumerate(heads)}
    for i in range(size - 1, 0, -1):
        (x, hx), (y, hy) = node.pop(2 * i), node.pop(2 * i + 1)
        w, hw, l, hl = play(x, hx, y, hy)
        node[i], losers[i] = (w, hw), (hl, l)
    place = {id(r): size + i for i, r in enumerate(runs)}
    top, h = node[1] if size > 1 else heads[0]
    while top is not None:
        yield top.key, h, top, top.i
        i = place[id(top)] // 2
        h = top.step()
        if h < 0:
            top, h = None, 0
        while i:
            hl, l = losers[i]
            if l is not None:
                top, h, l, hl = play(top, h, l, hl)
                losers[i] = (hl, l)
            i //= 2


class Judge:
    """Takes merged keys and finds, for each run's entry, its strings that are in a smaller document.

    Keys of one gram arrive together.  Some 50,000 distinct keys are judged at a time: for each
    place of the anchor, keys are grouped by the neighbours' common prefixes and by the bytes
    before the anchor, and each group's least document is compared with the entries' own.  The
    answer's bit o stands for the string that starts o bytes before the anchor.
    """

    MOST = 50_000

    def __init__(self, runs: list[Run]):
        self.base = np.concatenate(([0], np.cumsum([len(r.lcp) for r in runs]))).astype(np.int64)
        self.docs = np.array([d for r in runs for d in r.docs], np.int64)
        self.mask = np.zeros(self.base[-1], np.uint32)
        first = {id(r): int(x) for r, x in zip(runs, self.base)}
        keys, common, entry, of = [], [], [], []
        for key, h, run, i in merged(runs):
            if h < KEY or not keys:
                if h < GRAM and len(keys) >= self.MOST:
                    self.flush(keys, common, entry, of)
                    keys, common, entry, of = [], [], [], []
                keys.append(key)
                common.append(h)
            entry.append(first[id(run)] + i)
            of.append(len(keys) - 1)
        if keys:
            self.flush(keys, common, entry, of)

    def flush(self, keys: list[bytes], common: list[int], entry: list[int], of: list[int]) -> None:
        rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
        entry, of, lcp = np.array(entry), np.array(of), np.array(common)
        lcp[0] = 0
        docs = self.docs[entry]
        least = np.minimum.reduceat(docs, np.flatnonzero(np.diff(of, prepend=-1)))
        # only keys with a neighbour of their gram have strings in common with another key
        near = lcp >= GRAM
        near[:-1] |= near[1:]
        pick = np.flatnonzero(near)
        rows, lcp, after, before = rows[pick], lcp[pick], rows[pick, -2], rows[pick, -1]
        # keys in the order of the bytes before their anchors, nearest first, and the bytes that neighbours share
        back = np.zeros((len(rows), -(-BEFORE // 8) * 8), np.uint8)
        back[:, :BEFORE] = rows[:, MATCH : MATCH + BEFORE][:, ::-1]
        order = np.lexsort(back.view(">u8").T[::-1])
        shared = np.zeros(len(rows), np.int64)
        differ = back[order[1:]] != back[order[:-1]]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), BEFORE)
        mask = np.zeros(len(entry), np.uint32)
        for o in range(SPAN):
            of_key = least.copy()
            there = np.flatnonzero((before >= o) & (after >= MATCH - o))
            if len(there):
                group = np.cumsum(lcp < MATCH - o) * len(rows)
                if o:
                    group[order] += np.cumsum(shared < o)
                group = group[there]
                by = np.argsort(group)
                start = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1])))
                first = np.minimum.reduceat(least[pick[there]][by], start)
                of_key[pick[there[by]]] = np.repeat(first, np.diff(np.concatenate((start, [len(by)]))))
            mask |= (docs > of_key[of]).astype(np.uint32) << np.uint32(o)
        self.mask[entry] = mask


class Suffixes:
    """Front-coded runs of sorted keys with their least documents, for B.answer."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits

    @staticmethod
    def write(rows: np.ndarray, least: np.ndarray) -> bytes:
        lcp, rest = front_coded(rows)
        parts = [B.zipped(x.tobytes()) for x in (lcp, least, rest)]
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)

    @staticmethod
    def read(run: bytes) -> Run:
        x, y, _ = np.frombuffer(run, np.int64, 3).tolist()
        lcp, least, rest = run[24 : 24 + x], run[24 + x : 24 + x + y], run[24 + x + y :]
        return Run(*(np.frombuffer(B.unzipped(p), kind) for p, kind in ((lcp, np.uint8), (rest, np.uint8), (least, np.int64))))

    def part_of(self, grams: np.ndarray, step: int) -> np.ndarray:
        return B.range_of(grams, self.n, self.bits) // step

    def _merge(self, runs: list[bytes]):
        """Distinct keys, their least documents and each run's entries in them."""
        read = [self.read(r) for r in runs]
        keys, least, at = [], [], {id(r): [] for r in read}
        for key, h, run, i in merged(read):
            d = run.docs[i]
            if h < KEY or not keys:
                keys.append(key)
                least.append(d)
            elif d < least[-1]:
                least[-1] = d
            at[id(run)].append(len(keys) - 1)
        rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
        power, _ = K.powers(GRAM)
        grams = K.mix(K.mix((K.BYTE[rows[:, :GRAM]] * power[:GRAM]).sum(1, dtype=np.uint64)) ^ DEAL) >> np.uint64(64 - self.bits)
        return rows, np.array(least, np.int64), [np.array(at[id(r)]) for r in read], grams, read

    def down(self, runs: list[bytes], step: int):
        rows, least, _, grams, _ = self._merge(runs)
        part = self.part_of(grams, step)
        for p in np.unique(part).tolist():
            i = part == p
            yield p, self.write(rows[i], least[i])

    def up(self, runs: list[bytes], answers: list[bytes], step: int) -> list[bytes]:
        """An entry whose document isn't the bundle's least has all its strings in a smaller one."""
        _, least, at, grams, read = self._merge(runs)
        got = np.empty(len(grams), np.uint32)
        got[np.argsort(self.part_of(grams, step), kind="stable")] = np.concatenate([np.frombuffer(B.unzipped(x), np.uint32) for x in answers])
        return [B.zipped(np.where(np.array(r.docs, np.int64) > least[i], EVERY, got[i]).astype(np.uint32).tobytes()) for r, i in zip(read, at)]

    def judge(self, runs: list[bytes]) -> list[bytes]:
        judge = Judge([self.read(r) for r in runs])
        return [B.zipped(m.tobytes()) for m in np.split(judge.mask, judge.base[1:-1])]


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>> (maximal removed runs), kept binary."""
    packed = B.pack(docs, doc_id, text, BLOCK_BYTES)
    units, size = B.totals(packed)
    bits, n = B.key_bits(size), B.ranges(size)
    cut = np.uint64(64 - bits)
    grams, suffixes, step = B.Keys(n, bits, bool, bool, B.any_of, B.in_several), Suffixes(n, bits), B.top_step(n)

    def keys_of(ids, null, texts):
        _, doc, _, _, gram = anchors(*K.texts(texts))
        order, start, keys = in_groups(gram >> cut)
        of = np.where(null, LAST, ids)[doc[order]]
        several = np.maximum.reduceat(of, start) != np.minimum.reduceat(of, start) if len(keys) else np.zeros(0, bool)
        return keys, several

    shared = written(B.answer(B.send(packed, grams, keys_of), grams, units), "none", tidy=True)

    def entries(ids, null, texts, hit):
        """The anchors in question, the entry of each, and the entries in order: part, key, least document."""
        buf, off = K.texts(texts)
        at, doc, p, q, gram = anchors(buf, off)
        gram = gram >> cut
        order, start, keys = in_groups(gram)
        use = np.zeros(len(gram), bool)
        use[order] = np.repeat(hit[: len(keys)], np.diff(np.append(start, len(gram))))
        at, doc, p, q, gram = at[use], doc[use], p[use], q[use], gram[use]
        rows = np.concatenate((suffixes.part_of(gram, step).astype(">u4").view(np.uint8).reshape(-1, 4), sort_keys(buf, off, at, doc)), 1)
        order = np.argsort(rows.view(f"S{rows.shape[1]}").reshape(-1), kind="stable")
        rows, owner = rows[order], np.where(null, LAST, ids)[doc]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        entry = np.empty(len(rows), np.int64)
        entry[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(rows) else owner
        part = np.ascontiguousarray(rows[new, :4]).view(">u4").reshape(-1).astype(np.int64)
        return buf, off, at, p, q, owner, entry, part, np.ascontiguousarray(rows[new, 4:]), least

    def emit(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        *_, part, keys, least = entries(*B.unpack(b["body"].iloc[0]), B.in_order(a, bool))
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
        out = [(b["block"].iloc[0], part[x], Suffixes.write(keys[x:y], least[x:y])) for x, y in zip(cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["unit", "part", "run"])

    # runs are as large as the texts: they are shuffled but not written, and `finish` makes its entries again
    runs = packed.select("block", "body").groupBy("block").cogroup(shared.groupBy("unit")).applyInPandas(emit, B.RUNS)
    masks = B.answer(runs, suffixes, units)
    tagged = shared.withColumn("kind", F.lit(0)).union(masks.withColumn("kind", F.lit(1)))

    def finish(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        ids, null, texts = B.unpack(b["body"].iloc[0])
        buf, off, at, p, q, owner, entry, _, _, least = entries(ids, null, texts, B.in_order(a[a["kind"] == 0], bool))
        got = B.in_order(a[a["kind"] == 1], np.uint32)
        masks = np.where(owner > least[entry], EVERY, got[entry]).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        cover = np.zeros(len(buf) + 1, np.int64)
        for o in range(SPAN):
            s = at - o
            s = s[(masks >> np.uint32(o) & 1).astype(bool) & (s >= p) & (s <= q)]
            # each string start belongs to one anchor
            cover[s] += 1
            cover[s + MATCH] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        first = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
        last = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        so = np.searchsorted(first, off)
        rows = []
        for d in range(len(ids)):
            x, y = off[d], off[d + 1]
            s, e = first[so[d] : so[d + 1]] - x, last[so[d] : so[d + 1]] - x
            rows.append((int(y - x), [{"start": int(i), "end": int(j)} for i, j in zip(s, e)], buf[x:y][~gone[x:y]].tobytes()))
        out = pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])
        out.insert(0, "doc_id", B.joined(ids, null))
        return out

    return packed.select("block", "body").groupBy("block").cogroup(tagged.groupBy("unit")).applyInPandas(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (s, x) -> s + x.end - x.start) as n_removed", "cast(size(spans) as long) as n_spans", "sha2(kept, 256) as kept_sha256")
