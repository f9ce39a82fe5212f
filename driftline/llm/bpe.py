"""Byte-level BPE by monoid tree reduction.

Encoding: a piece is halved until short, halves are encoded on their own, and two
neighbouring token lists are joined by encoding a window of tokens around the seam
again; the window grows on a side until the pair of tokens at its edge is stable, that
is, until the bytes of the two tokens alone encode to just these two.  A token list in
which every neighbouring pair is stable is the encoding of its bytes, so tokens outside
the window can't change.  Joining is associative, and the tree's shape doesn't matter.
Decoding concatenates the bytes of tokens up a tree of the same kind.

Defined cases: null and empty texts have no tokens; repeated rows are each encoded;
very long pieces cost time in proportion to their length times its logarithm; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pieces up to this many bytes are merged as a leaf.
LEAF = 24
#: Encodings of at most so many pieces are kept by each worker.
CACHED = 1 << 17
#: Rows go out when their ids are so many tokens together.
HELD = 1 << 18
#: Tokens that decode as one leaf.
DECODE_LEAF = 1 << 14


class Bpe:
    """A vocabulary of ranks and its encoder."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.stable = lru_cache(1 << 16)(self._stable)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """Greedy merges, lowest rank first and leftmost on ties."""
        get, n = self.ranks.get, len(data)
        if n > 4 * LEAF:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(n)]
        rank = [get(data[i : i + 2], 1 << 30) for i in range(n - 1)]
        while rank:
            low = min(rank)
            if low == 1 << 30:
                break
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], 1 << 30)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same through a heap, for windows that grew long."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if mid <= 0 or mid >= n or mid >= e or end[mid] != e:
                continue  # one of the two parts has changed
            end[i], end[mid] = e, 0
            if e < n:
                before[e] = i
                if (r := get(data[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (b := before[i]) >= 0 and (r := get(data[b:e])) is not None:
                heapq.heappush(heap, (r, b, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of what two lists encode."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = self.merged(b"".join(map(self.bytes_of.__getitem__, itertools.chain(left[len(left) - i :], right[:j]))))
            grow_l = i < len(left) and not self.stable(left[-i - 1], seam[0])
            grow_r = j < len(right) and not self.stable(seam[-1], right[j])
            if not grow_l and not grow_r:
                return left[: len(left) - i] + seam + right[j:]
            i, j = i << grow_l, j << grow_r

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        mid = len(data) // 2
        return self.join(self.tree(data[:mid]), self.tree(data[mid:]))

    def encode_piece(self, data: bytes) -> list[int]:
        i = self.ranks.get(data)
        return [i] if i is not None else self.tree(data)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class Pieces(dict):
    """Token ids of pieces, computed on first use; bounded."""

    def __init__(self, bpe: Bpe, most: int = CACHED):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.bpe.encode_piece(piece.encode()))
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids and back: each match of the pattern is encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.bpe = Bpe.load(path)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces = Pieces(self.bpe)

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return self.bpe.decode(ids)


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int> of each whole text."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches):
        enc = encoder(path, pattern)
        digits = list(map(str, range(len(enc.bpe.bytes_of))))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + ids]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids]
        for batch in batches:
            rows, first, held = [], 0, 0
            for at, value in enumerate(batch.column("text"), 1):
                tokens = enc.encode(value.as_py())
                listed = ",".join(map(digits.__getitem__, tokens)).encode()
                rows.append((len(tokens), hashlib.sha256(listed).hexdigest(), hashlib.sha256(enc.decode(tokens)).hexdigest(), *([tokens] if ids else [])))
                held += len(tokens) if ids else 0
                if held >= HELD or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)
                    rows, first, held = [], at, 0

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.decode(x.as_py() or []) for x in batch.column("ids")], pa.binary())], names=["doc_id", "data"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, data binary")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *vocabulary(), ids=False)
