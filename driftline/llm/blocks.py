"""Documents packed in blocks, and exchanges of sorted hash runs between them.

An operator that needs statistics of every n-gram of a corpus would shuffle a row for
each n-gram.  Here a block of documents (some MB of text, compressed, one row of a
Parquet table in the shared folder) sends one sorted, delta-coded run of its distinct
64-bit hashes to each hash range; the range merges its runs, and sends each block an
answer for each of its hashes, in the run's order.  A frequent n-gram takes one entry of
a block at most, so there is no hot range, and what a range holds is the corpus's
distinct n-grams divided by the number of ranges, which follows the corpus's size.  Blocks
are bundled level by level where there are more than FAN ranges, so that the rows
exchanged are FAN for each block and level, not one for each block and range.  A bundle is of as
many units as a unit has parts, so that a part of a bundle is no larger than a unit.

Blocks are rows, so a lost task is done again on the same documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed

#: Bytes of text in a block (one longer text makes a block of its own), and bytes of text for each hash range.
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
#: Runs of a block, and of a bundle of blocks, on each level of the exchange, at most: about as many as a block has documents.
FAN = 4096
#: Hash ranges of a small corpus.
LEAST = 128


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block long, n int, bytes long, body binary: the documents' ids and texts (null: empty), in blocks, which are buckets of their own: texts are not shuffled."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for batch in batches:
            lengths = np.diff(_offsets(batch.column("text")))
            a = 0
            for b in range(1, batch.num_rows + 1):
                size += int(lengths[b - 1])
                if size >= block_bytes:
                    held.append(batch.slice(a, b - a))
                    yield _row(seq, held, size)
                    seq, held, size, a = seq + 1, [], 0, b
            if a < batch.num_rows:
                held.append(batch.slice(a))
        if held:
            yield _row(seq, held, size)

    return bucketed(src.mapInArrow(run, "block long, n int, bytes long, body binary"), "block")


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)


def _row(block: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    kinds = [("block", pa.int64()), ("n", pa.int32()), ("bytes", pa.int64()), ("body", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip((block, t.num_rows, size, sink.getvalue().to_pybytes()), kinds)], names=[k for k, _ in kinds])


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids, a mask of null ids, and texts."""
    with pa.ipc.open_stream(body) as r:
        t = r.read_all().combine_chunks()
    ids = t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64())
    null = ids.is_null().to_numpy(zero_copy_only=False)
    col = t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())
    return ids.fill_null(0).to_numpy(), null, col


def totals(blocks: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and of their texts' bytes."""
    n, size = blocks.agg(F.count("*"), F.sum("bytes")).first()
    return n, size or 0


def ranges(size: int, range_bytes: int = RANGE_BYTES) -> int:
    """Number of hash ranges for so many bytes of text; LEAST at least, so that it is the same for all small corpora."""
    return max(min(LEAST, FAN), -(-size // range_bytes))


def pack_keys(a: np.ndarray, more: bytes = b"") -> bytes:
    """Sorted distinct keys as compressed differences, then any bytes.

    The low 32 bits of the differences are kept by byte planes; the few that need more stand before them.
    """
    first, d = a[:1], np.diff(a)
    wide = d >= np.uint64(1 << 32)
    raw = b"".join((
        np.array([len(a), wide.sum()], np.int64).tobytes(), first.tobytes(), np.flatnonzero(wide).astype(np.int64).tobytes(), (d[wide] >> np.uint64(32)).astype(np.uint32).tobytes(),
        d.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(),
    ))
    body = pa.compress(raw, "zstd", asbytes=True)
    return np.array([len(raw), len(body)], np.int64).tobytes() + body + more


def unpack_keys(data: bytes) -> tuple[np.ndarray, bytes]:
    size, n = np.frombuffer(data, np.int64, 2)
    raw = pa.decompress(data[16 : 16 + n], int(size), "zstd", asbytes=True)
    count, wide = np.frombuffer(raw, np.int64, 2)
    at = 16
    first = np.frombuffer(raw, np.uint64, min(1, count), at)
    at += 8 * len(first)
    where = np.frombuffer(raw, np.int64, wide, at)
    at += 8 * wide
    high = np.frombuffer(raw, np.uint32, wide, at)
    at += 4 * wide
    m = max(0, count - 1)
    low = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at).reshape(4, m).T).view(np.uint32).reshape(-1)
    d = np.empty(count, np.uint64)
    d[: len(first)] = first
    d[1:] = low
    d[1:][where] += high.astype(np.uint64) << np.uint64(32)
    return np.cumsum(d, dtype=np.uint64), data[16 + n :]


def zipped(data: bytes) -> bytes:
    return np.int64(len(data)).tobytes() + pa.compress(data, "zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)


def key_bits(size: int) -> int:
    """Leading bits of a hash to keep as key: 48, or 16 more than it takes to number the corpus's bytes.

    Two of a corpus's n-grams then share a key with a chance of some 2**-17 for each n-gram at most.
    """
    return min(64, max(48, size.bit_length() + 16))


def fan(n: int) -> tuple[int, int]:
    """(parts of a unit, levels): the fewest levels of FAN parts that reach n ranges, and the fewest parts that reach them in so many levels."""
    levels = 1
    while FAN**levels < n:
        levels += 1
    parts = max(2, int(n ** (1 / levels)))
    while parts**levels < n:
        parts += 1
    return parts, levels


def top_step(n: int) -> int:
    """Ranges in a part of the first level."""
    parts, levels = fan(n)
    return parts ** (levels - 1)


def range_of(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The range of each key of so many bits (32 or more), of n equal ones: keys * n >> bits, in two halves."""
    low = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)
    return (((keys >> np.uint64(32)) * np.uint64(n) + low) >> np.uint64(bits - 32)).astype(np.int64)


class Keys:
    """Runs of sorted distinct keys of so many bits with a value for each, dealt to n hash ranges.

    combine(keys, values) makes one run of several, judge(list of (keys, values)) gives an array
    of `reply` for each run of a range, in the order of its keys.
    """

    def __init__(self, n: int, bits: int, value, reply, combine: Callable, judge: Callable):
        self.n, self.bits, self.value, self.reply, self.combine, self.judge_keys = n, bits, value, reply, combine, judge

    def split(self, keys: np.ndarray, values: np.ndarray, step: int):
        """(part, run) of the keys' parts of `step` ranges."""
        part = range_of(keys, self.n, self.bits) // step
        c = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(keys)]
        for x, y in zip(c, c[1:]):
            yield int(part[x]), pack_keys(keys[x:y], zipped(values[x:y].astype(self.value).tobytes()))

    def _read(self, runs):
        got = [unpack_keys(x) for x in runs]
        return [k for k, _ in got], [np.frombuffer(unzipped(v), self.value) for _, v in got]

    def down(self, runs: list[bytes], step: int):
        keys, values = self._read(runs)
        return self.split(*self.combine(np.concatenate(keys), np.concatenate(values)), step)

    def up(self, runs: list[bytes], answers: list[bytes], step: int) -> list[bytes]:
        keys, _ = self._read(runs)
        every = np.unique(np.concatenate(keys))
        got = np.concatenate([np.frombuffer(unzipped(x), self.reply) for x in answers])
        return [zipped(got[np.searchsorted(every, k)].tobytes()) for k in keys]

    def judge(self, runs: list[bytes]) -> list[bytes]:
        keys, values = self._read(runs)
        return [zipped(np.ascontiguousarray(a, self.reply).tobytes()) for a in self.judge_keys(keys, values)]


def send(blocks: DataFrame, kind: Keys, keys_of: Callable) -> DataFrame:
    """unit long, part int, run binary: each block's runs.  keys_of(ids, null, texts) gives sorted distinct keys and a value for each."""
    step = top_step(kind.n)

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block"), batch.column("body")):
                for part, data in kind.split(*keys_of(*unpack(body.as_buffer())), step):
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["unit", "part", "run"])

    return blocks.select("block", "body").mapInArrow(run, RUNS)


RUNS = "unit long, part int, run binary"
ANSWERS = "unit long, part int, answer binary"


def answer(runs: DataFrame, kind, units: int, step: int | None = None) -> DataFrame:
    """unit, part, answer: an answer to each run of send.

    Up to FAN ranges a part is a range and is judged at once.  Beyond, units have as many parts on
    every level (`fan`), and some as many units of one part are a bundle: `down` makes one run of theirs for each
    of its smaller parts, these are answered as runs of as many fewer units, and `up` takes the bundle's answers
    apart for its units.  A unit has FAN runs at most on each level, so the rows of a level are
    FAN x blocks and not ranges x blocks, and a bundle's part has the keys of one block, at any size of the corpus.
    """
    step = top_step(kind.n) if step is None else step
    if step == 1:

        def judge(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"unit": pdf["unit"], "part": pdf["part"], "answer": kind.judge(list(pdf["run"]))})

        return runs.groupBy("part").applyInPandas(judge, ANSWERS)
    parts = fan(kind.n)[0]
    bundles, below = -(-units // parts), step // parts
    tagged = runs.withColumn("bundle", F.pmod(F.xxhash64("unit"), F.lit(max(1, bundles))))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(pdf["bundle"].iloc[0], part, run) for part, run in kind.down(list(pdf.sort_values("unit")["run"]), below)]
        return pd.DataFrame(out, columns=["unit", "part", "run"])

    got = answer(tagged.groupBy("bundle", "part").applyInPandas(down, RUNS), kind, bundles, below)
    got = got.select(F.col("unit").alias("bundle"), F.floor(F.col("part") / F.lit(parts)).cast("int").alias("part"), F.col("part").alias("sub"), "answer")

    def up(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        return pd.DataFrame({"unit": pdf["unit"], "part": pdf["part"], "answer": kind.up(list(pdf["run"]), list(answers.sort_values("sub")["answer"]), below)})

    return tagged.groupBy("bundle", "part").cogroup(got.groupBy("bundle", "part")).applyInPandas(up, ANSWERS)


def any_of(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run of several: each key with whether it is in several of them or marked in one."""
    uniq, of = np.unique(keys, return_inverse=True)
    return uniq, (np.bincount(of, minlength=len(uniq)) > 1) | (np.bincount(of, flags, len(uniq)) > 0)


def in_several(keys: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
    """For each run's keys, whether another run has them or a run marks them (a bool for each key)."""
    every = np.concatenate(keys)
    every.sort()
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[f] for k, f in zip(keys, flags))]))
    if not len(twice):
        return [np.zeros(len(k), bool) for k in keys]
    return [twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k for k in keys]


def in_order(answers: pd.DataFrame, kind) -> np.ndarray:
    """A block's answers as one array, in the order of its keys."""
    order = np.argsort(answers["part"].to_numpy(), kind="stable")
    parts = [np.frombuffer(unzipped(answers["answer"].iloc[i]), kind) for i in order]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def back(blocks: DataFrame, answers: DataFrame, kind, use: Callable, schema: str) -> DataFrame:
    """use(ids, null, texts, answers in key order) for each block gives a pandas frame of `schema`."""

    def run(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return use(*unpack(b["body"].iloc[0]), in_order(a, kind))

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("unit")).applyInPandas(run, schema)


def joined(ids: np.ndarray, null: np.ndarray) -> pd.Series:
    """Ids as a nullable column."""
    return pd.Series(pd.array(ids, "Int64")).mask(null)
