"""Approximate nearest neighbours by locality-sensitive buckets with multi-probe.

1. Each of `tables` tables has its own random hyperplanes; the sides on which a point lies are its
   bucket.  The number of hyperplanes follows from the number of points, so that a bucket has about
   `bucket` points of spread-out data.
2. A point stands in one bucket of each table, and asks in that one and in those it nearly fell in:
   the buckets across its nearest hyperplanes, one or two at a time, by their distances.
3. In each bucket those who ask are compared with those who stand there, exactly, and the k nearest
   of each are kept; of all tables' finds the k nearest distinct ones.

Buckets are counted first: one with more than PART points is dealt to parts of those who stand in it and
parts of those who ask, each pair of parts a task, so that a hot bucket (equal or close vectors) is
neither cut nor one task's.  Only points that share a bucket are compared.  Randomness comes from the
seed alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours
from .storage import Store

#: Points of a bucket of spread-out data, and points of one side of a task.
BUCKET, PART = 512, 4096


def planes(n: int, bucket: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n / bucket))))


def probes_of(margins: np.ndarray, probes: int) -> np.ndarray:
    """For each row, which bits its probes flip (0: its own bucket first), least sum of squared margins first; ones and twos."""
    bits = margins.shape[1]
    sets = [(b,) for b in range(bits)] + [(a, b) for a in range(bits) for b in range(a + 1, bits)]
    cost = np.stack([(margins[:, list(s)] ** 2).sum(1) for s in sets], axis=1)
    flips = np.array([sum(1 << b for b in s) for s in sets], np.int64)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.concatenate((np.zeros((len(margins), 1), np.int64), flips[order]), axis=1)


def asked(points: DataFrame, bits: int, tables: int, probes: int, seed: int = 0) -> DataFrame:
    """seq, embedding, t, code, stands: a point's own bucket of each table (stands) and those where it asks beside."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("embedding").flatten().to_numpy().reshape(n, -1).astype(np.float64)
            for t in range(tables):
                # the planes of a table follow from seed, table and width alone
                normal = np.random.default_rng([seed, t, x.shape[1], bits]).normal(size=(x.shape[1], bits))
                side = x @ (normal / np.linalg.norm(normal, axis=0))
                own = ((side > 0) << np.arange(bits)).sum(1)
                codes = own[:, None] ^ probes_of(np.abs(side), probes)
                m = codes.shape[1]
                rows = batch.take(pa.array(np.repeat(np.arange(n), m)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n * m, t, np.int32)), pa.array(codes.reshape(-1)), pa.array(np.tile(np.arange(m) == 0, n))], names=["seq", "embedding", "t", "code", "stands"])

    src = points.select("seq", "embedding")
    return src.mapInArrow(run, f"seq long, embedding {dict(src.dtypes)['embedding']}, t int, code long, stands boolean")


def compared_in_buckets(rows: DataFrame, k: int, store: Store, part: int = PART) -> DataFrame:
    """i, distance, j: the k nearest that each point finds in each bucket where it asks."""
    sizes = store(rows.groupBy("t", "code").agg(F.count_if("stands").alias("n"), F.count("*").alias("m")).where("n > 0").select("t", "code", F.ceil(F.col("n") / F.lit(part)).cast("int").alias("nd"), F.ceil(F.col("m") / F.lit(part)).cast("int").alias("nq")))
    each = rows.join(neighbours.few(sizes), ["t", "code"])
    deal = lambda n: F.pmod(F.xxhash64("seq"), F.col(n)).cast("int")
    here = each.where("stands").select("t", "code", "seq", "embedding", deal("nd").alias("d"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(True).alias("stands"))
    ask = each.select("t", "code", "seq", "embedding", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("d"), deal("nq").alias("q"), F.lit(False).alias("stands"))

    def vectors(t: pa.Table):
        ids = t.column("seq").to_numpy()
        return ids, pc.list_flatten(t.column("embedding")).to_numpy().reshape(len(ids), -1).astype(np.float64) if len(ids) else np.zeros((0, 0))

    def run(t: pa.Table) -> pa.Table:
        (ids2, y), (ids, x) = vectors(t.filter(t.column("stands"))), vectors(t.filter(pc.invert(t.column("stands"))))
        found = []
        if len(ids) and len(ids2):
            for at, d in neighbours.cosine_rows(x, y):
                own = ids[at : at + len(d)]
                i, w, j = neighbours.least(own, ids2, np.where(own[:, None] == ids2, np.inf, d), k)
                found.append(pa.table({"i": i, "distance": w, "j": j}))
        return pa.concat_tables(found) if found else pa.table({"i": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "j": pa.array([], pa.int64())})

    return here.unionByName(ask).groupBy("t", "code", "d", "q").applyInArrow(run, "i long, distance double, j long")


def nearest(points: DataFrame, k: int, tables: int = 8, probes: int = 6, bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """i, near array<struct<distance, j>>: of each point the k nearest that share a bucket it asks in, ties by id.

    Points whose buckets hold no other have no row.
    """
    with Store(points.sparkSession) as store:
        rows = store(asked(points, planes(points.count(), bucket), tables, probes, seed))
        return Store(points.sparkSession)(neighbours.top(compared_in_buckets(rows, k, store), k))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, recall: the mean share of the exact neighbours that were found; ties with the furthest count as found."""
    last = F.element_at(F.col("e"), -1)["distance"]
    both = exact.select("i", F.col("near").alias("e")).join(found.select("i", "near"), "i", "left")
    hits = F.size(F.filter(F.coalesce("near", F.array().cast("array<struct<distance:double,j:bigint>>")), lambda x: x["distance"] <= last + 1e-12))
    return both.agg(F.count("*").alias("n"), F.avg(hits / F.size("e")).alias("recall"))
