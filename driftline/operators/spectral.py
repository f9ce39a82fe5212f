"""Spectral clustering of any number of points over a sparse affinity graph.

1. Each point's largest affinities, a fixed number of neighbours or a share of all points, made symmetric by
   the maximum, are the graph: one row an edge, scaled by the degrees of both ends, in buckets by one end.
2. Its leading eigenvectors come from block Lanczos iteration: a product with the graph is a join of edges with
   a narrow block of vectors and a sum by the other end, so vectors stay distributed, one row a point.  The driver
   holds only products of vectors with vectors (matrices of WIDTH + a block at most), out of one aggregation a step.
3. The number of clusters is at the largest gap between eigenvalues.  The iteration ends when the residuals, which bound
   the eigenvalues' errors, leave no doubt of that gap and the vectors before it have converged.
4. k-means on the rows of those vectors, all starts side by side: first centres are drawn by the least of exponential
   keys, a draw in proportion to squared distance in one aggregation, and a round is one aggregation too.

Defined cases: fewer than three points are all noise (-1).  Equal points, ties and separate parts of the
graph need nothing special; where points have fewer places than clusters, some clusters are empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours
from .storage import Store

#: Vectors of the basis before it starts again from its best ones, and products with the graph at most.
WIDTH, PRODUCTS = 120, 400
#: Residual of a converged vector, and squared residual of a direction that is no new one.
TOLERANCE, NOTHING = 1e-7, 1e-14


def affinities(points: DataFrame, near: int = 50, share: float | None = None) -> DataFrame:
    """i, j, w both ways: each point's `near` largest affinities, or a share of all others (n ** 2 edges then: bounded streams only)."""
    k = near if share is None else max(1, math.ceil(share * (points.count() - 1)))
    found = neighbours.nearest(points, k).select("i", F.explode("near").alias("x"))
    edges = found.select("i", "x.j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 - F.col("x.distance")) / 2)).alias("w"))
    return neighbours.both_ways(edges).groupBy("i", "j").agg(F.max("w").alias("w"))


def normalised(graph: DataFrame, store: Store) -> DataFrame:
    """i, j, w over the square roots of both degrees, in buckets by j."""
    root = store(neighbours.degrees(graph).select("i", F.sqrt("degree").alias("s")))
    other = root.select(F.col("i").alias("j"), F.col("s").alias("s2"))
    return store.bucketed(graph.join(root, "i").join(other, "j").select("i", "j", (F.col("w") / F.col("s") / F.col("s2")).alias("w")), "j")


def product(graph: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """seq, y: the graph times a block (seq, q) of so many vectors; the block's rows go to the edges' buckets."""
    each = graph.join(block.withColumnRenamed("seq", "j"), "j").select("i", *[(F.col("w") * F.col("q")[c]).alias(f"y{c}") for c in range(width)])
    sums = each.groupBy("i").agg(*[F.sum(f"y{c}").alias(f"y{c}") for c in range(width)])
    return sums.select(F.col("i").alias("seq"), F.array(*[f"y{c}" for c in range(width)]).alias("y"))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def mapped(wide: DataFrame, **made: Callable) -> DataFrame:
    """seq and array columns, each made of the matrices of a batch's `basis` and `y`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                basis, y = matrix(b, "basis"), matrix(b, "y")
                yield pa.RecordBatch.from_arrays([b.column("seq"), *[rows(np.ascontiguousarray(f(basis, y))) for f in made.values()]], ["seq", *made])

    return wide.mapInArrow(run, "seq long, " + ", ".join(f"{name} array<double>" for name in made))


def gram(wide: DataFrame, n: int) -> np.ndarray:
    """Products of all n vectors in `basis` and `y` with each other: a partition's in one row an entry, summed by entry."""

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                x = np.hstack((matrix(b, "basis"), matrix(b, "y")))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n, dtype=np.int32)), pa.array(total.ravel())], ["pos", "v"])

    out = np.zeros(n * n)
    for r in wide.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out.reshape(n, n)


def gap(value: np.ndarray, error: np.ndarray, most: int) -> tuple[int, bool]:
    """(clusters, certain) of the leading eigenvalues and bounds of their errors."""
    if len(value) < 2:
        return 1, True
    gaps, doubt = -np.diff(value[: most + 1]), error[: most + 1][:-1] + error[: most + 1][1:]
    at = int(gaps.argmax())
    sure = all(gaps[at] - doubt[at] > gaps[i] + doubt[i] for i in range(len(gaps)) if i != at)
    return int(np.clip(at + 1, 2, max(2, most))), sure


def leading(graph: DataFrame, points: DataFrame, store: Store, most: int, seed: int = 0) -> tuple[DataFrame, np.ndarray, int]:
    """(seq, v of the clusters' eigenvectors; the leading eigenvalues of the normalised graph; the number of clusters)."""
    block = most + 4
    first = F.array(*[F.xxhash64(F.lit(seed), F.lit(c), F.col("seq")) / F.lit(2.0**63) for c in range(block)])
    wide, d, width, h = store(points.select("seq", F.array().cast("array<double>").alias("basis"), first.alias("y"))), 0, block, np.zeros((0, 0))
    for _ in range(PRODUCTS):
        g = gram(wide, d + width)
        s, c, own = g[:d, :d], g[:d, d:], g[d:, d:]
        onto = np.linalg.solve(s, c) if d else c
        left = own - c.T @ onto
        size, way = np.linalg.eigh((left + left.T) / 2)
        new = size > (NOTHING if d else 1e-10 * size.max())
        if d:
            last = h.shape[0]
            h = np.block([[h, c[:last]], [c[:last].T, c[last:]]]) if d > last else h
            low = np.linalg.cholesky(s)
            value, u = np.linalg.eigh(np.linalg.solve(low, np.linalg.solve(low, (h + h.T) / 2).T))
            value, z = value[::-1], np.linalg.solve(low.T, u[:, ::-1])
            tail = z[d - width :, : most + 1]
            error = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", tail, left, tail)))
            k, sure = gap(value[: most + 1], error, most)
            enough = len(value) > most and (error[:k] < TOLERANCE).all() and (sure or (error < TOLERANCE).all())
            if enough or not new.any():
                k = min(k, d)
                return mapped(wide, v=lambda basis, y, z=z[:, :k]: basis @ z), value[: most + 1], k
            if d + width > WIDTH:
                best = z[:, :block]
                wide, d, width, h = store(mapped(wide, basis=lambda basis, y: basis[:, :0], y=lambda basis, y, best=best: basis @ best)), 0, block, np.zeros((0, 0))
                continue
        turn = way[:, new] / np.sqrt(size[new])

        def fresh(basis, y, onto=onto, turn=turn):
            return (y - basis @ onto) @ turn

        grown = mapped(wide, basis=lambda basis, y: np.hstack((basis, fresh(basis, y))), q=fresh)
        d, width = d + turn.shape[1], turn.shape[1]
        wide = store(grown.select("seq", "basis").join(product(graph, grown.select("seq", "q"), width), "seq"))
    raise RuntimeError(f"the eigengap was not certain after {PRODUCTS} products with the graph")


def kmeans(x: DataFrame, k: int, seed: int = 0, starts: int = 10, most: int = 100) -> DataFrame:
    """seq, pred (0 to k - 1) of rows (seq, v): the best of so many starts."""
    centres = [np.zeros((0, 0))] * starts

    def apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((v[:, None] - c) ** 2).sum(2)

    for at in range(k):
        drawn = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), F.lit(at), F.col("seq")) for s in range(starts)])

        def draw(batches, held=tuple(centres)):
            for b in batches:
                if b.num_rows:
                    v, seq = matrix(b, "v"), b.column("seq").to_numpy()
                    u = ((matrix(b, "u").astype(np.int64).view(np.uint64) >> np.uint64(11)) + 0.5) / 2.0**53
                    pick = []
                    for s, c in enumerate(held):
                        weight = apart(v, c).min(1) if len(c) else np.ones(len(v))
                        with np.errstate(divide="ignore"):
                            key = -np.log(u[:, s]) / weight
                        i = np.lexsort((seq, key))[0]
                        pick.append((s, float(key[i]), int(seq[i]), v[i].tolist()))
                    yield pa.RecordBatch.from_pylist([dict(zip(("start", "key", "seq", "v"), p)) for p in pick], pa.schema([("start", pa.int32()), ("key", pa.float64()), ("seq", pa.int64()), ("v", pa.list_(pa.float64()))]))

        found = x.select("seq", "v", drawn.alias("u")).mapInArrow(draw, "start int, key double, seq long, v array<double>")
        for r in found.groupBy("start").agg(F.min(F.struct("key", "seq", "v")).alias("m")).collect():
            c = centres[r["start"]]
            centres[r["start"]] = np.vstack((c, [r["m"]["v"]])) if len(c) else np.array([r["m"]["v"]])
    width = len(centres[0][0])
    for _ in range(most):

        def totals(batches, held=tuple(centres)):
            out = np.zeros((starts, k * (width + 1) + 1))
            for b in batches:
                if b.num_rows:
                    v = matrix(b, "v")
                    for s, c in enumerate(held):
                        d = apart(v, c)
                        of = np.eye(k)[d.argmin(1)]
                        out[s] += np.concatenate((of.sum(0), (of.T @ v).ravel(), [d.min(1).sum()]))
            n = out.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(starts, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), starts)), pa.array(out.ravel())], ["start", "pos", "v"])

        sums = np.zeros((starts, k * (width + 1) + 1))
        for r in x.mapInArrow(totals, "start int, pos int, v double").groupBy("start", "pos").agg(F.sum("v").alias("v")).collect():
            sums[r["start"], r["pos"]] = r["v"]
        count, total, cost = sums[:, :k, None], sums[:, k:-1].reshape(starts, k, width), sums[:, -1]
        moved = [np.where(n > 0, t / np.maximum(n, 1), c) for n, t, c in zip(count, total, centres)]
        still = all(np.allclose(m, c) for m, c in zip(moved, centres))
        best = centres[int(cost.argmin())]
        if still:
            break
        centres = moved

    def label(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(apart(matrix(b, "v"), best).argmin(1))], ["seq", "pred"])

    return x.select("seq", "v").mapInArrow(label, "seq long, pred long")


def cluster(points: DataFrame, near: int = 50, share: float | None = None, most: int = 8, seed: int = 0) -> DataFrame:
    """seq, pred: the least seq of the point's cluster; -1 where there are fewer than three points."""
    n = points.count()
    if n < 3:
        return points.select("seq", F.lit(-1).cast("long").alias("pred"))
    with Store(points.sparkSession) as store:
        graph = store(affinities(points, near, share))
        vectors, _, k = leading(normalised(graph, store), points, store, min(most, n - 1), seed)
        scaled = vectors.join(neighbours.degrees(graph).withColumnRenamed("i", "seq"), "seq")
        x = store(scaled.select("seq", F.transform("v", lambda e: e / F.sqrt("degree")).alias("v")))
        labels = store(kmeans(x, k, seed))
        names = labels.groupBy("pred").agg(F.min("seq").alias("name"))
        return Store(points.sparkSession)(labels.join(F.broadcast(names), "pred").select("seq", F.col("name").alias("pred")))
