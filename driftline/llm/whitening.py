"""Whitening of embedding vectors by upper-triangle column aggregates.

1. A first aggregation takes count, sums, least and greatest value of each dimension.
2. A second one sums the centred products of every dimension pair i <= j: one generated
   Spark SQL expression a pair, all in one aggregation.  Values are whole numbers, so each
   column is centred at the whole number next to its mean: products and sums are exact, in
   any order and whatever tasks are run again.  What is left of the mean, under 1/2, is taken
   off the sums by whole-number arithmetic, and only the last division rounds.
3. The driver gets one row of sums, assembles the covariance (dimensions squared, whatever
   the number of rows) and decomposes it with LAPACK.
4. Rows are projected on the components where they lie.  A last aggregation of the same
   kind checks that the whitened columns have the identity as covariance.

Nothing is grouped or shuffled but one row of sums a task, so no key can be hot.

Defined cases: vectors that are null, or hold null or non-finite entries, are dropped, and so
are those with an entry of which scaled * 64 is no long, and those whose length isn't the
commonest (of equally common ones the greatest); rows are taken as they are, so repeated rows
and ids count each by itself and a null id is kept; a component without variance (an
eigenvalue of no more than the rounding of the decomposition: fewer vectors than dimensions,
equal vectors) has whitened 0, and identity_error shows it as 1; a deviation that is no long
is null in op13 (whitened() gives it as decimal); an empty table gives no rows; other columns
are carried along by whitened() whatever their names, but for those that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Whole numbers that stand for an entry: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Pairs in one aggregation: all of 128 dimensions; wider vectors take several aggregations.
PAIRS = 8256
MOST = 2**63 - 1


@dataclass
class Whitening:
    """A fit: numbers of rows, sums of x, covariance of x, eigenvalues by falling size and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    centre: list[int]
    reach: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        total = float(np.trace(self.covariance))
        return [float(v) / total if total else 0.0 for v in self.values]

    @property
    def factors(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; 0 where there is no variance."""
        flat = self.values <= max(self.values[0], 0) * len(self.values) * np.finfo(float).eps
        return np.where(flat, 0.0, self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))


def whole(df: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows that can be taken, with their vectors as whole numbers in _x (array<long>)."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    good = F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < float(2**62) / scale))
    x = F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(own, v.alias("_v")).where(good).select("_row", x.alias("_x"))


def commonest(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with as many dimensions as most have, and that number."""
    top = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.where(F.size("_x") == d), d


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def upper_triangle(columns: DataFrame, d: int, kind: str) -> dict[tuple[int, int], object]:
    """Sums of the products of the columns x0, x1, ... for each pair i <= j, in one aggregation up to PAIRS pairs.

    Columns that can't be null (coalesce) halve the time that the sums take.
    """
    out, pairs = {}, _pairs(d)
    for a in range(0, len(pairs), PAIRS):
        part = pairs[a : a + PAIRS]
        got = columns.selectExpr(*[f"sum(cast(x{i} as {kind}) * x{j}) as p{i}_{j}" for i, j in part]).first()
        out |= dict(zip(part, got))
    return out


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The fit over all rows of whole(); None without rows."""
    if not d:
        return None
    at = [f"_x[{i}]" for i in range(d)]
    sums = rows.selectExpr("count(*) as n", *[f"sum(cast({x} as decimal(20,0))) as s{i}" for i, x in enumerate(at)], *[f"min({x}) as a{i}" for i, x in enumerate(at)], *[f"max({x}) as z{i}" for i, x in enumerate(at)]).first()
    n, s = sums["n"], [int(sums[f"s{i}"]) for i in range(d)]
    centre = [(2 * x + n) // (2 * n) for x in s]
    reach = [max(sums[f"z{i}"] - m, m - sums[f"a{i}"]) for i, m in enumerate(centre)]
    # longs where no sum can leave them, else decimals of 38 digits
    kind = "long" if n * max(reach) ** 2 <= MOST else "decimal(19,0)"
    p = upper_triangle(rows.selectExpr(*[f"coalesce({x} - {m}L, 0L) as x{i}" for i, (x, m) in enumerate(zip(at, centre))]), d, kind)
    left = [x - n * m for x, m in zip(s, centre)]
    cov = np.zeros((d, d))
    for (i, j), v in p.items():
        cov[i, j] = cov[j, i] = (int(v) * n - left[i] * left[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # either sign is a unit eigenvector: the entry that is greatest in size is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, s, centre, reach, cov, values, vectors)


def _project(rows: DataFrame, w: Whitening, k: int) -> DataFrame:
    """_row, _x, _w array<double>: the first k whitened values of each row."""
    factors, centre, n, d = np.ascontiguousarray(w.factors[:, :k]), np.array(w.centre), w.n, len(w.sums)
    # x - S/n as (x - centre) - (S - n*centre)/n: both parts keep all digits
    rest = np.array([(s - n * m) / n for s, m in zip(w.sums, w.centre)])

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            z = ((x - centre) - rest) @ factors
            offsets = pa.array(np.arange(0, z.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))], names=["_row", "_x", "_w"])

    return rows.mapInArrow(run, rows.select("_row", "_x", F.array(F.lit(0.0)).alias("_w")).schema)


def _deviation(w: Whitening) -> F.Column:
    """The exact sum over dimensions of (n*x - S)^2, in longs where none can leave them."""
    fits = sum((w.n * (r + 1)) ** 2 for r in w.reach) <= MOST
    kind = "long" if fits else "decimal(38,0)"
    parts = F.zip_with(F.col("_x"), F.array(*[F.lit(s).cast("decimal(38,0)") for s in w.sums]).cast(f"array<{kind}>"), lambda x, s: (x.cast(kind) * F.lit(w.n).cast("long") - s).cast(kind))
    return F.aggregate(parts, F.lit(0).cast(kind), lambda a, x: (a + x * x).cast(kind)).cast("decimal(38,0)")


def identity_error(rows: DataFrame, w: Whitening, k: int) -> float:
    """The greatest absolute entry of the covariance of the whitened columns less the identity."""
    z = _project(rows, w, k).select(*[F.col("_w")[i].alias(f"x{i}") for i in range(k)])
    mean = z.agg(*[F.avg(f"x{i}") for i in range(k)]).first()
    p = upper_triangle(z.selectExpr(*[f"coalesce(x{i} - cast({m!r} as double), 0d) as x{i}" for i, m in enumerate(mean)]), k, "double")
    return max(abs(v / w.n - (i == j)) for (i, j), v in p.items())


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """The rows taken, with `whitened` array<double> and `deviation` decimal(38,0); the fit; its identity error."""
    rows, d = commonest(whole(df, vector))
    w = fit(rows, d)
    own = [c for c in df.columns if c.lower() not in ("whitened", "deviation")]
    names = [F.col(f"_row.`{c}`").alias(c) for c in own]
    if w is None:
        return rows.select(*names, F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("decimal(38,0)").alias("deviation")), None, None
    k = min(components, d)
    return _project(rows, w, k).select(*names, F.col("_w").alias("whitened"), _deviation(w).alias("deviation")), w, identity_error(rows, w, k)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and each of its first 32 components."""
    out, w, error = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    share = F.array(*[F.lit(x) for x in w.explained[:COMPONENTS]]) if w else F.array().cast("array<double>")
    out = out.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
