"""Clustering quality from the contingency table; nothing is computed on pairs of points."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """label, pred, n, noise (-1) included, for each value of the columns `by`."""
    return rows.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def _pairs(c) -> F.Column:
    return F.sum(F.col(c) * (F.col(c) - 1) / 2)


def quality(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pair precision and recall, false-merge rate, coverage, ARI, NMI, clusters; 0 below two rows.  A row for each value of `by`, or one."""
    c = contingency(rows, by)
    placed = F.col("pred") >= 0
    t = c.groupBy(*by, "label").agg(F.sum("n").alias("a"))
    p = c.groupBy(*by, "pred").agg(F.sum("n").alias("b"))
    total = c.groupBy(*by).agg(
        F.sum("n").alias("n"), _pairs("n").alias("both"), F.sum(F.when(placed, F.col("n") * (F.col("n") - 1) / 2).otherwise(0)).alias("tp"),
        F.sum(F.when(placed, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.col("n") * F.log("n")).alias("hab"),
    )
    pt = t.groupBy(*by).agg(_pairs("a").alias("same"), F.sum(F.col("a") * F.log("a")).alias("ha"))
    pp = p.groupBy(*by).agg(_pairs("b").alias("merged"), F.sum(F.when(placed, F.col("b") * (F.col("b") - 1) / 2).otherwise(0)).alias("placed"), F.sum(F.col("b") * F.log("b")).alias("hb"), F.sum(F.when(placed, 1).otherwise(0)).alias("clusters"))
    x = total.join(pt, list(by)).join(pp, list(by)) if by else total.crossJoin(pt).crossJoin(pp)  # one row each without `by`
    all_ = F.col("n") * (F.col("n") - 1) / 2
    few = F.coalesce(F.col("n"), F.lit(0)) < 2
    pairs = F.nullif(all_, F.lit(0.0))
    expected = F.col("same") * F.col("merged") / pairs
    top = (F.col("same") + F.col("merged")) / 2
    ln = F.log("n")
    hu, hv = ln - F.col("ha") / F.col("n"), ln - F.col("hb") / F.col("n")
    mi = F.greatest(F.lit(0.0), ln + (F.col("hab") - F.col("ha") - F.col("hb")) / F.col("n"))
    ari = F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / F.nullif(top - expected, F.lit(0.0)))
    nmi = F.when((hu < 1e-12) & (hv < 1e-12), 1.0).when((hu < 1e-12) | (hv < 1e-12), 0.0).otherwise(mi / F.nullif((hu + hv) / 2, F.lit(0.0)))
    zero = lambda e: F.when(few, 0.0).otherwise(F.round(e, 9))
    one = F.lit(1.0)
    return x.select(
        *by, zero(F.col("tp") / F.greatest(one, F.col("placed"))).alias("pairwise_precision"), zero(F.col("tp") / F.greatest(one, F.col("same"))).alias("pairwise_recall"),
        zero((F.col("placed") - F.col("tp")) / F.greatest(one, all_ - F.col("same"))).alias("false_merge_rate"), F.when(F.col("n") > 0, F.round(F.col("covered") / F.nullif("n", F.lit(0)), 9)).otherwise(0.0).alias("coverage"),
        zero(ari).alias("ari"), zero(nmi).alias("nmi"), F.coalesce("clusters", F.lit(0)).cast("long").alias("cluster_count"),
    )


def noise_singletons(rows: DataFrame) -> DataFrame:
    """seq, label, pred: each noise row gets an id of its own after the largest, in row order.

    Noise rows are numbered in parts: counts by part of the sequence, then a number within the part.
    """
    top = rows.agg(F.coalesce(F.max("pred"), F.lit(-1)).alias("top"))
    part = F.floor(F.col("seq") / 65536)
    noise = rows.where("pred < 0").withColumn("part", part)
    before = noise.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ids = noise.join(before, "part").withColumn("k", F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("part").orderBy("seq")))
    own = ids.crossJoin(F.broadcast(top)).select("seq", "label", (F.greatest(F.col("top"), F.lit(-1)) + F.col("k")).cast("long").alias("pred"))
    return rows.where("pred >= 0").select("seq", "label", F.col("pred").cast("long").alias("pred")).union(own)


def assign(m: np.ndarray) -> int:
    """Largest sum of a matching of rows and columns (successive shortest augmenting paths)."""
    if not m.size:
        return 0
    cost = -(m if m.shape[0] <= m.shape[1] else m.T).astype(float)
    n, k = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(k + 1), np.zeros(k + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
        while match[j0]:
            used[j0] = True
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.where(used, np.inf, low)[1:].argmin()) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return int(round(-sum(cost[match[j] - 1, j - 1] for j in range(1, k + 1) if match[j])))


def _matched(cells: pd.DataFrame) -> int:
    return assign(cells.pivot_table(index="label", columns="pred", values="n", aggfunc="sum", fill_value=0).to_numpy()) if len(cells) else 0


def accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Strict, non-noise and noise-as-singleton accuracy, for each value of `by`; the matching runs on the table of counts.

    Of the singletons that noise rows become, a label can be matched with one at most, at a gain of 1,
    and no other label can use it: a column of its own stands for all those of a label.  The
    table of one clustering, labels x clusters, is held in one task.
    """
    c = contingency(rows, by).withColumn("pred", F.col("pred").cast("long"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        real, noise = pdf[pdf["pred"] >= 0], pdf[pdf["pred"] < 0].groupby("label", as_index=False)["n"].sum()
        top = int(real["pred"].max()) + 1 if len(real) else 0
        own = pd.DataFrame({"label": noise["label"], "pred": np.arange(top, top + len(noise)), "n": 1})
        n, m = int(pdf["n"].sum()), int(real["n"].sum())
        strict, single = _matched(real), _matched(pd.concat([real[["label", "pred", "n"]], own]))
        rates = {"cluster_accuracy": [strict / n], "cluster_accuracy_non_noise": [strict / m if m else 0.0], "cluster_accuracy_noise_singletons": [single / n]}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, **{k: np.round(v, 9) for k, v in rates.items()}})

    kinds = dict(rows.dtypes)
    names = ("cluster_accuracy", "cluster_accuracy_non_noise", "cluster_accuracy_noise_singletons")
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), *(f"{k} double" for k in names)])
    out = (c.groupBy(*by) if by else c.withColumn("all", F.lit(0)).groupBy("all")).applyInPandas(solve, schema)
    return out if by else out.agg(*[F.coalesce(F.max(k), F.lit(0.0)).alias(k) for k in names])
