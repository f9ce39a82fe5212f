"""Refits of a growing prefix, all checkpoints of all streams side by side.

A method that refits depends on the prefix alone, so a checkpoint is a row that is joined to
the arrivals before it, and one task fits one prefix; nothing is fitted that isn't
counted.  An arrival goes to every checkpoint at or after it: n ** 2 / (2 * every) rows of a stream of
n, which is the method's own work.  A prefix has density.MOST points at most.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import density, metrics


def prefixes(points: DataFrame, every: int) -> DataFrame:
    """The arrivals, each once for each checkpoint at or after it: upto is the number of arrivals until then; the last arrival is always one."""
    if every <= 0:
        raise ValueError("every must be positive")
    one = Window.partitionBy("stream_id")
    ranked = points.withColumn("rank", F.row_number().over(one.orderBy("seq"))).withColumn("n", F.count("*").over(one))
    steps = F.sequence(F.ceil(F.col("rank") / every), F.ceil(F.col("n") / every))
    return ranked.select("stream_id", "seq", "embedding", "label", F.explode(F.transform(steps, lambda s: F.least(s * every, F.col("n")))).alias("upto"))


def refit(points: DataFrame, backend: str, every: int = 10, least: int = 4, k: int = 2) -> DataFrame:
    """stream_id, upto, seq, label, pred: each prefix clustered afresh."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf[["stream_id", "upto", "seq", "label"]].assign(pred=density.cluster(np.stack(pdf["embedding"].to_list()), backend, least, k))

    return prefixes(points, every).groupBy("stream_id", "upto").applyInPandas(run, "stream_id string, upto long, seq long, label long, pred long")


def quality(fits: DataFrame) -> DataFrame:
    return metrics.quality(fits, ("stream_id", "upto"))


def work(fits: DataFrame) -> DataFrame:
    """stream_id, recompute_count, fitted_points, distance_comparisons of the fits that ran."""
    each = fits.groupBy("stream_id", "upto").agg(F.count("*").alias("n"))
    return each.groupBy("stream_id").agg(F.count("*").alias("recompute_count"), F.sum("n").alias("fitted_points"), F.sum(F.expr("n * (n - 1) div 2")).alias("distance_comparisons"))
