"""Reports over method summaries: baseline deltas, seed and rate statistics, latency, sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each method stands for in a comparison.
ROLES = {
    "full_hdbscan": "full_reference",
    "adaptive_tradeoff": "adaptive_tradeoff_candidate",
    "adaptive_fishdbc": "proposed_risk_gated_fishdbc",
    "adaptive_fishdbc_async": "proposed_async_risk_gated_fishdbc",
    "compressed_hdbscan": "cache_compression_candidate",
    "window_hdbscan": "bounded_window_baseline",
    "fishdbc": "incremental_mst_candidate",
    "approx_predict": "fixed_model_prediction_baseline",
    "fast_hdbscan": "static_backend_control",
    "ahc": "classic_agglomerative_baseline",
    "sc_pna": "ICASSP2025_spectral_baseline",
    "diart_style": "DIART_style_online_baseline",
}


def role_of(method: str = "method") -> F.Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col(method)], F.lit("candidate"))


def compare(rows: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """Every method's metrics and their differences to the baseline's one row; null if either is missing."""
    base = rows.where(F.col("method") == baseline).limit(1).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    others = rows.where(F.col("method") != baseline).unionByName(rows.where(F.col("method") == baseline).limit(1))
    return others.join(F.broadcast(base), how="left").select("method", role_of().alias("role"), *metrics, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics])


#: Rates that a comparison carries where the summaries have them.
RATES = ["full_trigger_rate", "cheap_update_rate", "distance_comparisons_per_input"]


def compare_to_full(full: DataFrame, candidates: DataFrame, metrics: list[str], counters: list[str] = (), baseline: str = "full_hdbscan") -> DataFrame:
    """The baseline's summary, which must be one row, and the candidates' without any of the baseline: status, speed-up, counters, rates, metrics and deltas.

    Where a summary has no steady mean or P95, that of all steps (mean_step_ms, p95_step_ms) stands for it, and a baseline
    without any raises.  The speed-up is the baseline's mean over the method's own, 0 for a failed method or one without a mean.
    Columns that only one of the two frames has are null in the other.
    """
    rows = full.where(F.col("method") == baseline)
    if rows.limit(2).count() != 1:
        raise ValueError(f"there must be one summary of {baseline}")
    rows = rows.unionByName(candidates.where(F.col("method") != baseline), allowMissingColumns=True)
    of = lambda *names: F.coalesce(*[F.col(c) for c in names if c in rows.columns], F.lit(None).cast("double"))
    rows = rows.withColumns({"_mean": of("steady_mean_step_ms", "mean_step_ms"), "_p95": of("steady_p95_step_ms", "p95_step_ms")})
    held = ["_mean", "_p95", *metrics]
    base = rows.where(F.col("method") == baseline).select(*[F.col(c).alias(f"_full_{c}") for c in held])
    timed = F.when(F.col("_full__mean").isNull(), F.raise_error(F.lit(f"{baseline} has no mean"))).otherwise(F.col("_full__mean"))
    mean = F.coalesce("_mean", F.lit(0.0))
    speed = F.when((F.col("status") == "ok") & (mean > 0), timed / F.nullif(mean, F.lit(0.0))).otherwise(0.0)
    return rows.join(F.broadcast(base)).select(  # one row
        "method", role_of().alias("role"), "status", mean.alias("steady_mean_step_ms"), timed.alias("full_steady_mean_step_ms"), speed.alias("speedup_vs_full"),
        F.coalesce("_p95", F.lit(0.0)).alias("steady_p95_step_ms"), F.col("_full__p95").alias("full_steady_p95_step_ms"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counters],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in RATES if c in rows.columns and c not in counters], *metrics, *[(F.col(m) - F.col(f"_full_{m}")).alias(f"delta_{m}") for m in metrics],
    )


def lookup(rows: DataFrame, on: str, methods: list[str], metrics: list[str]) -> DataFrame:
    """A row for each `on` (a workload, an interval, a seed) with each method's metrics side by side: method_metric."""
    return rows.where(F.col("method").isin(methods)).groupBy(on).agg(*[F.first(F.when(F.col("method") == m, F.col(x)), True).alias(f"{m}_{x}") for m in methods for x in metrics])


def sensitivity(rows: DataFrame, down: str, across: str, metric: str) -> DataFrame:
    """A matrix of a metric by two parameters: a row for each value of `down`, a column for each of `across`."""
    return rows.groupBy(down).pivot(across).agg(F.first(metric))


def extremes(rows: DataFrame, value: str) -> DataFrame:
    """Mean, 95th percentile, least and largest of a column, as one row."""
    return rows.agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.min(value).alias("min"), F.max(value).alias("max"))


def by_method(rows: DataFrame, metrics: list[str], key: str = "method") -> DataFrame:
    """Mean and population deviation of each metric."""
    return rows.groupBy(key).agg(*[x for m in metrics for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))])


def latency(steps: DataFrame, key: str, value: str, step: str) -> DataFrame:
    """Mean and 95th percentile, with and without the first step."""
    first = F.min(step)
    steady = steps.join(steps.groupBy(key).agg(first.alias("_f")), key).withColumn("_s", F.when(F.col(step) > F.col("_f"), F.col(value)))
    q = lambda c: F.round(F.percentile(c, F.lit(0.95)), 6)
    return steady.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(value).alias("p95"), F.round(F.avg("_s"), 6).alias("steady_mean"), q("_s").alias("steady_p95"))


def paired(rows: DataFrame, on: str, a: str, b: str, metric: str) -> DataFrame:
    """Two methods' values side by side for each seed or interval."""
    return rows.where(F.col("method").isin(a, b)).groupBy(on).pivot("method", [a, b]).agg(F.first(metric))


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """Traces, summaries and configurations as CSV or JSON."""
    (df.write.mode("overwrite").option("header", "true").csv if kind == "csv" else df.write.mode("overwrite").json)(path)
