"""Runs of methods and the tables made of them: summaries, traces, sweeps over rates and seeds, presets, files."""

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.storage import Store
from . import reports
from .methods import METHODS, Config, measured, replay

KEYS = ("stream_id", "method")

#: Presets: methods and what differs from the default configuration.
PRESETS = {
    "smoke": (["full_hdbscan", "adaptive_fishdbc_async", "fishdbc", "window_hdbscan", "diart_style"], {}),
    "full_baseline": (["full_hdbscan"], {}),
    "rerun": (["full_hdbscan", "fishdbc", "adaptive_fishdbc", "adaptive_fishdbc_async", "ahc", "sc_pna", "diart_style"], {"tradeoff_warmup": 20, "batch_size": 4, "least": 3}),
    "async": (["adaptive_fishdbc_async", "fishdbc"], {"tradeoff_warmup": 20, "batch_size": 4, "least": 3, "checkpoint": 80}),
    "all": (list(METHODS), {}),
}


def preset(name: str) -> tuple[list[str], Config]:
    methods, changes = PRESETS[name]
    return methods, Config(**changes)


def with_quality(summaries: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The summaries with the quality of their final labels in place of these; null for failed methods.

    They are written first: each figure reads the labels, and the methods run once.
    """
    summaries = Store(summaries.sparkSession)(summaries)
    final = summaries.select(*keys, F.inline("final"))
    scored = metrics.quality(final, keys).join(metrics.accuracy(final, keys), list(keys))
    points = F.size(F.coalesce("final", F.array().cast("array<struct<seq:long,label:long,pred:long>>"))).cast("long")
    return summaries.withColumn("evaluation_points", points).drop("final").join(scored, list(keys), "left")


def run(points: DataFrame, methods: list[str], config: Config = Config()) -> DataFrame:
    """A summary row for each (stream, method), quality included; a failed method has its error and the rest is null."""
    return with_quality(measured(points, methods, config))


def trace(points: DataFrame, methods: list[str], config: Config = Config()) -> DataFrame:
    """A row for each checkpoint: step, action, counters, points that are evaluated, clusters and quality; the last one's action is `finalize`."""
    rows = Store(points.sparkSession)(replay(points, methods, config))
    by = (*KEYS, "step")
    held = [c for c in rows.columns if c not in (*by, "seq", "label", "pred", "action", "last")]
    per = rows.groupBy(*by).agg(F.first(F.when(F.col("last"), "finalize").otherwise(F.col("action"))).alias("action"), F.count("*").alias("evaluation_points"), *[F.first(c).alias(c) for c in held])
    return per.join(metrics.quality(rows, by), list(by)).join(metrics.accuracy(rows, by), list(by))


def rate_sweep(points: DataFrame, intervals: list[float], methods: list[str], config: Config = Config(), maintenance_ms: float = 10.0) -> DataFrame:
    """A row for each (interval, stream, method).

    Arrivals come every so many milliseconds of virtual time, and a commit takes `maintenance_ms` of it: it
    becomes visible that many arrivals later, so that faster arrivals meet older representatives.
    """
    lags = [-(-int(maintenance_ms * 1000) // max(1, int(ms * 1000))) if ms > 0 else 1 << 30 for ms in intervals]
    each = F.array(*[F.struct(F.lit(float(ms)).alias("interval_ms"), F.lit(lag).alias("of")) for ms, lag in zip(intervals, lags)])
    # runs of the same lag are the same
    out = measured(points, methods, config, False, list(dict.fromkeys(lags))).select("*", F.inline(each)).where("of = lag").drop("of", "lag")
    return with_quality(out, ("interval_ms", *KEYS)).select(
        "interval_ms", *KEYS, "status", F.col("steady_mean_step_ms").alias("decision_mean_ms"), F.col("steady_p95_step_ms").alias("decision_p95_ms"), "maintenance_ms_total", "maintenance_ms_max",
        "max_pending", "max_queue_depth", "recompute_count", F.col("cluster_accuracy_noise_singletons").alias("acc"), "ari", "nmi", "false_merge_rate",
    )


def reordered(points: DataFrame, seeds: list[int]) -> DataFrame:
    """Each stream once for each seed, its arrivals in that seed's order; stream_id ends in the seed."""
    from pyspark.sql import Window

    each = points.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    order = Window.partitionBy("stream_id", "seed").orderBy(F.xxhash64("seed", "seq"), "seq")
    each = each.withColumn("at", F.row_number().over(order).cast("long") - 1)
    return each.select(F.concat("stream_id", F.lit("/"), F.col("seed").cast("string")).alias("stream_id"), F.col("at").alias("seq"), "embedding", "label", "seed")


SEED_METRICS = ["steady_mean_step_ms", "steady_p95_step_ms", "maintenance_ms_total", "cluster_accuracy_noise_singletons", "ari", "nmi", "false_merge_rate"]


def multi_seed(streams: DataFrame, methods: list[str], config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The summaries of streams that differ by seed, all in parallel, and the mean and population deviation by method."""
    rows = run(streams, methods, config)
    return rows, reports.by_method(rows.where("status = 'ok'"), SEED_METRICS)


def store(spark: SparkSession, points: DataFrame, methods: list[str], config: Config, path: str) -> DataFrame:
    """Runs and writes config (JSON), summary (JSON, CSV without nested columns) and trace (CSV) below `path`; the summaries as read back."""
    spark.createDataFrame([(json.dumps({"methods": methods, **dataclasses.asdict(config)}),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    run(points, methods, config).write.mode("overwrite").json(f"{path}/summary")
    rows = spark.read.json(f"{path}/summary")
    ok = [r.method for r in rows.where("status = 'ok'").select("method").distinct().collect()]
    reports.save(rows, f"{path}/summary_csv", "csv")
    if ok:
        reports.save(trace(points, sorted(ok), config), f"{path}/trace", "csv")
    return rows


def store_sweep(rows: DataFrame, path: str) -> DataFrame:
    """A rate sweep's rows as CSV below `path`/sweep, one a (interval, stream, method); as read back."""
    reports.save(rows, f"{path}/sweep", "csv")
    return rows.sparkSession.read.csv(f"{path}/sweep", header=True, schema=rows.schema)


def store_seeds(rows: DataFrame, path: str) -> DataFrame:
    """The summaries of seeds as CSV (`path`/seeds, one row a stream and method) and JSON (`path`/runs), mean and deviation by method as JSON (`path`/aggregate); the last as read back.

    The aggregate is of the rows as stored, so the methods run once.
    """
    spark = rows.sparkSession
    reports.save(rows, f"{path}/runs")
    runs = spark.read.schema(rows.schema).json(f"{path}/runs")
    reports.save(runs, f"{path}/seeds", "csv")
    aggregate = reports.by_method(runs.where("status = 'ok'"), SEED_METRICS)
    reports.save(aggregate, f"{path}/aggregate")
    return spark.read.schema(aggregate.schema).json(f"{path}/aggregate")
