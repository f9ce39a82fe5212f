"""Command line: runs, sweeps and comparisons over stored streams.

    python -m driftline run --points data/embeddings.parquet --methods fishdbc diart_style --out results
    python -m driftline sweep --points data/embeddings.parquet --preset async --intervals 1 5 10 --out results
    python -m driftline seeds --points data/embeddings.parquet --preset smoke --seeds 1 2 3 --out results
    python -m driftline compare --full full/summary --candidates results/summary --out results

Every field of the configuration is a flag (--batch-size 4, --no-repair).  Summaries are folders that a
run has written, or .json files of one object or a list.
"""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions import vector as V
from .plans import harness, reports
from .plans.methods import METHODS, Config
from .sources import streams

QUALITY = ["cluster_accuracy", "cluster_accuracy_noise_singletons", "ari", "nmi", "false_merge_rate"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftline")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, what in (("run", "summaries and traces"), ("sweep", "arrival intervals"), ("seeds", "orders of several seeds")):
        job = jobs.add_parser(name, help=what)
        job.add_argument("--points", required=True, help="embeddings as Parquet")
        job.add_argument("--npz", action="store_true", help="the points are NPZ files, each a stream")
        job.add_argument("--out", required=True)
        job.add_argument("--preset", choices=sorted(harness.PRESETS))
        job.add_argument("--methods", nargs="+", choices=sorted(METHODS))
        for f in dataclasses.fields(Config):
            flag = f"--{f.name.replace('_', '-')}"
            if isinstance(f.default, bool):
                job.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            else:
                job.add_argument(flag, type=type(f.default))
        if name == "sweep":
            job.add_argument("--intervals", nargs="+", type=float, required=True, help="milliseconds between arrivals")
        if name == "seeds":
            job.add_argument("--seeds", nargs="+", type=int, required=True)
    job = jobs.add_parser("compare", help="summaries against the full method's")
    for flag in ("--full", "--candidates", "--out"):
        job.add_argument(flag, required=True)
    return top


def chosen(args: argparse.Namespace) -> tuple[list[str], Config]:
    """Methods and configuration: the preset's, and over it what flags say."""
    methods, config = harness.preset(args.preset) if args.preset else (list(METHODS), Config())
    said = {f.name: getattr(args, f.name) for f in dataclasses.fields(Config) if getattr(args, f.name) is not None}
    return args.methods or methods, dataclasses.replace(config, **said)


def points(spark: SparkSession, path: str, npz: bool) -> DataFrame:
    """Unit vectors of a Parquet table, or of NPZ files, where a file is a stream."""
    return streams.npz(spark, path).withColumn("embedding", V.unit("embedding")) if npz else streams.stream(spark, path)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs a job and returns what it stored."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftline").getOrCreate()
    if args.job == "compare":
        full, candidates = (streams.summaries(spark, path, not path.endswith(".json")) for path in (args.full, args.candidates))
        there = set(full.columns) & set(candidates.columns)
        counters = [c for c in ("distance_comparisons", "cheap_update_count", "full_trigger_count", "uncertainty_count", "local_update_count") if c in there]
        out = reports.compare_to_full(full, candidates, [q for q in QUALITY if q in there], counters)
        reports.save(out, f"{args.out}/comparison")
        reports.save(spark.read.schema(out.schema).json(f"{args.out}/comparison"), f"{args.out}/comparison_csv", "csv")
        return spark.read.schema(out.schema).json(f"{args.out}/comparison")
    methods, config = chosen(args)
    rows = points(spark, args.points, args.npz)
    if args.job == "run":
        return harness.store(spark, rows, methods, config, args.out)
    if args.job == "sweep":
        return harness.store_sweep(harness.rate_sweep(rows, args.intervals, methods, config), args.out)
    return harness.store_seeds(harness.run(harness.reordered(rows, args.seeds), methods, config), args.out)


if __name__ == "__main__":
    main()
