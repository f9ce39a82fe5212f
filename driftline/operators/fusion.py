"""Compression of streams to a cap: rounds that fuse the most similar pair of one label of every stream above it.  The small sides are written tables, whose size
Spark knows when it chooses between a broadcast and a shuffle.

A round labels the streams that are above the cap, takes each label's best pair by tiles,
the best of these a stream, and puts the unit sum of the two in place of both; `members`
keeps the arrivals that a row stands for.  Labels may change with every fusion, so a stream
has one fusion a round, and all streams go side by side; the rounds are as many as
the largest excess.  A stream without two rows of one label is left as it is.  Ties go to
the smaller label, then to the earlier rows; a fused row comes after all others of its stream.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import density, neighbours
from .storage import Store


def by_density(rows: DataFrame) -> DataFrame:
    """stream_id, seq, pred of rows with (stream_id, seq, embedding)."""
    return density.cluster_streams(rows.withColumn("label", F.lit(0).cast("long")), "hdbscan").select("stream_id", "seq", "pred")


def fuse(rows: DataFrame, labels: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(rows after one fusion of each stream that has a pair, those streams' stream_id)."""
    named = rows.join(labels.where("pred >= 0"), ["stream_id", "seq"])
    # best_pair takes one number for a label
    keys = store(named.select("stream_id", "pred").distinct().withColumn("key", F.monotonically_increasing_id()))
    pair = neighbours.best_pair(store(named.join(keys, ["stream_id", "pred"]).select(F.col("key").alias("label"), F.col("seq"), "embedding")))
    best = pair.join(keys.withColumnRenamed("key", "label"), "label").groupBy("stream_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "pred", "i", "j")).alias("m"))
    best = store(best.select("stream_id", "m.i", "m.j"))
    sides = rows.join(best, "stream_id")
    last = rows.join(best, "stream_id", "left_semi").groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"))
    two = sides.where("seq = i or seq = j").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "embedding", "members"))).alias("p"))
    one = two.select("stream_id", V.fused(F.col("p")[0]["embedding"], F.col("p")[1]["embedding"]).alias("embedding"), F.concat(F.col("p")[0]["members"], F.col("p")[1]["members"]).alias("members"))
    gone = best.select("stream_id", F.explode(F.array("i", "j")).alias("seq"))
    kept = rows.join(gone, ["stream_id", "seq"], "left_anti")
    return store(kept.unionByName(one.join(last, "stream_id").select("stream_id", "seq", "embedding", "members"))), best.select("stream_id")


def compress(points: DataFrame, cap: int, label_of: Callable[[DataFrame], DataFrame] = by_density) -> DataFrame:
    """stream_id, seq, embedding, members array<long>: streams of `cap` rows at most, or without a pair to fuse.

    label_of gets rows of (stream_id, seq, embedding, members) and gives stream_id, seq, pred.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    spark, result = points.sparkSession, Store(points.sparkSession)
    with Store(spark) as store:
        held, done = store(points.select("stream_id", "seq", "embedding", F.array("seq").alias("members"))), []
        while True:
            over = store(held.groupBy("stream_id").count().where(F.col("count") > cap).select("stream_id"))
            done.append(held.join(over, "stream_id", "left_anti"))
            if over.isEmpty():
                break
            rows = store(held.join(over, "stream_id", "left_semi"))
            rows, fused = fuse(rows, store(label_of(rows)), store)
            done.append(rows.join(fused, "stream_id", "left_anti"))
            held = rows.join(fused, "stream_id", "left_semi")
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return result(out)
