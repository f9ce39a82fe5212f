"""A density model of each stream's warm-up, fitted once and frozen: later arrivals are scored without grouping.

The model is one row a stream: the warm-up's points with their core distances, and for each
cluster the least mutual reachability from a point of it to one outside.  An arrival takes
the cluster of its nearest model point by mutual reachability if it is reached before that.
The rows are broadcast while their counted bytes are few; beyond, arrivals meet them by a
join on the stream, which adaptive execution splits where a stream is hot.  Distances are
Euclidean and rounded to nine places, so that ties go to the smaller seq.

Defined cases: a stream with fewer points than the warm-up has no model and is noise; model
points of label -1 lead to noise; a cluster without anything outside admits every arrival.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import density
from .neighbours import FEW_BYTES

WARMUP = 20


def euclidean(a, b):
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, z: s + z)), 9)


def warm(points: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Each stream's first points; the rank's limit is applied before the shuffle, so that a long stream sends few rows."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
    return points.withColumn("rank", rank).where(F.col("rank") <= warmup).drop("rank")


def fit(points: DataFrame, warmup: int = WARMUP, least: int = 4, k: int = 2) -> DataFrame:
    """The model of each stream's warm-up by the density hierarchy."""
    first = warm(points, warmup)
    return model(first.drop("label").join(density.cluster_streams(first, "hdbscan", least, k).drop("label"), ["stream_id", "seq"]), "pred", warmup, k)


def model(labelled: DataFrame, label: str, warmup: int = WARMUP, k: int = 2) -> DataFrame:
    """stream_id, upto, points array<struct<seq, label, e, core>>, reach map<label, distance> of labelled warm-up points."""
    one = labelled.groupBy("stream_id").agg(F.max("seq").alias("upto"), F.array_sort(F.collect_list(F.struct("seq", F.col(label).cast("long").alias("label"), F.col("embedding").alias("e")))).alias("p")).where(F.size("p") >= warmup)
    kth = lambda x: F.get(F.sort_array(F.transform("p", lambda y: euclidean(x["e"], y["e"]))), F.least(F.lit(k), F.size("p") - 1))
    cored = one.select("stream_id", "upto", F.transform("p", lambda x: F.struct(x["seq"], x["label"], x["e"], kth(x).alias("core"))).alias("points"))
    outside = lambda l: F.filter("points", lambda y: y["label"] != l)
    across = lambda x, l: F.array_min(F.transform(outside(l), lambda y: F.greatest(euclidean(x["e"], y["e"]), x["core"], y["core"])))
    inside = lambda l: F.filter("points", lambda x: x["label"] == l)
    limit = lambda l: F.coalesce(F.array_min(F.transform(inside(l), lambda x: across(x, l))), F.lit(float("inf")))
    labels = F.filter(F.array_distinct(F.transform("points", lambda x: x["label"])), lambda l: l >= 0)
    return cored.withColumn("reach", F.map_from_entries(F.transform(labels, lambda l: F.struct(l.alias("key"), limit(l).alias("value")))))


def few(models: DataFrame) -> bool:
    size = models.agg(F.sum(F.size("points") * (F.size(F.get("points", F.lit(0))["e"]) * 4 + 48))).first()[0]
    return (size or 0) <= FEW_BYTES


def predict(points: DataFrame, models: DataFrame, k: int = 2) -> DataFrame:
    """stream_id, seq, pred, reach: the warm-up's own labels (reach null), then the arrivals scored; noise without a model."""
    met = points.select("stream_id", "seq", "embedding").join(F.broadcast(models) if few(models) else models, "stream_id", "left")
    d = F.transform("points", lambda x: F.struct(euclidean("embedding", x["e"]).alias("d"), x["core"], x["seq"], x["label"]))
    far = met.withColumn("d", F.when(F.col("seq") > F.col("upto"), d))
    own = F.get(F.sort_array(F.transform("d", lambda x: x["d"])), F.lit(k - 1))
    near = F.array_min(F.transform("d", lambda x: F.struct(F.greatest(x["d"], x["core"], F.col("own")).alias("reach"), x["seq"], x["label"])))
    scored = far.withColumn("own", own).withColumn("near", near)
    fitted = F.get(F.filter("points", lambda x: x["seq"] == F.col("seq")), F.lit(0))["label"]
    admitted = (F.col("near.label") >= 0) & (F.col("near.reach") <= F.try_element_at("reach", F.col("near.label")))
    pred = F.when(F.col("points").isNull(), -1).when(F.col("seq") <= F.col("upto"), F.coalesce(fitted, F.lit(-1))).when(admitted, F.col("near.label")).otherwise(-1)
    return scored.select("stream_id", "seq", pred.cast("long").alias("pred"), F.col("near.reach").alias("reach"))
