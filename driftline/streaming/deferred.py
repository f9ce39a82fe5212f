"""The deferred method as two streaming queries that meet in tables: a gate and its maintenance.

The gate keeps no state.  Each of its micro-batches reads the newest version of the
representatives and decides its arrivals in column expressions: sure ones take the nearest
cluster, the others are noise until a commit.  Maintenance follows the table of decisions;
a stream is due when it holds an unsure arrival or batch_size of them, and is then
clustered afresh from all its arrivals.  Its labels and representatives become a version,
which later micro-batches see and earlier decisions don't.

A table's part is written aside and moved into place as a whole (one rename, atomic on a
file system that has such), named by its micro-batch, and isn't written again when the
micro-batch is repeated after a restart.  So a decision stands once it is made.

Defined cases: a stream without representatives waits ("warmup"); a stream whose fit is all
noise keeps none; arrivals repeated in the source are decided each.
"""

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import vector as V
from ..operators import density
from ..operators.neighbours import FEW_BYTES
from ..plans.methods import Config, repair

DECISIONS = "stream_id string, seq long, embedding array<float>, version long, nearest long, pred long, action string"
LABELS = "stream_id string, seq long, pred long, upto long"
REPS = "stream_id string, label long, n long, rep array<float>"


@dataclasses.dataclass
class Deferred:
    """The tables below `folder`, which driver and executors share: decisions, labels, reps, and the queries' checkpoints."""

    spark: SparkSession
    folder: str
    config: Config = Config()

    def __post_init__(self):
        for name in ("decisions", "labels", "reps", "aside"):
            self._fs(name).mkdirs(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/aside/{name}")
        if not self._fs(name).rename(self._path(f"aside/{name}"), self._path(name)):
            raise OSError(f"{self.folder}/{name} could not be moved into place")

    def _there(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def table(self, name: str, schema: str, part: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {part} long").parquet(f"{self.folder}/{name}")

    def version(self) -> int:
        """The newest version of the representatives, -1 before the first; read from the names of its parts."""
        parts = [s.getPath().getName() for s in self._fs("reps").listStatus(self._path("reps"))]
        return max((int(p.removeprefix("version=")) for p in parts if p.startswith("version=")), default=-1)

    def reps(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], REPS)
        return self.spark.read.schema(REPS).parquet(f"{self.folder}/reps/version={version}")

    def decide(self, points: DataFrame) -> DataFrame:
        """The decisions of arrivals (stream_id, seq, embedding) by the newest representatives."""
        at, c = self.version(), self.config
        reps = self.reps(at)
        size = reps.agg(F.sum(F.size("rep") * 4 + 32)).first()[0] or 0
        of = reps.groupBy("stream_id").agg(F.collect_list(F.struct("label", "rep")).alias("reps"))
        met = points.select("stream_id", "seq", "embedding").join(F.broadcast(of) if size <= FEW_BYTES else of, "stream_id", "left")
        near = F.array_sort(F.transform("reps", lambda r: F.struct(F.round(V.cosine_distance("embedding", r["rep"]), 9).alias("d"), r["label"].alias("label"))))
        met = met.withColumn("near", near)
        one, two = F.get("near", F.lit(0)), F.get("near", F.lit(1))
        sure = F.coalesce(V.confident(one["d"], two["d"], c.max_distance, c.margin), F.lit(False))
        action = F.when(F.col("near").isNull(), "warmup").when(sure, "buffer").otherwise("risk_flush")
        return met.select("stream_id", "seq", "embedding", F.lit(at).cast("long").alias("version"), one["label"].alias("nearest"), F.when(sure, one["label"]).otherwise(F.lit(-1).cast("long")).alias("pred"), action.alias("action"))

    def gate(self, points: DataFrame, **trigger) -> StreamingQuery:
        """The running gate over a streaming frame of (stream_id, seq, embedding)."""

        def batch(df: DataFrame, i: int) -> None:
            if not self._there(f"decisions/batch={i}"):
                self._put(self.decide(df), f"decisions/batch={i}")

        return points.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/gate").trigger(**trigger).start()

    def due(self, upto: int) -> DataFrame:
        """stream_id of the streams that are clustered afresh: long enough, with an unsure arrival since their last labels or batch_size of any kind."""
        c = self.config
        labelled = self.table("labels", LABELS, "version").groupBy("stream_id", "version").agg(F.count("*").alias("labelled"), F.max("upto").alias("upto"))
        labelled = labelled.groupBy("stream_id").agg(F.max_by("labelled", "version").alias("labelled"), F.max("upto").alias("upto"))
        counts = self.table("decisions", DECISIONS, "batch").where(F.col("batch") <= upto).groupBy("stream_id", "batch").agg(F.count("*").alias("n"), F.max(F.when(F.col("action") == "risk_flush", F.col("batch"))).alias("risk"))
        counts = counts.groupBy("stream_id").agg(F.sum("n").alias("n"), F.max("risk").alias("risk"))
        held = counts.join(labelled, "stream_id", "left").withColumn("held", F.col("n") - F.coalesce("labelled", F.lit(0)))
        unsure = F.col("risk") > F.coalesce("upto", F.lit(-1))
        return held.where((F.col("n") >= c.tradeoff_warmup) & (unsure | (F.col("held") >= c.batch_size))).select("stream_id")

    def fit(self, arrivals: DataFrame, upto: int) -> DataFrame:
        """stream_id, seq, pred, upto of whole streams until a micro-batch, each a task's bounded work."""
        c = self.config

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq")
            x = np.stack(pdf["embedding"].to_list()).astype(np.float32)
            labels = density.cluster(x, "fishdbc", c.least, c.k)
            return pdf[["stream_id", "seq"]].assign(pred=repair(x, labels) if c.repair else labels, upto=upto)

        return arrivals.select("stream_id", "seq", "embedding").groupBy("stream_id").applyInPandas(run, LABELS)

    def commit(self, version: int, upto: int) -> None:
        """The version of the decisions up to a micro-batch: labels first, so that representatives imply them."""
        if self._there(f"reps/version={version}"):
            return
        decisions = self.table("decisions", DECISIONS, "batch").where(F.col("batch") <= upto)
        if not self._there(f"labels/version={version}"):
            self._put(self.fit(decisions.join(self.due(upto), "stream_id", "left_semi"), upto), f"labels/version={version}")
        labels = self.spark.read.schema(LABELS).parquet(f"{self.folder}/labels/version={version}")
        placed = decisions.select("stream_id", "seq", "embedding").join(labels.where("pred >= 0"), ["stream_id", "seq"])
        sums = placed.select("stream_id", F.col("pred").alias("label"), F.posexplode("embedding").alias("pos", "v")).groupBy("stream_id", "label", "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
        mean = sums.groupBy("stream_id", "label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"))
        new = mean.withColumn("s", F.transform("l", lambda x: x["s"])).select("stream_id", "label", "n", V.unit("s").alias("rep"))
        kept = self.reps(self.version()).join(labels.select("stream_id").distinct(), "stream_id", "left_anti")
        self._put(kept.unionByName(new), f"reps/version={version}")

    def maintenance(self, **trigger) -> StreamingQuery:
        """The running maintenance; its micro-batches are the versions."""

        def batch(df: DataFrame, i: int) -> None:
            upto = df.agg(F.max("batch")).first()[0]
            if upto is not None:
                self.commit(i, upto)

        src = self.spark.readStream.schema(f"{DECISIONS}, batch long").parquet(f"{self.folder}/decisions")
        return src.select("stream_id", "batch").writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/maintenance").trigger(**trigger).start()

    def labels(self) -> DataFrame:
        """stream_id, seq, pred: a stream's newest labels; the gate's for arrivals since."""
        each = self.table("labels", LABELS, "version")
        newest = each.groupBy("stream_id", "seq").agg(F.max_by("pred", "version").alias("committed"))
        return self.table("decisions", DECISIONS, "batch").join(newest, ["stream_id", "seq"], "left").select("stream_id", "seq", F.coalesce("committed", "pred").alias("pred"))
