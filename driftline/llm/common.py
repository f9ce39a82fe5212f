"""Reading tables, shared storage and bounded broadcasts for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many bytes of rows are broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 16 << 20

_tables: dict[str, str] = {}


class Folders:
    """Folders of one run: those that operators write to now, and those of stages that have ended."""

    def __init__(self):
        self.open: list[str] = []
        self.closed: list[str] = []


_run: ContextVar[Folders] = ContextVar("driftline_folders")


def folders() -> Folders:
    """The folders of this thread's run: a thread (or a copied context) has its own, so that runs side by side don't delete each other's tables."""
    if _run.get(None) is None:
        _run.set(Folders())
    return _run.get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only in local mode, where there is one machine, it may be unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/driftline-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", top)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top


def new_path(spark: SparkSession) -> str:
    """A path for a table: in the open `intermediate` folder, else in the session's."""
    top = folders().open[-1] if folders().open else f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}"
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd", path: str | None = None, tidy: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there and survives lost executors.

    tidy: the shuffle files of the writing go at its end, and not when the driver collects its garbage; the table stands for them.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    with tidied(spark) if tidy else nullcontext():
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As `written`, in buckets by a column, one for each shuffle partition: grouping by the column needs no shuffle of this table then."""
    spark = df.sparkSession
    path = new_path(spark)
    name = f"driftline_{path.rsplit('/', 1)[1]}"
    df.write.bucketBy(partitions(spark), column).option("compression", "none").option("path", path).saveAsTable(name)
    _tables[name] = path
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is, and the names of the tables in it."""
    for name in [n for n, p in list(_tables.items()) if p.startswith(path)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        del _tables[name]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """What operators write inside goes at the end; results must have been written to a path of their own by then.

    Inside is a run of its own: its stages delete no tables of stages that were called before it.
    """
    path = new_path(spark)
    mine = Folders()
    mine.open.append(path)
    token = _run.set(mine)
    try:
        yield
    finally:
        _run.reset(token)
        delete(spark, path)


@contextmanager
def stage_tables(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """What operators write inside stays for the stage's result; what earlier stages of this run wrote goes now, unless `docs` reads it.

    A stage's result must be written before the next stage of the run is called, as `docs` of the next is then.
    """
    run = folders()
    read = docs.inputFiles() if run.closed else []
    for path in [p for p in run.closed if not any(p.rsplit("/", 1)[1] in f for f in read)]:
        run.closed.remove(path)
        delete(spark, path)
    path = new_path(spark)
    run.open.append(path)
    try:
        yield
    finally:
        run.open.remove(path)
        run.closed.append(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have written in this session; call it when the results are stored."""
    for t in spark.catalog.listTables(pattern="driftline_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    delete(spark, f"{shared_dir(spark)}/driftline/{spark.sparkContext.applicationId}")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its rows, written as JSON, have at most `most` bytes, else as it is.

    `df` is computed once more for it: it should be a written table or little work.
    """
    if df.limit(most // 8 + 1).count() > most // 8:
        return df
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= most else df
