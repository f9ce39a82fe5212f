"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """A folder of its own below spark.checkpoint.dir; a table written there ends its lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            top = f"file://{tempfile.gettempdir()}/driftline-{spark.sparkContext.applicationId}"
        self.spark, self.path, self.names = spark, f"{top}/{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """As a call, one file a bucket of a column: joins by it don't shuffle this table."""
        n, at = int(self.spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
        df.repartition(n, column).write.bucketBy(n, column).option("path", f"{self.path}/{at}").saveAsTable(f"driftline_{at}")
        self.names.append(f"driftline_{at}")
        return self.spark.table(self.names[-1])

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.drop()
