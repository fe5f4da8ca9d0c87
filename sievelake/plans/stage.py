"""Cuts a long plan: rows of a part go to a table in the session's shared folder and are read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only on one machine, where it is unset, a folder of that machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


class Stage:
    """Tables of one job. Each is computed once, whatever reads it; ``drop`` removes what nothing reads any more, the rest goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str = "stage"):
        self.spark, self.root = spark, f"{shared_folder(spark)}/sievelake/{name}-{uuid.uuid4().hex}"
        self.n = 0
        files, path = self._at("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.n += 1
        name = name or f"t{self.n}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._at(name)
            files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, so that neither its plan nor its work is repeated."""
    return Stage(df.sparkSession).keep(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt evenly over tasks, or by keys, for work that costs far more than its rows' bytes: scans are cut by bytes, so small rows make few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, but where the session has settings of its own: Python holds a batch several times over."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "256"), ("spark.sql.execution.arrow.maxBytesPerBatch", f"{4 << 20}")):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, most)
