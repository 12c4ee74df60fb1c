"""Cutting lineage with tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is
    unset, which holds for a single machine (tests) alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = tempfile.mkdtemp(prefix="kinweave-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table of its own in the shared folder: computed once, without
    lineage, and readable after the loss of any executor."""
    return Written(df, what).df


def release(spark: SparkSession) -> None:
    """Lets the cluster delete shuffle files of plans that nothing refers to any
    more; Spark does so only when the driver collects its garbage. For operators
    that have shuffled whole texts: nothing else asks for it."""
    for _ in range(2):  # listeners may still hold a plan during the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


class Written:
    """A written table that can be dropped when its successor stands. plain: without
    dictionaries, which tables of hashes do not profit from."""

    def __init__(self, df: DataFrame, what: str = "table", plain: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{what}-{uuid.uuid4().hex}"
        (df.write.option("parquet.enable.dictionary", "false") if plain else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
