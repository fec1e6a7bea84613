"""Where intermediate tables live: the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share.

    Where that is unset, a local folder serves a local master only; on a cluster it would be another one on every
    machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="firegrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way; clear() deletes them once what is built on them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, what: str) -> str:
        self.paths.append(shared_dir(self.spark, what))
        return self.paths[-1]

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = self.folder(what)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        self.paths = []
