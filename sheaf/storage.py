"""Where jobs put what must outlive an executor."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions on one machine that name no shared folder, as in tests.
DEFAULT_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; all executors and the driver see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or DEFAULT_FOLDER


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there and it is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are deleted together, once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)
        self.paths = []
