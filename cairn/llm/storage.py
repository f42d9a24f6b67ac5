"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.session import ensure_checkpoint_dir


class Scratch:
    """A folder of Parquet tables below ``spark.checkpoint.dir`` for one run of an operator.

    A written table survives lost executors and is read back with fresh statistics. Before it returns, an operator drops all
    tables but those that its result still reads (``keep``); these belong to whoever cleans the checkpoint folder, as with
    ``DataFrame.checkpoint``.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these."""
        self.drop(*(t for t in self.tables if all(t is not x for x in tables)))
