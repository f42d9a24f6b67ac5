"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import reach_from_workers


SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (the folder may be in a store only Spark can open)."""
    reach_from_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(df: DataFrame, id_col: str, text_col: str, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Only the two columns that count, so that clashing names in a wider table do no harm."""
    return df.select(F.col(id_col).cast("long").alias(id_name), F.col(text_col).cast("string").alias(text_name))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in pieces of at most ``rows``, so that Python objects are made of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
