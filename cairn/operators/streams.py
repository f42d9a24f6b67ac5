"""Side logs (append, read by offset) and block-addressed file streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.prefix import running


def log_offsets(chunks: DataFrame, order: list[str], data: str, by: list[str] | None = None) -> DataFrame:
    """``chunks`` with ``off``: where each begins in the log (bytes); null data has no length."""
    return running(chunks, order, F.coalesce(F.octet_length(data), F.lit(0)).cast("long"), "off", "sum", by)


def pread(log: DataFrame, offset: int, size: int, data: str = "data", by: list[str] | None = None) -> DataFrame:
    """One row (by, data): bytes ``offset`` to ``offset + size`` of a log of (off, data); short at its end."""
    size_of = F.octet_length(data)
    near = log.where((F.col("off") < offset + size) & (F.col("off") + size_of > offset))
    start = F.greatest(F.lit(offset) - F.col("off"), F.lit(0))
    stop = F.least(F.lit(offset + size) - F.col("off"), size_of)
    piece = F.hex(F.substring(F.col(data).cast("binary"), (start + 1).cast("int"), (stop - start).cast("int")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("off", piece.alias("x")))), lambda p: p["x"])
    return near.groupBy(*(by or [])).agg(F.unhex(F.array_join(pieces, "")).alias("data"))


def blocks_of(files: DataFrame, file_id: str, data: Column, size: int = 4096) -> DataFrame:
    """(file_id, seq, off, len, data): files cut into blocks."""
    raw = files.select(F.col(file_id).alias("file_id"), data.cast("binary").alias("raw")).where(F.octet_length("raw") > 0)
    at = F.explode(F.sequence(F.lit(0), F.octet_length("raw") - 1, F.lit(size))).alias("off")
    out = raw.select("file_id", "raw", at).select("file_id", (F.col("off") / size).cast("long").alias("seq"), F.col("off").cast("long").alias("off"), F.substring(F.col("raw"), F.col("off") + 1, F.lit(size)).alias("data"))
    return out.select("file_id", "seq", "off", F.octet_length("data").cast("long").alias("len"), "data")


def read_blocks(blocks: DataFrame, offset: int, size: int) -> DataFrame:
    """(file_id, data): bytes ``offset`` to ``offset + size`` of each file.

    Holes are zero bytes; reads end with the file; where writes overlap, the last one (largest seq) counts, byte by byte.
    Only blocks that overlap the range are gathered. Files that end before ``offset`` give empty data.
    """
    ends = blocks.groupBy("file_id").agg(F.max(F.col("off") + F.col("len")).alias("end"))
    near = blocks.where((F.col("off") < offset + size) & (F.col("off") + F.col("len") > offset))
    cut = F.greatest(F.lit(offset) - F.col("off"), F.lit(0))
    length = (F.least(F.col("off") + F.col("len"), F.lit(offset + size)) - F.greatest("off", F.lit(offset))).cast("int")
    near = near.select("file_id", "seq", F.greatest(F.col("off") - offset, F.lit(0)).cast("int").alias("at"), F.substring(F.col("data"), (cut + 1).cast("int"), length).alias("piece"))
    pieces = near.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "piece"))).alias("pieces"))
    out = ends.join(pieces, "file_id", "left")
    want = F.greatest(F.least(F.col("end") - offset, F.lit(size)), F.lit(0)).cast("int")
    blank = F.unhex(F.repeat(F.lit("00"), want))
    laid = F.aggregate(F.coalesce("pieces", F.array().cast("array<struct<seq:bigint,at:int,piece:binary>>")), blank, lambda b, p: F.overlay(b, p["piece"], p["at"] + 1, F.octet_length(p["piece"])))
    return out.select("file_id", laid.alias("data"))


def headers(writes: DataFrame, file_id: str, mtime: str, size: str) -> DataFrame:
    """(file_id, mtime, size): the latest time and largest size that any writer left."""
    return writes.groupBy(F.col(file_id).alias("file_id")).agg(F.max(mtime).alias("mtime"), F.max(size).alias("size"))


class FilterLog:
    """A log of filters: ``epoch=E`` holds what one epoch flush wrote, as built by ``membership.build_filters`` by epoch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, filters: DataFrame) -> None:
        """Write the filters of one epoch or of several; epochs written before are replaced."""
        filters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(self.path)

    def read(self, epoch: int) -> DataFrame:
        """(epoch, shares, share, n, filter) of one epoch; no row for an epoch without one."""
        return self.spark.read.schema("shares int, share int, n long, filter binary, epoch int").parquet(self.path).where(F.col("epoch") == epoch)
