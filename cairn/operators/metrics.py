"""Statistics: output sizes, histograms, operation counters, reduction over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_stats(kv: DataFrame) -> DataFrame:
    """One row (num_keys, num_dropped_keys, key_bytes, value_bytes, total_user_data)."""
    per = kv.groupBy("epoch", "key").agg(F.count("*").alias("c"), F.sum(F.octet_length("key")).alias("k"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("v"))
    return per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("num_keys"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("num_dropped_keys"),
        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("key_bytes"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("value_bytes"), F.coalesce(F.sum(F.col("k") + F.col("v")), F.lit(0)).cast("long").alias("total_user_data"),
    )


def histogram(df: DataFrame, value: Column, most: int = 9) -> DataFrame:
    """(bucket, n): counts of each value, ``most`` and more together."""
    return df.groupBy(F.least(value, F.lit(most)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def cumulative(buckets: DataFrame) -> DataFrame:
    """(bucket, n, cum, total) of a histogram, which has a bounded number of rows."""
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.select("bucket", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))


def summarised(df: DataFrame, value: Column, most: int = 9) -> DataFrame:
    """(bucket, n, cum, total, mean, most): the histogram of a figure with its mean and maximum."""
    both = df.agg(F.avg(value).alias("mean"), F.max(value).cast("long").alias("most"))
    return cumulative(histogram(df, value, most)).crossJoin(F.broadcast(both))  # one row


def op_counts(calls: DataFrame, op: str, ok: Column) -> DataFrame:
    """(op, n, n_ok): calls and successful calls of each operation."""
    return calls.groupBy(F.col(op).alias("op")).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))


def reduced(df: DataFrame, rank: Column, duration: Column, ops: Column, errors: Column) -> DataFrame:
    """(rank, duration, ops, errors): the longest duration and the sums of each rank."""
    return df.groupBy(rank.alias("rank")).agg(F.max(duration).alias("duration"), F.sum(ops).alias("ops"), F.sum(errors).alias("errors"))


def gaps(df: DataFrame, by: list[str], time: Column, order: list[str]) -> DataFrame:
    """``df`` with ``gap``: microseconds since the write before, null for the first."""
    before = Window.partitionBy(*by).orderBy(*order)
    micros = F.unix_micros(time.cast("timestamp"))
    return df.withColumn("gap", micros - F.lag(micros).over(before))
