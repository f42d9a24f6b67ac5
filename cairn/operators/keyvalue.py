"""Operators over rows ``(epoch, seq, key, value)``; keys and values are strings or binaries, ``seq`` is the write order.

Every function is a plan over DataFrames: nothing is collected. Values are joined in two steps, within epochs and then over
epochs, so that a key that is in every epoch has its values gathered by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cairn.operators.prefix import running
from cairn.plans.options import Mode


def epochs_between(kv: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of epochs ``start <= epoch < end``; a missing bound is open."""
    if start is not None:
        kv = kv.where(F.col("epoch") >= start)
    return kv if end is None else kv.where(F.col("epoch") < end)


def one_epoch(kv: DataFrame, epoch: int = -1) -> DataFrame:
    """-1: all epochs."""
    return kv if epoch < 0 else kv.where(F.col("epoch") == epoch)


def _glued(parts: Column, binary: bool) -> Column:
    """One value out of an array of values, in time linear in its length."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), "")) if binary else F.array_join(parts, "")


def values_joined(kv: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("seq",), name: str = "value", count: str | None = None) -> DataFrame:
    """(by, value): all values of a key joined in order of epoch, then of ``order``. Null values add nothing.

    With ``count`` a column of that name has the number of values.
    """
    binary = isinstance(kv.schema["value"].dataType, BinaryType)
    within = F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    partial = kv.where(F.col("value").isNotNull()).groupBy(*by, "epoch").agg(_glued(within, binary).alias("value"), F.count("*").alias("__n"))
    over = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda x: x["value"])
    return partial.groupBy(*by).agg(_glued(over, binary).alias(name), *([F.sum("__n").alias(count)] if count else []))


def first_kept(kv: DataFrame, by: tuple[str, ...] = ("epoch", "key")) -> DataFrame:
    """The first row written of each key and epoch."""
    rest = [c for c in kv.columns if c not in (*by, "seq")]
    out = kv.groupBy(*by).agg(F.min_by(F.struct(*rest), "seq").alias("__x"), F.min("seq").alias("seq"))
    return out.select(*(F.col(c) if c in (*by, "seq") else F.col("__x")[c].alias(c) for c in kv.columns))


def last_kept(kv: DataFrame, by: tuple[str, ...] = ("epoch", "key")) -> DataFrame:
    """The last row written of each key and epoch."""
    rest = [c for c in kv.columns if c not in (*by, "seq")]
    out = kv.groupBy(*by).agg(F.max_by(F.struct(*rest), "seq").alias("__x"), F.max("seq").alias("seq"))
    return out.select(*(F.col(c) if c in (*by, "seq") else F.col("__x")[c].alias(c) for c in kv.columns))


def drop_counts(kv: DataFrame) -> DataFrame:
    """(epoch, kept, dropped): what dropping repeats within an epoch keeps and drops."""
    return kv.groupBy("epoch", "key").agg(F.count("*").alias("c")).groupBy("epoch").agg(F.count("*").alias("kept"), (F.sum("c") - F.count("*")).alias("dropped"))


def applied(kv: DataFrame, mode: Mode) -> DataFrame:
    """Rows as a table of that mode holds them."""
    return kv if mode.multi else first_kept(kv)


def get(kv: DataFrame, key, epoch: int = -1, mode: Mode = Mode.MULTIMAP) -> DataFrame:
    """One row (key, value): the values of one key joined; no row if there is none."""
    rows = one_epoch(kv, epoch).where(F.col("key") == F.lit(key))
    return values_joined(applied(rows, mode))


def get_many(kv: DataFrame, keys: DataFrame, epoch: int = -1, mode: Mode = Mode.MULTIMAP) -> DataFrame:
    """(key, value) of each distinct key of ``keys``; null where there is nothing."""
    keys = keys.select("key").distinct()
    rows = one_epoch(kv, epoch).join(keys, "key", "left_semi")
    return keys.join(values_joined(applied(rows, mode)), "key", "left")


def missing(kv: DataFrame, keys: DataFrame, epoch: int = -1) -> DataFrame:
    """Those of ``keys`` that have no value."""
    return keys.select("key").distinct().join(one_epoch(kv, epoch), "key", "left_anti")


def counts(kv: DataFrame) -> DataFrame:
    return kv.groupBy("epoch").agg(F.count("*").alias("n"))


def scan(kv: DataFrame, epoch: int = -1) -> DataFrame:
    return one_epoch(kv, epoch).select("epoch", "key", "seq", "value")


def ordered(kv: DataFrame, mode: Mode) -> DataFrame:
    """Rows in the order a table of that mode keeps within each of its files."""
    return kv.sortWithinPartitions(*(["epoch", "key", "seq"] if mode.ordered else ["epoch", "seq"]))


def first_match(kv: DataFrame) -> DataFrame:
    """(key, value): the first value ever written, whatever its epoch."""
    return kv.groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def last_wins(kv: DataFrame, stop_at_gap: bool = False) -> DataFrame:
    """(key, value): the last value of each epoch, joined in order of epochs.

    ``stop_at_gap``: only epochs 0, 1, 2, ... up to the first in which the key has nothing.
    """
    rows = last_kept(kv)
    if stop_at_gap:
        place = F.row_number().over(Window.partitionBy("key").orderBy("epoch")) - 1
        rows = rows.withColumn("__place", place).where("epoch = __place").drop("__place")
    return values_joined(rows)


def tables_cut(kv: DataFrame, limit: int, by: tuple[str, ...] = ("part", "epoch")) -> DataFrame:
    """``kv`` with ``tbl``: a new table begins once ``limit`` bytes of keys and values are buffered."""
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
    out = running(kv, ["seq"], size, "__before", "sum", list(by))
    return out.withColumn("tbl", F.floor(F.col("__before") / limit).cast("int")).drop("__before")


def table_stats(kv: DataFrame, by: tuple[str, ...] = ("part", "epoch", "tbl")) -> DataFrame:
    """(by, min_key, max_key, n, key_bytes, value_bytes): what each table's manifest row holds."""
    return kv.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"),
        F.sum(F.octet_length("key")).alias("key_bytes"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0).cast("long")).alias("value_bytes"),
    )


def tables_that_may_hold(stats: DataFrame, key) -> DataFrame:
    """Manifest rows whose key range holds ``key``."""
    return stats.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def rank_sets(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, ranks): exactly the ranks that wrote a key, sorted."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(rank)).alias("ranks"))


def get_by_rank(keys: DataFrame, ranks: DataFrame, kv: DataFrame) -> DataFrame:
    """(key, rank, value): keys looked up only in the ranks that hold them. ``kv`` has rank, epoch, seq, key, value."""
    where = keys.select("key").distinct().join(ranks, "key").select("key", F.explode("ranks").alias("rank"))
    return values_joined(kv.join(where, ["key", "rank"], "left_semi"), by=("key", "rank"))


def prefix_scan(rows: DataFrame, prefix: bytes | str, tail: int = 4) -> DataFrame:
    """Rows whose key is ``prefix`` and ``tail`` more bytes."""
    size = len(prefix.encode() if isinstance(prefix, str) else prefix)
    return rows.where((F.octet_length("key") == size + tail) & F.startswith(F.col("key"), F.lit(prefix)))
