"""Membership filters built and probed at scale: one filter for each bounded share of a table's keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import from_le32
from cairn.functions.sketches import FILTERS, Cuckoo

MOST_KEYS = 1 << 20
KEYS_A_TASK = 1 << 18
WORDS = 1024  # of 32 bits in a bitmap of 4096 bytes
REGISTRY: dict[str, Callable] = dict(FILTERS)


def register(kind: str, factory: Callable) -> None:
    """Make a filter kind known: ``factory(**options)`` has ``build(keys) -> bytes`` and ``matches(data, keys) -> bools``."""
    REGISTRY[kind] = factory


def _dealt(keys: DataFrame, by: list[str], most: int) -> DataFrame:
    """``keys`` with shares and share: as many shares for each group as keep each below ``most`` rows."""
    sizes = keys.groupBy(*by).agg(F.ceil(F.count("*") / (most / 2)).cast("int").alias("shares"))
    sized = keys.join(sizes, by) if by else keys.crossJoin(F.broadcast(sizes))  # one row where there is one group
    return sized.withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))


def _built(rows: DataFrame, by: list[str], most: int, build: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[:1][[*by, "shares", "share"]].copy()
        head["n"], head["filter"] = len(group), [build(group)]
        return head

    return _dealt(rows, by, most).groupBy(*by, "shares", "share").applyInPandas(one, f"{kinds}{', ' if by else ''}shares int, share int, n long, filter binary")


def build_filters(keys: DataFrame, by: list[str], kind: str = "bloom", most: int = MOST_KEYS, **options) -> DataFrame:
    """(by, shares, share, n, filter) from (by, key), repeats counting once: as many filters for each group as keep each below ``most`` keys."""
    own = REGISTRY[kind](**options)
    keys = keys.select(*by, F.col("key").cast("binary").alias("key")).distinct()
    return _built(keys, by, most, lambda group: own.build([bytes(k) for k in group["key"]]))


def build_value_filters(rows: DataFrame, by: list[str], value: str, mark_bits: int = 8, value_bits: int = 24, most: int = MOST_KEYS) -> DataFrame:
    """(by, shares, share, n, filter): cuckoo filters of (by, key) that hold the integers of ``value`` with their keys."""
    own = Cuckoo(mark_bits, value_bits)
    rows = rows.select(*by, F.col("key").cast("binary").alias("key"), F.col(value).cast("long").alias("value")).distinct()
    return _built(rows, by, most, lambda group: own.build_values((bytes(k), int(v)) for k, v in zip(group["key"], group["value"], strict=True)))


def written(filters: DataFrame, path: str) -> DataFrame:
    """The same filters from Parquet files, so that they are built once however often they are read; a few large ones to a row group."""
    sizes = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    filters.write.options(**sizes).parquet(path)
    return filters.sparkSession.read.schema(filters.schema).parquet(path)


def _asked(keys: DataFrame, filters: DataFrame, by: list[str], opened: Callable, answer: Callable, extra: str = "") -> DataFrame:
    """``answer(opened filter, batch of keys)`` gives (places of the keys, columns besides): each filter meets its keys in as many
    places as keep each below ``KEYS_A_TASK`` keys. The filters are read twice: they should be written ones (``written``)."""
    keys = keys.select(*by, F.col("key").cast("binary").alias("key"))
    sizes = filters.select(*by, "shares").distinct()
    joined = keys.join(sizes, by) if by else keys.crossJoin(F.broadcast(sizes))  # one row where there is one group
    asked = joined.withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int"))
    salts = asked.groupBy(*by, "share").agg(F.ceil(F.count("*") / KEYS_A_TASK).cast("int").alias("salts"))
    salts = salts if by else F.broadcast(salts)  # a row for each share of one group
    asked = asked.join(salts, [*by, "share"]).withColumn("salt", F.pmod(F.hash("key"), F.col("salts")))
    asked = asked.select(*by, "share", "salt", F.lit(None).cast("binary").alias("filter"), "key")
    held = filters.join(salts, [*by, "share"]).select(*by, "share", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter", F.lit(None).cast("binary").alias("key"))
    place = [*by, "share", "salt"]
    dealt = held.union(asked).repartition(*place).sortWithinPartitions(*place, F.col("filter").desc_nulls_last())
    k = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(k + 2)), strict=True))
            filters, asked = batch.column(k + 2), batch.column(k + 3).to_pylist()
            rows, more = [], []
            at, n = 0, batch.num_rows
            while at < n:
                if filters[at].is_valid:
                    place, held = groups[at], opened(filters[at].as_py())
                    at += 1
                    continue
                stop = at + 1
                while stop < n and groups[stop] == groups[at] and not filters[stop].is_valid:
                    stop += 1
                if groups[at] == place:
                    places, columns = answer(held, asked[at:stop])
                    rows.append(np.asarray(places, dtype=np.int64) + at)
                    more.append(columns)
                at = stop
            out = batch.take(pa.array(np.concatenate(rows) if rows else [], pa.int64())).select([*range(k), k + 3])
            for name, kind in (x.split() for x in extra.split(", ") if x):
                kind = pa.int64() if kind == "long" else pa.string()
                out = out.append_column(name, pa.concat_arrays([pa.array(columns, kind) for columns in more] or [pa.array([], kind)]))
            yield out

    kinds = [*(f"{c} {keys.schema[c].dataType.simpleString()}" for c in by), "key binary", *([extra] if extra else [])]
    return dealt.mapInArrow(run, ", ".join(kinds))


def probe(keys: DataFrame, filters: DataFrame, by: list[str], kind: str = "bloom", **options) -> DataFrame:
    """(by, key) of the keys that their group's filter lets through; groups without a filter let nothing through."""
    own = REGISTRY[kind](**options)
    opened = own.opened if hasattr(own, "opened") else lambda data: lambda asked: own.matches(data, asked)
    return _asked(keys, filters, by, opened, lambda held, asked: (np.nonzero(held(asked))[0].tolist(), []))


def candidate_values(keys: DataFrame, filters: DataFrame, by: list[str], mark_bits: int = 8, value_bits: int = 24) -> DataFrame:
    """(by, key, value): the values that a cuckoo filter gives for each key: all that were put in, and by chance others."""
    own = Cuckoo(mark_bits, value_bits)
    return _asked(keys, filters, by, own.load, own.pairs_of, "value long")


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): an exact bitmap of integer keys, a row for each bucket of 32768."""
    return keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def bitmap_count(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bitmap_united(bits: DataFrame) -> DataFrame:
    return bits.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def in_bitmap(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Those of ``rows`` whose key is set: a semi-join on the words of 32 keys that have a bit set, each carrying its bits."""
    word = F.explode(F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.struct(i.alias("at"), F.substring(F.col("bits"), i * 4 + 1, F.lit(4)).alias("word"))))
    held = bits.select("bucket", word.alias("x")).where(F.col("x.word") != F.lit(bytearray(4)))
    held = held.select(F.col("bucket").alias("__bucket"), F.col("x.at").alias("__at"), F.conv(F.hex("x.word"), 16, 10).cast("long").alias("__word"))
    bit = F.bitmap_bit_position(key)
    out = rows.withColumns({"__bucket": F.bitmap_bucket_number(key), "__at": F.floor(bit / 32).cast("int")})
    within = (bit % 32).cast("int")
    place = 24 - F.floor(within / 8) * 8 + within % 8  # the first byte of a word is its highest
    return out.join(held, ["__bucket", "__at"]).where(F.getbit(F.col("__word"), place.cast("int")) == 1).drop("__bucket", "__at", "__word")


def le32_domain(keys: DataFrame, bits: int) -> DataFrame:
    """Binary keys with their value as little-endian integers, only those below ``2**bits``."""
    return keys.withColumn("ikey", from_le32(F.col("key"))).where(F.col("ikey") < (1 << bits))
