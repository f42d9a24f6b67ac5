"""The storage engines that a table can be written with, chosen by name: ``default``, ``plaindb``, ``leveldb``, ``leveldb-l0``,
``leveldb-l0-bloom``, ``rangedb`` and ``nothing``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import keyvalue, membership
from cairn.operators.prefix import running
from cairn.operators.ranges import RangeTable
from cairn.plans.errors import InvalidArgument, NotSupported
from cairn.plans.options import Options
from cairn.sources.epoch_table import EpochReader, EpochWriter, exists


def _rows(df: DataFrame) -> DataFrame:
    """(key, value, seq) as binaries and a long."""
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), seq.alias("seq"))


class PlainTable:
    """Rows in the order of writing, in blocks of ``block_size`` bytes, each block with a Bloom filter of its keys.

    ``rows/batch=B`` holds (block, seq, key, value), ``blocks/batch=B`` the filters. A key has the first value ever written.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path, (options or Options()).clamped()
        self.batch = 0 if not exists(spark, f"{path}/rows") else 1 + spark.read.parquet(f"{path}/rows").agg(F.max("batch")).first()[0]

    def put(self, df: DataFrame) -> None:
        rows = _rows(df)
        size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
        placed = running(rows, ["seq"], size, "__at").withColumn("block", F.floor(F.col("__at") / self.options.block_size)).drop("__at")
        placed.repartitionByRange("block").sortWithinPartitions("block", "seq").write.mode("overwrite").parquet(f"{self.path}/rows/batch={self.batch}")
        back = self.spark.read.parquet(f"{self.path}/rows/batch={self.batch}")
        filters = membership.build_filters(back.select("block", "key"), ["block"], "bloom", bits_per_key=self.options.bf_bits_per_key)
        filters.write.mode("overwrite").parquet(f"{self.path}/blocks/batch={self.batch}")
        self.batch += 1

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def blocks_for(self, key: bytes) -> DataFrame:
        """(batch, block): the blocks whose filter lets a key through."""
        filters = self.spark.read.parquet(f"{self.path}/blocks")
        asked = filters.select("batch", "block").distinct().withColumn("key", F.lit(bytearray(key)).cast("binary"))
        return membership.probe(asked, filters, ["batch", "block"], "bloom", bits_per_key=self.options.bf_bits_per_key).select("batch", "block")

    def plan_get(self, key: bytes) -> DataFrame:
        """One row (key, value), read from the blocks that may hold the key and no others."""
        near = self.rows().where(F.col("key") == F.lit(bytearray(key))).join(self.blocks_for(key), ["batch", "block"], "left_semi")
        return near.groupBy("key").agg(F.min_by("value", F.struct("batch", "seq")).alias("value"))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """(key, value) of each key; a join reads the rows once, whatever the filters say."""
        keys = keys.select(F.col("key").cast("binary").alias("key")).distinct()
        found = self.rows().join(keys, "key", "left_semi").groupBy("key").agg(F.min_by("value", F.struct("batch", "seq")).alias("value"))
        return keys.join(found, "key", "left")


class LevelTable:
    """Runs of an epoch, one for each flush; in an epoch the last value of a key counts, values of epochs are joined in order.

    ``compaction`` merges the runs of an epoch into one when it ends; without it they stay as they were flushed (level 0).
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, compaction: bool = True, bloom: bool = False):
        self.spark, self.path, self.options = spark, path, (options or Options()).clamped()
        self.compaction, self.bloom = compaction, bloom
        self.epoch, self.run = 0, 0

    def _write(self, rows: DataFrame, place: str) -> None:
        writer = rows.hint("rebalance").sortWithinPartitions("key", "seq").write.mode("overwrite")
        if self.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(f"{self.path}/{place}")

    def put(self, df: DataFrame) -> None:
        """Write rows as the next run of the epoch: rows of a later run are later."""
        self._write(keyvalue.last_kept(_rows(df), ("key",)), f"rows/epoch={self.epoch}/run={self.run}")
        self.run += 1

    def epoch_flush(self) -> None:
        if self.compaction and self.run > 1:
            own = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/epoch={self.epoch}")
            merged = own.groupBy("key").agg(F.max_by(F.struct("value", "seq"), F.struct("run", "seq")).alias("x")).select("key", "x.value", "x.seq")
            self._write(merged, f"merged/epoch={self.epoch}/run=0")
            for r in range(self.run):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/epoch={self.epoch}/run={r}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.epoch, self.run = self.epoch + 1, 0

    def rows(self) -> DataFrame:
        parts = [f"{self.path}/{x}" for x in ("rows", "merged") if exists(self.spark, f"{self.path}/{x}")]
        schema = "key binary, value binary, seq long, epoch int, run int"
        frames = [self.spark.read.schema(schema).parquet(p) for p in parts]
        return frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0] if frames else self.spark.createDataFrame([], schema)

    def get_many(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, value) of each key of ``keys``, or of all keys."""
        rows = self.rows()
        if keys is not None:
            rows = rows.join(keys.select(F.col("key").cast("binary").alias("key")).distinct(), "key", "left_semi")
        last = rows.groupBy("epoch", "key").agg(F.max_by("value", F.struct("run", "seq")).alias("value"))
        return keyvalue.values_joined(last.withColumn("seq", F.lit(0)))


class NothingTable:
    """Takes all rows, runs their plan and keeps none; reads are not supported."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame) -> None:
        df.write.format("noop").mode("append").save()

    def rows(self) -> DataFrame:
        raise NotSupported("this engine keeps nothing")


ENGINES = {
    "default": EpochWriter,
    "plaindb": PlainTable,
    "leveldb": lambda spark, path, options=None: LevelTable(spark, path, options),
    "leveldb-l0": lambda spark, path, options=None: LevelTable(spark, path, options, compaction=False),
    "leveldb-l0-bloom": lambda spark, path, options=None: LevelTable(spark, path, options, compaction=False, bloom=True),
    "rangedb": lambda spark, path, options=None: RangeTable(spark, path, skip_sort=(options or Options()).skip_sort),
    "nothing": NothingTable,
}
READERS = {"default": EpochReader, "plaindb": PlainTable, "leveldb": LevelTable, "leveldb-l0": LevelTable, "leveldb-l0-bloom": LevelTable, "rangedb": RangeTable, "nothing": NothingTable}


def create(spark: SparkSession, path: str, engine: str = "default", options: Options | None = None):
    """A table to write with the engine of that name."""
    if engine not in ENGINES:
        raise InvalidArgument(f"no engine {engine}; there are {', '.join(ENGINES)}")
    return ENGINES[engine](spark, path, options)


def open_table(spark: SparkSession, path: str, engine: str = "default"):
    """A table to read that was written with the engine of that name."""
    if engine not in READERS:
        raise InvalidArgument(f"no engine {engine}; there are {', '.join(READERS)}")
    return READERS[engine](spark, path)
