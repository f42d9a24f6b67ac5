"""A table of keys and values written in epochs.

``rows/epoch=E/part=P/*.parquet`` holds (tbl, seq, key, value) sorted by key; ``manifest/epoch=E`` a row for each written
table (part, tbl, min_key, max_key, n, key_bytes, value_bytes); ``filters/epoch=E`` the tables' bitmap filters, if the options ask
for them (Bloom filters are Parquet's own); ``meta`` the options and, once finished, the seal. All files go through Spark, so
that any store Spark can write to will do. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from cairn.functions.scalar import name_key, placed
from cairn.operators import keyvalue, membership
from cairn.plans.errors import AlreadyExists, AssertionFailed, InvalidArgument, NotFound
from cairn.plans.options import Mode, Options, pretty_bool

ROWS = StructType([StructField("tbl", IntegerType()), StructField("seq", LongType()), StructField("key", BinaryType()), StructField("value", BinaryType()), StructField("epoch", IntegerType()), StructField("part", IntegerType())])
FILTERS = "part int, tbl int, shares int, share int, n long, filter binary, epoch int"
MANIFEST = "part int, tbl int, min_key binary, max_key binary, n long, key_bytes long, value_bytes long, epoch int"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _store(spark, path)
    return fs.exists(p)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, 0 if there is none."""
    p, fs = _store(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def destroy(spark: SparkSession, path: str) -> None:
    """Remove a table; only folders that this engine wrote."""
    if not exists(spark, f"{path}/meta"):
        raise NotFound(path)
    p, fs = _store(spark, path)
    fs.delete(p, True)


def _put_meta(spark: SparkSession, path: str, options: Options, epochs: int, sealed: bool) -> None:
    text = json.dumps(asdict(options) | {"mode": options.mode.name, "epochs": epochs, "sealed": sealed})
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _get_meta(spark: SparkSession, path: str) -> tuple[Options, int, bool]:
    if not exists(spark, f"{path}/meta"):
        raise NotFound(path)
    raw = json.loads(spark.read.text(f"{path}/meta").first()[0])
    epochs, sealed = raw.pop("epochs"), raw.pop("sealed")
    return Options(**(raw | {"mode": Mode[raw["mode"]], "storage": tuple(map(tuple, raw["storage"]))})), epochs, sealed


def write_table(kv: DataFrame, path: str, options: Options, epoch: int, tbl: int, overwrite: bool = False) -> None:
    """Write rows (seq, key, value) as one table of an epoch: dealt by part (large parts are split), sorted within files."""
    rows = kv.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("seq").cast("long").alias("seq"))
    rows = rows.where(F.octet_length("key") > 0).withColumns({"epoch": F.lit(epoch), "tbl": F.lit(tbl), "part": placed(F.col("key"), options.parts)})
    if options.mode.drops_repeats:
        rows = keyvalue.first_kept(rows)
    dealt = rows.hint("rebalance", "part")
    if not options.skip_sort:
        dealt = dealt.sortWithinPartitions("part", *(["key", "seq"] if options.mode.ordered else ["seq"]))
    writer = dealt.select("tbl", "seq", "key", "value", "part").write.mode("overwrite" if overwrite else "append").partitionBy("part")
    writer = writer.option("compression", options.compression).option("parquet.page.write-checksum.enabled", "true")
    if options.filter == "bloom" and options.bf_bits_per_key > 0:
        # the false-positive rate of a Bloom filter with so many bits a key
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(max(1e-6, 0.6185**options.bf_bits_per_key)))
    writer.parquet(f"{path}/rows/epoch={epoch}")
    spark = kv.sparkSession
    back = spark.read.schema(ROWS).option("basePath", f"{path}/rows").parquet(f"{path}/rows/epoch={epoch}").where(F.col("tbl") == tbl)
    keyvalue.table_stats(back, ("part", "tbl")).write.mode("overwrite" if overwrite else "append").parquet(f"{path}/manifest/epoch={epoch}")
    if options.filter == "bitmap":
        built = membership.build_filters(back, ["part", "tbl"], f"bitmap-{options.bm_fmt}", key_bits=options.bm_key_bits)
        built.write.mode("overwrite" if overwrite else "append").parquet(f"{path}/filters/epoch={epoch}")


class EpochWriter:
    """``put`` collects plans, ``flush`` writes them as a table, ``epoch_flush`` closes the epoch, ``finish`` seals.

    A flush is done when it returns, unless ``wait=False`` only schedules it; scheduled ones run one after the other, ``wait``
    returns once they are done (and raises what went wrong), ``sync`` flushes, waits and notes the epochs so far in ``meta``.

    Rows come as (key, value) with an optional ``seq`` within one put; puts follow each other in the order of the calls.
    """

    SHIFT = 44  # seq = number of the put << SHIFT | seq within it

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, listeners: tuple[Callable[[str, int, int], None], ...] = ()):
        """``listeners`` are called with (event, epoch, table) as each table's writing starts and ends or fails."""
        if exists(spark, f"{path}/meta"):
            raise AlreadyExists(path)
        self.spark, self.path, self.options = spark, path, (options or Options()).clamped()
        self.epoch, self.tables, self.puts, self.pending, self.done = 0, 0, 0, [], False
        self.pool, self.jobs, self.listeners = ThreadPoolExecutor(max_workers=1), [], listeners
        _put_meta(spark, path, self.options, 0, False)

    def _check(self, epoch: int) -> None:
        if self.done:
            raise AssertionFailed("the table is already finished")
        if epoch not in (-1, self.epoch):
            raise AssertionFailed("Bad epoch num")

    def put(self, df: DataFrame, epoch: int = -1) -> None:
        self._check(epoch)
        own = F.col("seq").cast("long") if "seq" in df.columns else F.monotonically_increasing_id()
        self.pending.append(df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), (own + F.lit(self.puts << self.SHIFT)).alias("seq")))
        self.puts += 1

    def append(self, df: DataFrame, epoch: int = -1, name_col: str = "name") -> None:
        """Rows (name, value): the key is the first bytes of the name's hash."""
        self.put(df.withColumn("key", name_key(F.col(name_col), min(16, max(1, self.options.key_size)))), epoch)

    def flush(self, epoch: int = -1, wait: bool = True) -> None:
        self._check(epoch)
        if self.pending:
            rows = self.pending[0]
            for more in self.pending[1:]:
                rows = rows.unionByName(more)
            self.jobs.append(self.pool.submit(self._write, rows, self.epoch, self.tables))
            self.pending, self.tables = [], self.tables + 1
        if wait:
            self.wait()

    def _write(self, rows: DataFrame, epoch: int, tbl: int) -> None:
        if self.options.mode.drops_repeats and tbl:
            held = self.spark.read.schema(ROWS).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/epoch={epoch}")
            rows = rows.join(held.select("key"), "key", "left_anti")
        self._tell("table_start", epoch, tbl)
        try:
            write_table(rows, self.path, self.options, epoch, tbl)
        except Exception:
            self._tell("table_failed", epoch, tbl)
            raise
        self._tell("table_end", epoch, tbl)

    def _tell(self, event: str, epoch: int, tbl: int) -> None:
        for listener in self.listeners:
            listener(event, epoch, tbl)

    def wait(self) -> None:
        jobs, self.jobs = self.jobs, []
        for job in jobs:
            job.result()

    def sync(self, epoch: int = -1) -> None:
        self.flush(epoch)
        _put_meta(self.spark, self.path, self.options, self.epoch, False)

    def epoch_flush(self, epoch: int = -1, wait: bool = True) -> None:
        self.flush(epoch, wait)
        self.epoch, self.tables = self.epoch + 1, 0
        if wait:
            _put_meta(self.spark, self.path, self.options, self.epoch, False)

    def finish(self) -> None:
        """Write what is pending as the last epoch and seal; further calls do nothing."""
        if self.done:
            return
        if self.pending or self.tables:
            self.epoch_flush()
        self.wait()
        self.done = True
        self.pool.shutdown()
        _put_meta(self.spark, self.path, self.options, self.epoch, True)


class EpochReader:
    """Point and batch reads, scans and counts over any range of epochs. Options come from the table itself."""

    def __init__(self, spark: SparkSession, path: str, num_epochs: int | None = None, paranoid: bool = False, ignore_filters: bool = False):
        self.spark, self.path = spark, path
        self.options, written, self.sealed = _get_meta(spark, path)
        self.ignore_filters = ignore_filters or self.options.ignore_filters
        named = dict(self.options.storage)
        self.verify = (paranoid or self.options.paranoid_checks or pretty_bool(named.get("verify_checksums", "")) is True) and pretty_bool(named.get("skip_checksums", "")) is not True
        self.epochs = written if num_epochs is None else min(written, num_epochs)
        if paranoid and not self.sealed:
            raise InvalidArgument("the table is not finished")

    def rows(self, start: int = 0, end: int | None = None) -> DataFrame:
        end = self.epochs if end is None else min(end, self.epochs)
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], ROWS)
        reader = self.spark.read.schema(ROWS).option("parquet.page.verify-checksum.enabled", str(self.verify).lower())
        if self.ignore_filters:
            reader = reader.option("parquet.filter.bloom.enabled", "false")
        return keyvalue.epochs_between(reader.parquet(f"{self.path}/rows"), max(0, start), end)

    def _of(self, epoch: int) -> DataFrame:
        return self.rows() if epoch < 0 else self.rows(epoch, epoch + 1)

    def manifest(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").where(F.col("epoch") < self.epochs)

    def plan_get(self, key: bytes, epoch: int = -1) -> DataFrame:
        """The rows of a key: one part, epochs in range, tables whose key range and filter may hold it, the key pushed to
        row-group statistics and Bloom filters."""
        here = placed(F.lit(bytearray(key)).cast("binary"), self.options.parts)
        rows = self._of(epoch).where((F.col("part") == here) & (F.col("key") == F.lit(bytearray(key))))
        one = self.spark.range(1).select(F.lit(bytearray(key)).cast("binary").alias("key"))
        return rows.join(self.tables_for(one, epoch).drop("key"), ["epoch", "part", "tbl"], "left_semi")

    def tables_for(self, keys: DataFrame, epoch: int = -1, filtered: bool = True) -> DataFrame:
        """(key, epoch, part, tbl): the tables that may hold each key, by their key ranges and (``filtered``) by their bitmaps."""
        keys = keys.select(F.col("key").cast("binary").alias("key")).distinct().withColumn("part", placed(F.col("key"), self.options.parts))
        ranges = keyvalue.one_epoch(self.manifest(), epoch).select("epoch", "part", "tbl", "min_key", "max_key")
        some = keys.join(ranges, "part").where((F.col("min_key") <= F.col("key")) & (F.col("key") <= F.col("max_key"))).select("key", "epoch", "part", "tbl")
        if not filtered or self.ignore_filters or self.options.filter != "bitmap" or not exists(self.spark, f"{self.path}/filters"):
            return some
        filters = self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters").where(F.col("epoch") < self.epochs)
        passed = membership.probe(some.select("epoch", "part", "tbl", "key"), filters, ["epoch", "part", "tbl"], f"bitmap-{self.options.bm_fmt}", key_bits=self.options.bm_key_bits)
        return passed.select("key", "epoch", "part", "tbl")

    def seeks(self, keys: DataFrame, epoch: int = -1) -> DataFrame:
        """(key, table_seeks, seeks): for each key how many tables' ranges hold it, and how many of them are read after their filters."""
        keys = keys.select(F.col("key").cast("binary").alias("key")).distinct()
        by_range = self.tables_for(keys, epoch, filtered=False).groupBy("key").agg(F.count("*").alias("table_seeks"))
        by_filter = self.tables_for(keys, epoch).groupBy("key").agg(F.count("*").alias("seeks"))
        none = F.lit(0).cast("long")
        return keys.join(by_range, "key", "left").join(by_filter, "key", "left").select("key", F.coalesce("table_seeks", none).alias("table_seeks"), F.coalesce("seeks", none).alias("seeks"))

    def get(self, key: bytes | str, epoch: int = -1) -> bytes:
        """All values of a key, joined; empty if there is none."""
        key = key.encode() if isinstance(key, str) else key
        found = keyvalue.values_joined(keyvalue.applied(self.plan_get(key, epoch), self.options.mode)).first()
        return bytes(found["value"]) if found else b""

    def read(self, name: str, epoch: int = -1) -> bytes:
        size = min(16, max(1, self.options.key_size))
        key = self.spark.range(1).select(name_key(F.lit(name), size)).first()[0]
        return self.get(bytes(key), epoch)

    def get_many(self, keys: DataFrame, epoch: int = -1) -> DataFrame:
        keys = keys.select(F.col("key").cast("binary").alias("key")).distinct().withColumn("part", placed(F.col("key"), self.options.parts))
        rows = self._of(epoch).join(keys, ["part", "key"], "left_semi")
        return keys.select("key").join(keyvalue.values_joined(keyvalue.applied(rows, self.options.mode)), "key", "left")

    def scan(self, epoch: int = -1) -> DataFrame:
        rows = keyvalue.applied(self._of(epoch), self.options.mode)
        return rows.select("epoch", "tbl", "seq", "key", "value")

    def count(self, epoch: int = -1) -> int:
        """Rows written, from the manifest alone."""
        found = keyvalue.one_epoch(self.manifest(), epoch).agg(F.coalesce(F.sum("n"), F.lit(0))).first()
        return int(found[0])

    def visit(self, visitor: Callable[[bytes, bytes], object], epoch: int = -1) -> int:
        """Call ``visitor(key, value)`` for each row, in order of epochs and within them of keys or of writing; the number of calls.

        -1 skips the rest of the current block (``block_size`` bytes of an epoch's rows), not the rows after it. This is a loop of the caller's own
        process, a partition at a time; ``visit_each`` runs where the rows are.
        """
        order = ["epoch", *(["key", "seq"] if self.options.mode.ordered else ["seq"])]
        rows = keyvalue.applied(self._of(epoch), self.options.mode)
        calls, place, size, skipping = 0, None, 0, False
        for r in rows.select("epoch", "seq", "key", "value").orderBy(*order).toLocalIterator():
            key, value = bytes(r["key"]), bytes(r["value"] or b"")
            if r["epoch"] != place or size >= self.options.block_size:
                place, size, skipping = r["epoch"], 0, False
            size += len(key) + len(value)
            if not skipping:
                calls += 1
                skipping = visitor(key, value) == -1
        return calls

    def visit_each(self, visitor: Callable[[bytes, bytes], object], epoch: int = -1) -> None:
        """Call ``visitor(key, value)`` on the executors, in no order over partitions; -1 ends a partition."""

        def run(rows) -> None:
            for r in rows:
                if visitor(bytes(r["key"]), bytes(r["value"] or b"")) == -1:
                    break

        self.scan(epoch).foreachPartition(run)

    def properties(self) -> dict[str, int]:
        """Figures of the whole table: keys and user bytes from the manifest, bytes as stored from the file system."""
        m = self.manifest().agg(F.sum("n"), F.sum("key_bytes"), F.sum("value_bytes"), F.count("*")).first()
        n, keys, values, tables = (int(x or 0) for x in m)
        data, index, filters = (stored_bytes(self.spark, f"{self.path}/{x}") for x in ("rows", "manifest", "filters"))
        return {
            "num_keys": n, "total_user_data": keys + values, "key_bytes": keys, "value_bytes": values, "num_sstables": tables, "num_epochs": self.epochs,
            "data_bytes": data, "index_bytes": index, "filter_bytes": filters, "io_bytes": data + index + filters,
        }


def compacted(reader: EpochReader, path: str) -> EpochReader:
    """A copy of a table with one table in each epoch and part."""
    out = EpochWriter(reader.spark, path, replace(reader.options))
    for e in range(reader.epochs):
        out.put(reader.rows(e, e + 1).select("key", "value", "seq"))
        out.epoch_flush()
    out.finish()
    return EpochReader(reader.spark, path)
