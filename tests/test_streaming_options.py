import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.plans.options import Mode, Options, parse_options, pretty_bool, pretty_number
from cairn.sources.epoch_table import EpochReader
from cairn.streaming import epochs


def test_options():
    o = parse_options("lg_parts=3&memtable_size=8MiB&filter=bitmap&bm_fmt=vb+&nonsense=1&key_size=ten&skip_sort=true&tail_padding=1")
    assert (o.lg_parts, o.total_memtable_budget, o.filter, o.bm_fmt, o.key_size, o.skip_sort) == (3, 8 << 20, "bitmap", "vb+", 8, True)
    assert o.storage == (("tail_padding", "1"),) and parse_options("lg_parts=99").lg_parts == 8 and parse_options("block_size=1").block_size == 1024
    assert pretty_number("4k") == 4096 and pretty_number("x") is None and pretty_bool("Yes") is True
    assert Mode.of(multimap=True) is Mode.MULTIMAP and Mode.of(drop=True) is Mode.UNIQUE_DROP and Mode.of(unordered=True) is Mode.UNIQUE_UNORDERED


def test_stream_sink_equals_batch_and_rejects(spark, tmp_path):
    source = str(tmp_path / "in")
    for e in range(3):
        spark.createDataFrame([(f"k{i}", f"{e}", i, e if i < 4 else 7) for i in range(5)], "key string, value string, seq long, e int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, value string, seq long, e int").option("maxFilesPerTrigger", 1).parquet(source)
    q = epochs.write_epochs(stream, str(tmp_path / "t"), str(tmp_path / "c"), Options(mode=Mode.MULTIMAP), epoch="e")
    q.awaitTermination()
    epochs.finish(spark, str(tmp_path / "t"), q)
    r = EpochReader(spark, str(tmp_path / "t"), paranoid=True)
    assert r.epochs == 3 and sorted(r.get("k0").decode()) == ["0", "1", "2"] and r.get("k4") == b""
    assert spark.read.parquet(str(tmp_path / "t/rejected")).count() == 3


def test_admission(spark):
    rows = spark.createDataFrame([(i, e) for i, e in enumerate((0, 0, 1, 0, 2, 1, 2))], "at long, epoch int")
    assert [r.late for r in epochs.admitted(rows, ["at"]).orderBy("at").collect()] == [False, False, False, True, False, True, False]


@pytest.mark.parametrize(("state", "at", "change", "want"), [(None, 5, False, ((0, 15), True)), ((0, 15), 9, False, ((0, 15), True)), ((0, 15), 9, True, ((0, 15), False)), ((0, 15), 15, True, ((1, 15), True))])
def test_lease_step(state, at, change, want):
    assert epochs.lease_step(state, at, change, 10) == want


def test_leases_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(pd.DataFrame({"name": ["a", "a", "a", "b"], "at": [1_000_000, 1_000_005, 1_000_020, 1_000_001], "change": [False, True, True, True]})).coalesce(1).write.parquet(source)
    calls = spark.readStream.schema("name string, at long, change boolean").parquet(source)
    q = epochs.leases(calls, 10).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.name, r.at - 1_000_000, r.seq, r.granted) for r in spark.table("leases").collect())
    assert got == [("a", 0, 0, True), ("a", 5, 0, False), ("a", 20, 1, True), ("b", 1, 1, True)]


def test_event_epoch(spark):
    df = spark.sql("select timestamp '2024-01-03 23:59:59' as t")
    assert df.select(epochs.event_epoch(F.col("t"), "2024-01-01")).first()[0] == 2
