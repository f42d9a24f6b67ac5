import pytest
from pyspark.sql import functions as F

from cairn.operators import keyvalue
from cairn.plans.errors import AlreadyExists, AssertionFailed, NotFound
from cairn.plans.options import Mode, Options
from cairn.sources.epoch_table import EpochReader, EpochWriter, compacted, destroy


def rows(spark, *pairs):
    return spark.createDataFrame([(i, k.encode(), v.encode()) for i, (k, v) in enumerate(pairs)], "seq long, key binary, value binary")


def written(spark, path, epochs, **options):
    """``epochs``: lists of "k=v"."""
    w = EpochWriter(spark, str(path), Options(**options))
    for epoch in epochs:
        if epoch:
            w.put(rows(spark, *(x.split("=") for x in epoch)))
        w.epoch_flush()
    w.finish()
    return EpochReader(spark, str(path))


def scanned(reader, epoch=-1):
    out = []
    reader.visit(lambda k, v: out.append(v.decode()), epoch)
    return "".join(out)


THREE = [["k1=v1", "k2=v2"], ["k1=v3", "k2=v4"], ["k1=v5", "k2=v6"]]


def test_empty(spark, tmp_path):
    r = written(spark, tmp_path / "t", [[]])
    assert r.get("non-exists") == b"" and r.count() == 0 and scanned(r) == ""


def test_single_epoch(spark, tmp_path):
    r = written(spark, tmp_path / "t", [[f"k{i}=v{i}" for i in range(1, 7)]], lg_parts=2)
    assert [r.get(f"k{i}") for i in (1, 6)] == [b"v1", b"v6"] and r.get("k1.1") == b""
    assert scanned(r, 0) == "v1v2v3v4v5v6" and scanned(r, 1) == "" and (r.count(0), r.count(1)) == (6, 0)


@pytest.mark.parametrize("options", [{}, {"compression": "snappy"}, {"bf_bits_per_key": 0}, {"mode": Mode.MULTIMAP, "lg_parts": 1}])
def test_multi_epoch(spark, tmp_path, options):
    r = written(spark, tmp_path / "t", THREE, **options)
    assert r.get("k1") == b"v1v3v5" and r.get("k2", 1) == b"v4"
    assert scanned(r) == "v1v2v3v4v5v6" and scanned(r, 2) == "v5v6" and [r.count(e) for e in range(4)] == [2, 2, 2, 0]


def test_unordered_keeps_the_order_of_writes(spark, tmp_path):
    r = written(spark, tmp_path / "t", [["k2=v2", "k1=v1"], ["k1=v3", "k2=v4"], ["k2=v6", "k1=v5"]], mode=Mode.UNIQUE_UNORDERED)
    assert [scanned(r, e) for e in range(3)] == ["v2v1", "v3v4", "v6v5"] and r.get("k1") == b"v1v3v5"


def test_multimap(spark, tmp_path):
    r = written(spark, tmp_path / "t", [["k1=v1", "k1=v2"], ["k0=v3", "k1=v4", "k1=v5"], ["k1=v6", "k1=v7", "k5=v8"], ["k1=v9"]], mode=Mode.MULTIMAP)
    assert r.get("k1") == b"v1v2v4v5v6v7v9"
    many = {bytes(x.key): x.value and bytes(x.value) for x in r.get_many(spark.createDataFrame([(b"k0",), (b"k5",), (b"no",), (b"k0",)], "key binary")).collect()}
    assert many == {b"k0": b"v3", b"k5": b"v8", b"no": None}


def test_large_batch(spark, tmp_path):
    w = EpochWriter(spark, str(tmp_path / "t"), Options(lg_parts=2))
    for _ in range(2):
        w.put(spark.range(65536).select(F.col("id").alias("seq"), F.format_string("k%07d", "id").cast("binary").alias("key"), F.lit(b"x" * 32).alias("value")))
        w.epoch_flush()
    w.finish()
    r = EpochReader(spark, str(tmp_path / "t"))
    assert r.get("k0000000") == r.get("k0065535") == b"x" * 64 and r.get("kx") == b"" and r.count() == 131072


def test_empty_epochs_advance_and_do_not_stop_counts(spark, tmp_path):
    r = written(spark, tmp_path / "t", [["a=1"], [], ["a=2"]])
    assert r.count() == 2 and r.get("a") == b"12" and r.epochs == 3


def test_drop_keeps_the_first_write_of_an_epoch_over_flushes(spark, tmp_path):
    w = EpochWriter(spark, str(tmp_path / "t"), Options(mode=Mode.UNIQUE_DROP))
    w.put(rows(spark, ("a", "1"), ("a", "2")))
    w.flush()
    w.put(rows(spark, ("a", "3"), ("b", "4")))
    w.epoch_flush()
    w.finish()
    r = EpochReader(spark, str(tmp_path / "t"))
    assert r.get("a") == b"1" and r.count() == 2


def test_states(spark, tmp_path):
    path = str(tmp_path / "t")
    w = EpochWriter(spark, path)
    with pytest.raises(AssertionFailed, match="Bad epoch num"):
        w.put(rows(spark, ("a", "1")), epoch=1)
    w.put(rows(spark, ("a", "1")), epoch=0)
    w.finish()
    w.finish()
    with pytest.raises(AssertionFailed, match="already finished"):
        w.put(rows(spark, ("a", "1")))
    with pytest.raises(AlreadyExists):
        EpochWriter(spark, path)
    assert EpochReader(spark, path, paranoid=True).get("a") == b"1"
    destroy(spark, path)
    with pytest.raises(NotFound):
        EpochReader(spark, path)


def test_time_travel_names_and_properties(spark, tmp_path):
    w = EpochWriter(spark, str(tmp_path / "t"), Options(mode=Mode.MULTIMAP))
    for v in "xyz":
        w.append(spark.createDataFrame([("file", v.encode())], "name string, value binary"))
        w.epoch_flush()
    w.finish()
    assert EpochReader(spark, str(tmp_path / "t")).read("file") == b"xyz"
    r = EpochReader(spark, str(tmp_path / "t"), num_epochs=2)
    assert r.read("file") == b"xy" and r.read("none") == b"" and r.properties()["num_keys"] == 2
    c = compacted(EpochReader(spark, str(tmp_path / "t")), str(tmp_path / "c"))
    assert c.read("file") == b"xyz" and c.properties()["num_sstables"] == 3


def test_point_reads_prune_parts_and_push_the_key(spark, tmp_path):
    r = written(spark, tmp_path / "t", THREE, lg_parts=2)
    plan = r.plan_get(b"k1", 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in plan
    partition = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "part" in partition and "epoch" in partition


def test_engines(spark):
    kv = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y"), ("a", 2, 3, "z"), ("b", 1, 4, "w")], "key string, epoch int, seq long, value string")
    get = lambda df: {r.key: r.value for r in df.collect()}
    assert get(keyvalue.first_match(kv)) == {"a": "x", "b": "w"}
    assert get(keyvalue.last_wins(kv)) == {"a": "yz", "b": "w"}
    assert get(keyvalue.last_wins(kv, stop_at_gap=True)) == {"a": "y"}
    assert get(keyvalue.values_joined(kv.limit(0))) == {}
    assert [r.key for r in keyvalue.missing(kv, spark.createDataFrame([("a",), ("q",)], "key string")).collect()] == ["q"]
