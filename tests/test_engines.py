import logging

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalar as fn
from cairn.functions.codecs import BITMAPS, FINDERS
from cairn.functions.sketches import Cuckoo
from cairn.operators import membership
from cairn.operators import namespace as ns
from cairn.operators.prefix import numbered
from cairn.operators.ranges import RangeTable
from cairn.plans.errors import AccessDenied, FileExpected, InvalidArgument, NotSupported, ReadOnly
from cairn.plans.options import Mode, Options, with_environment
from cairn.sources import engines
from cairn.sources.epoch_table import EpochReader, EpochWriter
from cairn.streaming.epochs import put_ranges


def rows(spark, *pairs):
    return spark.createDataFrame([(k.encode(), v.encode(), i) for i, (k, v) in enumerate(pairs)], "key binary, value binary, seq long")


def test_plain_engine_takes_the_first_value_and_reads_few_blocks(spark, tmp_path):
    t = engines.create(spark, str(tmp_path / "p"), "plaindb", Options(block_size=1024, bf_bits_per_key=12))
    t.put(rows(spark, *((f"k{i:04d}", "x" * 20) for i in range(500)), ("k0007", "later")))
    t.put(rows(spark, ("k0007", "last"), ("new", "n")))
    again = engines.open_table(spark, t.path, "plaindb")
    assert bytes(again.plan_get(b"k0007").first().value) == b"x" * 20 and bytes(again.plan_get(b"new").first().value) == b"n"
    assert again.plan_get(b"none").first() is None
    blocks = again.rows().select("batch", "block").distinct().count()
    assert blocks > 10 and again.blocks_for(b"k0100").count() <= 3
    many = {bytes(r.key): r.value and bytes(r.value) for r in again.get_many(rows(spark, ("k0001", ""), ("none", ""))).collect()}
    assert many == {b"k0001": b"x" * 20, b"none": None}


@pytest.mark.parametrize("engine", ["leveldb", "leveldb-l0", "leveldb-l0-bloom"])
def test_level_engines(spark, tmp_path, engine):
    t = engines.create(spark, str(tmp_path / "l"), engine)
    t.put(rows(spark, ("a", "1"), ("b", "2")))
    t.put(rows(spark, ("a", "3")))
    t.epoch_flush()
    t.put(rows(spark, ("a", "4")))
    t.epoch_flush()
    assert {bytes(r.key): bytes(r.value) for r in t.get_many().collect()} == {b"a": b"34", b"b": b"2"}
    assert (t.rows().where("epoch = 0").select("run").distinct().count() == 1) == (engine == "leveldb")


def test_other_engines(spark, tmp_path):
    nothing = engines.create(spark, str(tmp_path / "n"), "nothing")
    nothing.put(rows(spark, ("a", "1")))
    with pytest.raises(NotSupported):
        nothing.rows()
    with pytest.raises(InvalidArgument):
        engines.create(spark, str(tmp_path / "x"), "other")
    assert isinstance(engines.create(spark, str(tmp_path / "r"), "rangedb"), RangeTable)


def test_bitmap_filters_inside_tables(spark, tmp_path):
    w = EpochWriter(spark, str(tmp_path / "t"), Options(filter="bitmap", bm_fmt="fast-p-f-delta", mode=Mode.MULTIMAP))
    for e in range(3):
        w.put(spark.range(100).select(fn.le32(F.col("id") * 3 + e).alias("key"), F.lit("v").alias("value"), F.col("id").alias("seq")))
        w.epoch_flush(wait=False)
    w.wait()
    w.sync()
    w.finish()
    asked = spark.range(30).select(fn.le32(F.col("id")).alias("key"))
    seeks = EpochReader(spark, w.path).seeks(asked).collect()
    assert {r.seeks for r in seeks} == {1} and max(r.table_seeks for r in seeks) == 3
    assert all(r.seeks == r.table_seeks for r in EpochReader(spark, w.path, ignore_filters=True).seeks(asked).collect())
    r = EpochReader(spark, w.path)
    assert r.get((4).to_bytes(4, "little")) == b"v" and r.get((999).to_bytes(4, "little")) == b""
    assert r.properties()["filter_bytes"] > 0


def test_visits_stop_by_block(spark, tmp_path):
    w = EpochWriter(spark, str(tmp_path / "t"), Options(block_size=1024, mode=Mode.MULTIMAP))
    w.put(rows(spark, *((f"k{i:03d}", "x" * 60) for i in range(64))))
    w.finish()
    seen = []
    calls = EpochReader(spark, w.path).visit(lambda k, v: seen.append(k) or -1)
    assert calls == len(seen) == 4 and seen[0] == b"k000" and seen[1] > b"k010"


def test_fast_formats_search_by_marks():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 22, 9000))
    asked = np.concatenate((keys[::7], np.arange(0, 1 << 22, 997)))
    for fmt, find in FINDERS.items():
        assert (find(BITMAPS[fmt][0](keys), asked) == np.isin(asked, keys)).all()
        assert not find(BITMAPS[fmt][0](keys[:0]), asked).any()


def test_registered_kinds_and_values(spark):
    class Exact:
        def build(self, keys):
            return b",".join(k.hex().encode() for k in keys)

        def matches(self, data, keys):
            return [k.hex().encode() in data.split(b",") for k in keys]

    membership.register("exact", Exact)
    try:
        keys = spark.range(100).select(fn.le32(F.col("id")).alias("key"), "id")
        filters = membership.build_filters(keys.where("id % 2 = 0"), [], "exact")
        assert membership.probe(keys, filters, [], "exact").count() == 50
    finally:
        del membership.REGISTRY["exact"]
    many = spark.range(3000).selectExpr("id % 300 as k", "id % 13 as v").select(fn.le32(F.col("k")).alias("key"), "v")
    filters = membership.build_value_filters(many, [], "v", 12, 8, most=100)
    found = membership.candidate_values(many.select("key").distinct(), filters, [], 12, 8)
    assert many.distinct().join(found.withColumnRenamed("value", "v"), ["key", "v"], "left_anti").count() == 0
    assert found.count() < 1.05 * many.distinct().count() and Cuckoo(8, 8).values(Cuckoo(8, 8).build_tables([]), b"x") == []


def test_ranges_are_restart_safe(spark, tmp_path):
    batch = lambda *x: spark.createDataFrame([(v,) for v in x], "fkey double")
    for number, values in ((0, (1.0, 5.0)), (1, (2.0, 9.0)), (1, (2.0, 9.0)), (0, (1.0, 5.0)), (1, (2.0, 9.0)), (2, (8.0, 1.0))):
        put_ranges(RangeTable(spark, str(tmp_path / "r")), batch(*values), number)
    t = RangeTable(spark, str(tmp_path / "r"))
    assert t.rows().count() == 6
    assert {(r.batch, r.blk): (r.n, r.oob) for r in t.manifest().collect()} == {(0, 2): (2, 2), (1, 0): (1, 0), (1, 2): (1, 1), (2, 0): (1, 0), (2, 1): (1, 0)}
    assert t.bounds.updates == 3


def test_numbers_are_distinct(spark):
    got = numbered(spark.range(1000).selectExpr("id % 7 as a", "id as b"), ["a", "b"], "n", 5, shares=9)
    assert sorted(r.n for r in got.collect()) == list(range(5, 1005))


def test_permissions_on_change(spark):
    n = ns.Namespace(spark)
    n.mkdir("/own", 0o755)
    n.mkfile("/own/f")
    n.mkdir("/open", 0o777, indexed=True)
    n.umask(0)
    n.mkdir("/free", 0o777)
    other = n.session(user=5, group=5)
    for call in (lambda: other.mkfile("/own/g"), lambda: other.mkdir("/own/d"), lambda: other.unlink("/own/f"), lambda: other.chmod("/own/f", 0o777), lambda: other.utime("/own/f", 3)):
        with pytest.raises(AccessDenied):
            call()
    with pytest.raises(InvalidArgument):
        n.mkfile("/own/" + "x" * 256)
    with pytest.raises(NotSupported):
        n.chmod("/open", 0o700)
    assert other.mkfile("/free/g")["uid"] == 5 and other.unlink("/free/g")
    calls = []
    ns.Watched(n, lambda op, s, e: calls.append((op, e))).stat("/own")
    assert calls == [("stat", None)] and n.readidx("/own") == b"\x01"
    assert n.listdir("/own", filler=lambda x: 1) == ["f"] and n.session(inputs=("a",), output="b").getinput() == "a"


def test_files_outlive_handles_and_snapshots(spark, tmp_path):
    n = ns.Namespace(spark)
    n.mkdir("/d")
    fd, entry = n.openstat("/d/f", create=True, write=True)
    n.write(fd, b"hello ")
    n.flush(fd)
    n.write(fd, b"world")
    n.close(fd)
    assert entry["size"] == 0 and n.stat("/d/f")["size"] == 11 and n.cat("/d/f") == b"hello world"
    fd = n.open("/d/f", write=True)
    n.pwrite(fd, b"J", 0)
    n.close(fd)
    assert n.session().cat("/d/f") == b"Jello world"
    with pytest.raises(FileExpected):
        n.open("/d", write=True)
    for i, text in enumerate(("one", "two", "")):
        (tmp_path / f"s{i}.txt").write_text(text)
    assert n.copy_in(str(tmp_path / "s*.txt"), "/d") == 3 and n.listdir("/d") == ["f", "s0.txt", "s1.txt", "s2.txt"]
    assert [n.cat(f"/d/s{i}.txt") for i in range(3)] == [b"one", b"two", b""] and n.mkfile("/d/z")["ino"] > n.stat("/d/s2.txt")["ino"]
    ns.save_snapshot(n.tree, f"type=posixfs,root={tmp_path}/snap")
    tree = ns.load_snapshot(spark, f"type=posixfs,root={tmp_path}/snap,readonly=true")
    client = ns.Namespace(spark, tree=tree)
    assert client.stat("/d/f")["size"] == 11
    with pytest.raises(ReadOnly):
        client.mkfile("/d/new")
    with pytest.raises(NotSupported):
        ns.snapshot_store("type=rados,root=/x")


def test_the_log_is_merged(spark, monkeypatch):
    monkeypatch.setattr(ns, "LOG_LIMIT", 4)
    n = ns.Namespace(spark)
    for i in range(6):
        n.mkfile(f"/f{i}")
    n.unlink("/f0")
    assert n.tree.version >= 1 and n.listdir("/") == [f"f{i}" for i in range(1, 6)] and len(n.tree.log) < 4


def test_deep_and_flat_paths(spark, tmp_path):
    deep = [(i, f"d{i}", i + 1, fn.DIRECTORY | 0o755) for i in range(12)]
    flat = [(1, f"f{i}", 100 + i, fn.REGULAR | 0o644) for i in range(300)]
    inodes = spark.createDataFrame(deep + flat, "dir_ino long, name string, ino long, mode int").selectExpr("*", "0 as uid", "0 as gid")
    got = {r.path: r.depth for r in ns.all_paths(inodes, str(tmp_path / "levels")).collect()}
    assert len(got) == 312 and max(got.values()) == 12 and got["/d0/f7"] == 2


def test_names_that_do_not_match_their_key(spark):
    good = spark.createDataFrame([("a",)], "name string").withColumn("key", fn.name_key(F.col("name")))
    assert ns.names_checked(good).count() == 1
    with pytest.raises(Exception, match="another name"):
        ns.names_checked(good.withColumn("name", F.lit("b"))).collect()


def test_environment_beats_options(caplog):
    with caplog.at_level(logging.WARNING):
        got = with_environment(Options(lg_parts=1), {"CAIRN_LG_PARTS": "3", "CAIRN_FILTER": "bitmap", "OTHER": "1"})
    assert (got.lg_parts, got.filter, got.block_size) == (3, "bitmap", Options().block_size)
