import pytest
from pyspark.sql import functions as F

from cairn.functions import scalar as fn
from cairn.operators import namespace as ns
from cairn.plans.errors import AccessDenied, AlreadyExists, BadHandle, DirExpected, FileExpected, NotFound, NotSupported


def test_files_and_dirs(spark):
    n = ns.Namespace(spark)
    with pytest.raises(NotFound):
        n.stat("/node1")
    made = n.mkfile("/node1", 0o666)
    assert made["ino"] > 0 and n.stat("/node1")["ino"] == made["ino"] and made["mode"] & 0o777 == 0o644
    with pytest.raises(AlreadyExists):
        n.mkfile("/node1")
    assert n.mkfile("/node1", excl=False)["ino"] == made["ino"]
    n.mkdirs("/d/e/f", indexed=True)
    assert n.listdir("/") == ["d", "node1"] and n.listdir("/d/./e/../e") == ["f"]
    assert n.stat("/d/e/f")["mode"] & fn.INDEXED and not n.stat("/d/e")["mode"] & fn.INDEXED
    with pytest.raises(FileExpected):
        n.unlink("/d")
    with pytest.raises(DirExpected):
        n.stat("/node1/x")
    with pytest.raises(DirExpected):
        n.lookup("/node1")
    n.chmod("/node1", 0o600)
    n.chown("/node1", 7, 8)
    n.utime("/node1", 99)
    n.trunc("/node1", 5, 100)
    got = n.stat("/node1")
    assert (got["mode"], got["uid"], got["gid"], got["size"], got["mtime"]) == (fn.REGULAR | 0o600, 7, 8, 5, 100)
    other = n.session(user=3, group=3)
    assert not other.access("/node1", 4) and n.session(user=7).access("/node1", 6)
    with pytest.raises(AccessDenied):
        other.open("/node1")
    assert n.unlink("/node1")["ino"] == made["ino"] and n.unlink("/node1", must_exist=False) is None
    with pytest.raises(NotSupported):
        n.truncate("/d", 0)
    assert n.counters["mkfile"] == 2


def test_handles_and_paths(spark):
    n = ns.Namespace(spark)
    n.mkdir("/w")
    n.chdir("w")
    fd = n.open("f", create=True, write=True)
    n.write(fd, b"abc")
    n.pwrite(fd, b"z", 5)
    assert n.fstat(fd)["size"] == 6 and n.pread(fd, 10, 1) == b"bc\0\0z"
    n.close(fd)
    with pytest.raises(BadHandle):
        n.close(fd)
    assert n.getcwd() == "/w" and n.listdir(".") == ["f"] and n.umask(0o077) == 0o022


def test_permissions_fall_through(spark):
    rows = spark.createDataFrame([(0o700, 1, 1), (0o070, 9, 2), (0o007, 1, 9), (0o000, 1, 2)], "mode int, uid int, gid int")
    assert [r[0] for r in rows.select(fn.allowed(F.col("mode"), F.col("uid"), F.col("gid"), 1, 2, 7)).collect()] == [True, True, True, False]


def test_bulk(spark):
    empty = spark.createDataFrame([], ns.SCHEMA)
    wanted = spark.createDataFrame([(0, "a", 0o644, 1, 1), (0, "a", 0o644, 1, 1), (0, "b", 0o644, 1, 1)], "dir_ino long, name string, mode int, uid int, gid int")
    after, there = ns.created(empty, wanted, fn.REGULAR, 5, 100)
    assert there.count() == 0 and sorted((r.name, r.ino >= 100) for r in after.collect()) == [("a", True), ("b", True)]
    _, there = ns.created(after, wanted, fn.REGULAR, 6, 200)
    assert there.count() == 2 and [tuple(r) for r in ns.dir_info(after).collect()] == [(0, 2, 5)]
    paths = spark.createDataFrame([("/a",), ("/a/x",), ("/c",), ("/",), ("/q/../b",)], "path string")
    assert {r.path: r.status for r in ns.stat_many(after, paths).collect()} == {"/a": "ok", "/a/x": "dir_expected", "/c": "not_found", "/": "ok", "/q/../b": "ok"}
