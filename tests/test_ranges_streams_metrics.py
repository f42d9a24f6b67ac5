import pytest
from pyspark.sql import functions as F

from cairn.operators import metrics, ranges, streams
from cairn.operators.prefix import numbered, running


def test_inside_and_observed(spark):
    df = spark.createDataFrame([(x,) for x in (-10.0, 0.0, 10.0, 15.0, 20.0, 25.0)], "k float")
    assert [r[0] for r in df.select(ranges.inside(F.col("k"), 10.0, 20.0)).collect()] == [False, False, True, True, False, False]
    one = ranges.observed(spark.createDataFrame([(20.0,), (14.0,), (50.0,)], "k float"), "k", F.lit(10.0), F.lit(20.0)).first()
    assert tuple(one) == (14.0, 50.0, 3, 2)
    states = spark.createDataFrame([(10.0, 20.0, 16.0, 48.0, 3, 1), (5.0, 15.0, 6.0, 16.0, 2, 1)], "rmin float, rmax float, smallest float, largest float, n long, oob long")
    assert tuple(ranges.merged(states).first()) == (5.0, 20.0, 6.0, 48.0, 5, 2)
    assert tuple(ranges.observed(df.limit(0), "k", F.lit(0), F.lit(1)).first()) == (None, None, 0, 0)


def test_bounds_move_and_strays_go_to_the_oldest(spark, tmp_path):
    b = ranges.Bounds(2, 2)
    assert b.ranges == (None,) * 4
    b = b.updated(0.0, 10.0).updated(100.0, 200.0)
    assert b.ranges == ((100.0, 150.0), (150.0, 200.0), (0.0, 10.0), None) and b.updates == 2
    with pytest.raises(ValueError):
        b.updated(3.0, 1.0)
    t = ranges.RangeTable(spark, str(tmp_path / "r"), 2, 2)
    t.update_bounds(0.0, 10.0)
    t.update_bounds(100.0, 200.0)
    t.add(spark.createDataFrame([(x,) for x in (120.0, 160.0, 5.0, -7.0, 500.0)], "fkey double"), 0)
    assert {r.blk: (r.n, r.oob, r.smallest) for r in t.manifest().collect()} == {0: (1, 0, 120.0), 1: (1, 0, 160.0), 2: (1, 0, 5.0), 3: (2, 2, -7.0)}


def test_side_log(spark):
    log = spark.createDataFrame([(i, c.encode()) for i, c in enumerate("abcxyz")], "seq long, data binary")
    log = streams.log_offsets(log, ["seq"], "data")
    assert bytes(streams.pread(log, 0, 6).first().data) == b"abcxyz"
    assert bytes(streams.pread(log, 4, 100).first().data) == b"yz"


def test_block_reads_fill_holes_and_take_the_last_write(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 4, b"aaaa"), (1, 1, 8, 2, b"cc"), (1, 2, 2, 3, b"bbb"), (2, 0, 0, 1, b"z")], "file_id long, seq long, off long, len long, data binary")
    got = {r.file_id: bytes(r.data) for r in streams.read_blocks(blocks, 0, 100).collect()}
    assert got == {1: b"aabbb\0\0\0cc", 2: b"z"}
    got = {r.file_id: bytes(r.data) for r in streams.read_blocks(blocks, 3, 4).collect()}
    assert got == {1: b"bb\0\0", 2: b""}


def test_running_and_numbers_match_plain_python(spark):
    rows = [(i * 7919 % 1009, i, i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, v long")
    want, total = {}, 0
    for a, b, v in sorted(rows):
        want[b] = total
        total += v
    assert {r.b: r.s for r in running(df, ["a", "b"], F.col("v"), "s", stretches=5).collect()} == want
    assert sorted(r.n for r in numbered(df, ["b"], "n", 5).collect()) == list(range(5, 1005))


def test_metrics(spark):
    h = metrics.cumulative(metrics.histogram(spark.createDataFrame([(x,) for x in (1, 1, 2, 50, 9)], "c long"), F.col("c")))
    assert [tuple(r) for r in h.orderBy("bucket").collect()] == [(1, 2, 2, 5), (2, 1, 3, 5), (9, 2, 5, 5)]
    kv = spark.createDataFrame([("a", 0, "xy"), ("a", 0, None), ("b", 1, "z")], "key string, epoch int, value string")
    assert tuple(metrics.output_stats(kv).first()) == (3, 1, 3, 3, 6)
    assert tuple(metrics.output_stats(kv.limit(0)).first()) == (0, 0, 0, 0, 0)
