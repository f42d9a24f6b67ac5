"""Query registry of the engine's own operators, each with the same query in DuckDB SQL.

The key-value view of ``events``: key = user, epoch = day since 2024-01-01, seq = event, value = type of event. The tree of
the namespace queries: regions hold nations, nations hold customers (regular files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalar as fn
from cairn.operators import keyvalue as kv_ops
from cairn.operators import membership, metrics, namespace, ranges, streams
from cairn.plans.options import Mode, Options
from cairn.session import reach_from_workers, scratch_path
from cairn.sources.epoch_table import EpochReader, EpochWriter, stored_bytes
from cairn.sources import engines
from cairn.streaming.epochs import admitted, event_epoch, in_epochs, leases, put_ranges, write_epochs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
START = "2024-01-01"

_KV = f"kv AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(date_diff('day', DATE '{START}', CAST(ts AS DATE)) AS INTEGER) AS epoch, event_id AS seq, event_type AS value, value AS num, ts FROM events)"
_INODES = """inodes AS (
    SELECT CAST(0 AS BIGINT) AS dir_ino, r_name AS name, CAST(10 + r_regionkey AS BIGINT) AS ino, 16877 AS mode, 0 AS uid, 0 AS gid, CAST(0 AS BIGINT) AS ctime FROM region
    UNION ALL SELECT 10 + n_regionkey, n_name, 100 + n_nationkey, 16877, 0, 0, 0 FROM nation
    UNION ALL SELECT 100 + c_nationkey, c_name, 1000 + c_custkey, CAST(32768 + (c_custkey * 37) % 512 AS INTEGER), CAST(c_custkey % 7 AS INTEGER), CAST(c_custkey % 5 AS INTEGER), c_custkey FROM customer)"""


def query(oracle: str | None = None):
    """Register a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_kv(spark: SparkSession, sf_dir: str, key: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The key-value view; a key and a range of epochs become predicates of the scan."""
    e = table(spark, sf_dir, "events")
    if key is not None:
        e = e.where(F.col("user_id") == key)
    if low is not None or high is not None:
        e = e.where(in_epochs(F.col("ts"), START, low, high))
    return e.select(F.col("user_id").cast("string").alias("key"), event_epoch(F.col("ts"), START).alias("epoch"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("value"), F.col("value").alias("num"), "ts")


def kv_only(spark: SparkSession, sf_dir: str, key: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    return events_kv(spark, sf_dir, key, low, high).select("key", "epoch", "seq", "value")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    row = lambda d, name, i, mode, u, g, t: [F.lit(d).cast("long").alias("dir_ino") if isinstance(d, int) else d.cast("long").alias("dir_ino"), name.alias("name"), i.cast("long").alias("ino"), mode.cast("int").alias("mode"), u.cast("int").alias("uid"), g.cast("int").alias("gid"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("zserver"), t.cast("long").alias("mtime"), t.cast("long").alias("ctime")]
    folder, zero = F.lit(fn.DIRECTORY | 0o755), F.lit(0)
    k = F.col("c_custkey")
    regions = r.select(*row(0, F.col("r_name"), F.col("r_regionkey") + 10, folder, zero, zero, zero))
    nations = n.select(*row(F.col("n_regionkey") + 10, F.col("n_name"), F.col("n_nationkey") + 100, folder, zero, zero, zero))
    files = c.select(*row(F.col("c_nationkey") + 100, F.col("c_name"), k + 1000, F.lit(fn.REGULAR) + k * 37 % 512, k % 7, k % 5, k))
    return regions.union(nations).union(files)


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each customer: every third one has no such file, every fifth goes through a nation that is not there."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    return rows.select(F.concat(F.lit("/"), "r_name", F.when(k % 5 == 4, F.lit("/./NOWHERE/")).otherwise(F.concat(F.lit("//"), "n_name", F.lit("/"))), "c_name", F.when(k % 3 == 2, F.lit("x")).otherwise(F.lit(""))).alias("path"), k.cast("long").alias("c_custkey"))


# --- reads --------------------------------------------------------------------------------------------------------


@query(f"WITH {_KV} SELECT key, string_agg(value, '' ORDER BY epoch, seq) AS value FROM kv WHERE key = '13' GROUP BY key")
def point_get(spark, sf_dir):
    return kv_ops.get(kv_only(spark, sf_dir, key=13), "13")


@query(f"WITH {_KV} SELECT key, string_agg(value, '' ORDER BY epoch, seq) AS value FROM kv WHERE key = '13' GROUP BY key")
def table_get(spark, sf_dir):
    """The same read from a table written in epochs: parts, manifest, key statistics and Bloom filters."""
    path = scratch_path(spark, "table-get")
    writer = EpochWriter(spark, path, Options(lg_parts=2, mode=Mode.MULTIMAP))
    for low, high in ((0, 10), (10, 20), (20, 30)):  # three epochs of ten days
        writer.put(kv_only(spark, sf_dir, low=low, high=high).select("key", "value", "seq"))
        writer.epoch_flush()
    writer.finish()
    found = kv_ops.values_joined(EpochReader(spark, path).plan_get(b"13"))
    return found.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query(f"WITH {_KV} SELECT CAST(epoch // 10 AS INTEGER) AS epoch, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM kv WHERE epoch BETWEEN 0 AND 29 GROUP BY ALL")
def table_count(spark, sf_dir):
    """Counts and key ranges from a table's manifest alone."""
    path = scratch_path(spark, "table-count")
    writer = EpochWriter(spark, path, Options(lg_parts=2, mode=Mode.MULTIMAP))
    for low, high in ((0, 10), (10, 20), (20, 30)):
        writer.put(kv_only(spark, sf_dir, low=low, high=high).select("key", "value", "seq"))
        writer.epoch_flush()
    writer.finish()
    m = EpochReader(spark, path).manifest()
    return m.groupBy("epoch").agg(F.sum("n").alias("n"), F.decode(F.min("min_key"), "UTF-8").alias("min_key"), F.decode(F.max("max_key"), "UTF-8").alias("max_key"))


@query("SELECT CAST(conv_id AS VARCHAR) AS name, string_agg(text, '' ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def append_read(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("key"), F.lit(0).alias("epoch"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    return kv_ops.values_joined(rows).withColumnRenamed("key", "name")


@query("SELECT md5(CAST(conv_id AS VARCHAR))[1:16] AS key_hex, count(*) AS n FROM conversations GROUP BY ALL")
def append_keys(spark, sf_dir):
    """Names as keys of eight bytes."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.lower(F.hex(fn.name_key(F.col("conv_id").cast("string"), 8))).alias("key_hex")).agg(F.count("*").alias("n"))


@query(f"WITH {_KV} SELECT epoch, count(*) AS n FROM kv WHERE epoch >= 3 AND epoch < 6 GROUP BY epoch")
def epoch_count(spark, sf_dir):
    return kv_ops.counts(kv_ops.epochs_between(kv_only(spark, sf_dir, low=3, high=6), 3, 6))


@query(f"WITH {_KV}, g AS (SELECT epoch, key, count(*) AS c FROM kv GROUP BY ALL) SELECT epoch, count(*) AS kept, CAST(sum(c) - count(*) AS BIGINT) AS dropped FROM g GROUP BY epoch")
def unique_drop(spark, sf_dir):
    return kv_ops.drop_counts(kv_only(spark, sf_dir))


@query(f"WITH {_KV}, g AS (SELECT epoch, key, arg_min(value, seq) AS value FROM kv GROUP BY ALL) SELECT key, string_agg(value, '' ORDER BY epoch) AS value FROM g GROUP BY key")
def unique_get(spark, sf_dir):
    """All keys of a table that keeps the first write of each epoch."""
    return kv_ops.values_joined(kv_ops.applied(kv_only(spark, sf_dir), Mode.UNIQUE_DROP))


@query(f"WITH {_KV}, g AS (SELECT epoch, key, arg_max(value, seq) AS value FROM kv GROUP BY ALL) SELECT key, string_agg(value, '' ORDER BY epoch) AS value FROM g GROUP BY key")
def last_wins(spark, sf_dir):
    return kv_ops.last_wins(kv_only(spark, sf_dir))


@query(f"WITH {_KV}, g AS (SELECT epoch, key, arg_max(value, seq) AS value FROM kv GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch) - 1 AS i FROM g) SELECT key, string_agg(value, '' ORDER BY epoch) AS value FROM p WHERE i = epoch GROUP BY key")
def last_wins_to_gap(spark, sf_dir):
    return kv_ops.last_wins(kv_only(spark, sf_dir), stop_at_gap=True)


@query(f"WITH {_KV} SELECT key, arg_min(value, seq) AS value FROM kv GROUP BY key")
def pdb_first(spark, sf_dir):
    return kv_ops.first_match(kv_only(spark, sf_dir))


@query(f"WITH {_KV} SELECT epoch, key, seq, value FROM kv WHERE epoch >= 2 AND epoch < 5")
def scan_range(spark, sf_dir):
    return kv_ops.scan(kv_ops.epochs_between(kv_only(spark, sf_dir, low=2, high=5), 2, 5))


@query(f"WITH {_KV} SELECT key, count(*) AS n, string_agg(value, '' ORDER BY epoch, seq) AS value FROM kv WHERE epoch < 10 GROUP BY key")
def prefix_travel(spark, sf_dir):
    return kv_ops.values_joined(kv_ops.epochs_between(kv_only(spark, sf_dir, high=10), end=10), count="n").select("key", "n", "value")


@query(f"WITH {_KV}, v AS (SELECT key, string_agg(value, '' ORDER BY epoch, seq) AS value FROM kv GROUP BY key) SELECT CAST(c_custkey AS VARCHAR) AS key, value FROM customer LEFT JOIN v ON key = CAST(c_custkey AS VARCHAR)")
def batch_get(spark, sf_dir):
    return kv_ops.get_many(kv_only(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")))


@query(f"WITH {_KV} SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT key FROM kv)")
def neg_get(spark, sf_dir):
    return kv_ops.missing(kv_only(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")))


@query("SELECT CAST(l_orderkey * 4294967296 + l_linenumber AS BIGINT) AS key, count(*) AS n FROM lineitem WHERE l_orderkey = 33 GROUP BY ALL")
def prefix_scan(spark, sf_dir):
    """Keys of a fixed prefix and four more bytes."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.unhex(F.lpad(F.hex("l_orderkey"), 8, "0")), F.unhex(F.lpad(F.hex("l_linenumber"), 8, "0"))).alias("key"))
    found = kv_ops.prefix_scan(rows, bytes.fromhex("00000021"))
    return found.groupBy(F.conv(F.hex("key"), 16, 10).cast("long").alias("key")).agg(F.count("*").alias("n"))


# --- tables and statistics -----------------------------------------------------------------------------------------

_STATS = f"{_KV}, stats AS (SELECT CAST(CAST(key AS BIGINT) % 4 AS INTEGER) AS part, epoch, min(key) AS min_key, max(key) AS max_key, count(*) AS n, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM kv GROUP BY ALL)"


def _stats(spark, sf_dir):
    return kv_ops.table_stats(kv_only(spark, sf_dir).withColumn("part", F.pmod(F.col("key").cast("long"), F.lit(4)).cast("int")), ("part", "epoch"))


@query(f"WITH {_STATS} SELECT * FROM stats")
def table_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"WITH {_STATS} SELECT part, epoch, n FROM stats WHERE min_key <= '13' AND max_key >= '13'")
def zone_map_prune(spark, sf_dir):
    return kv_ops.tables_that_may_hold(_stats(spark, sf_dir), "13").select("part", "epoch", "n")


@query(f"""WITH {_KV}, b AS (SELECT epoch, seq, sum(strlen(key) + strlen(value)) OVER (PARTITION BY epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kv)
SELECT epoch, CAST(coalesce(before, 0) // 1000 AS INTEGER) AS tbl, count(*) AS n, min(seq) AS first_seq FROM b GROUP BY ALL""")
def table_cut(spark, sf_dir):
    """A new table of an epoch for every 1000 bytes buffered."""
    return kv_ops.tables_cut(kv_only(spark, sf_dir), 1000, ("epoch",)).groupBy("epoch", "tbl").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {_KV}, g AS (SELECT epoch, key, count(*) AS c, sum(strlen(key)) AS k, sum(strlen(value)) AS v FROM kv GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS num_keys, CAST(sum(c - 1) AS BIGINT) AS num_dropped_keys, CAST(sum(k) AS BIGINT) AS key_bytes, CAST(sum(v) AS BIGINT) AS value_bytes, CAST(sum(k + v) AS BIGINT) AS total_user_data FROM g")
def output_stats(spark, sf_dir):
    return metrics.output_stats(kv_only(spark, sf_dir))


@query("SELECT l_orderkey AS key, list_sort(list_distinct(list(l_suppkey % 16))) AS ranks FROM lineitem GROUP BY l_orderkey")
def rank_map(spark, sf_dir):
    return kv_ops.rank_sets(table(spark, sf_dir, "lineitem").withColumn("rank", F.col("l_suppkey") % 16), "l_orderkey", "rank")


@query("""WITH l AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_suppkey % 16 AS BIGINT) AS rank, CAST(l_linenumber AS BIGINT) AS seq, l_returnflag AS value FROM lineitem),
one AS (SELECT key, rank, seq, min(value) AS value FROM l GROUP BY ALL)
SELECT key, rank, string_agg(value, '' ORDER BY seq) AS value FROM one WHERE key IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def rank_get(spark, sf_dir):
    """Keys looked up in the ranks that a filter names, and only there."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), (F.col("l_suppkey") % 16).cast("long").alias("rank"), F.lit(0).alias("epoch"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_returnflag").alias("value"))
    rows = rows.groupBy("key", "rank", "epoch", "seq").agg(F.min("value").alias("value"))
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key"))
    return kv_ops.get_by_rank(keys, kv_ops.rank_sets(rows, "key", "rank"), rows)


# --- ranges --------------------------------------------------------------------------------------------------------

_OBSERVED = f"{_KV}, o AS (SELECT epoch, min(CAST(num AS FLOAT)) AS smallest, max(CAST(num AS FLOAT)) AS largest, count(num) AS n, count(*) FILTER (WHERE NOT (CAST(num AS FLOAT) >= 10 AND CAST(num AS FLOAT) < 200)) AS oob FROM kv GROUP BY epoch)"


def _observed(spark, sf_dir):
    return ranges.observed(events_kv(spark, sf_dir).withColumn("fkey", F.col("num").cast("float")), "fkey", F.lit(10.0), F.lit(200.0), ["epoch"])


@query(f"WITH {_OBSERVED} SELECT * FROM o")
def observed_range(spark, sf_dir):
    return _observed(spark, sf_dir)


@query(f"WITH {_OBSERVED} SELECT min(smallest) AS smallest, max(largest) AS largest, CAST(sum(n) AS BIGINT) AS n, CAST(sum(oob) AS BIGINT) AS oob FROM o")
def range_merge(spark, sf_dir):
    return ranges.merged(_observed(spark, sf_dir))


@query(f"""WITH {_KV}, b AS (SELECT epoch, min(num) AS lo, max(num) AS hi FROM kv GROUP BY epoch),
h AS (SELECT epoch, lag(lo, 1) OVER w AS low1, lag(hi, 1) OVER w AS high1, lag(lo, 2) OVER w AS low2, lag(hi, 2) OVER w AS high2 FROM b WINDOW w AS (ORDER BY epoch))
SELECT epoch, CASE WHEN num >= low1 AND num < high1 THEN 0 WHEN num >= low2 AND num < high2 THEN 1 ELSE 2 END AS blk, count(*) AS n FROM kv JOIN h USING (epoch) GROUP BY ALL""")
def range_route(spark, sf_dir):
    """Each day is routed by the ranges seen on the two days before."""
    from pyspark.sql import Window

    rows = events_kv(spark, sf_dir)
    w = Window.orderBy("epoch")  # a row for each epoch
    seen = rows.groupBy("epoch").agg(F.min("num").alias("lo"), F.max("num").alias("hi"))
    history = seen.select("epoch", *(F.lag(c, i).over(w).alias(f"{name}{i}") for i in (1, 2) for c, name in (("lo", "low"), ("hi", "high"))))
    return ranges.route_by_history(rows, history, "num").groupBy("epoch", "blk").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT value AS k, CASE WHEN value >= 50 AND value < 75 THEN 0 WHEN value >= 75 AND value < 100 THEN 1 WHEN value >= 10 AND value < 60 THEN 2 ELSE 3 END AS blk FROM events)
SELECT 0 AS epoch, 2 AS updcnt, blk, CASE blk WHEN 0 THEN 50.0 WHEN 1 THEN 75.0 WHEN 2 THEN 10.0 END AS rmin, CASE blk WHEN 0 THEN 75.0 WHEN 1 THEN 100.0 WHEN 2 THEN 60.0 END AS rmax, min(k) AS smallest, max(k) AS largest, count(*) AS n, count(*) FILTER (WHERE blk = 3) AS oob FROM e GROUP BY blk""")
def range_table(spark, sf_dir):
    """The manifest of a written range table: two subranges of [50, 100), before that [10, 60), and strays."""
    out = ranges.RangeTable(spark, scratch_path(spark, "range-table"), parts=2, previous=2)
    out.update_bounds(10.0, 60.0)
    out.update_bounds(50.0, 100.0)
    out.add(table(spark, sf_dir, "events").select(F.col("value").alias("fkey"), "event_id"), 0)
    return out.manifest().select("epoch", "updcnt", "blk", F.col("rmin").cast("double").alias("rmin"), F.col("rmax").cast("double").alias("rmax"), "smallest", "largest", "n", "oob")


# --- filters and codecs ----------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def bitmap_ndv(spark, sf_dir):
    return membership.bitmap_count(membership.bitmap(table(spark, sf_dir, "lineitem"), "l_partkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bitmap_member(spark, sf_dir):
    held = membership.bitmap(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")
    return membership.in_bitmap(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", held).select("o_orderkey")


@query("SELECT count(DISTINCT k) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def bitmap_union(spark, sf_dir):
    both = membership.bitmap(table(spark, sf_dir, "orders"), "o_custkey").union(membership.bitmap(table(spark, sf_dir, "customer"), "c_custkey"))
    return membership.bitmap_count(membership.bitmap_united(both))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem), g AS (SELECT s, k - coalesce(lag(k) OVER (PARTITION BY s ORDER BY k), 0) AS delta FROM d)
SELECT s AS l_suppkey, count(*) AS n, CAST(sum(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 WHEN delta < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS bytes FROM g GROUP BY s""")
def vb_deltas(spark, sf_dir):
    from pyspark.sql import Window

    keys = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    delta = F.col("l_partkey") - F.coalesce(F.lag("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_partkey")), F.lit(0))
    return keys.select("l_suppkey", delta.alias("delta")).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(fn.varint_size(F.col("delta"))).alias("bytes"))


def _filtered(spark, sf_dir, kind, **options):
    """Orders asked against filters of the customers of one segment; keys are four bytes, least first."""
    reach_from_workers(spark)
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    keys = c.where("c_mktsegment = 'BUILDING'").select((F.col("c_nationkey") % 4).cast("int").alias("part"), fn.le32(F.col("c_custkey")).alias("key"))
    where = c.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).cast("int").alias("part"), (F.col("c_mktsegment") == "BUILDING").alias("held"))
    asked = o.join(where, "o_custkey").select("part", fn.le32(F.col("o_custkey")).alias("key"), "held").distinct()
    filters = membership.written(membership.build_filters(keys, ["part"], kind, **options), scratch_path(spark, "filters"))
    return asked, membership.probe(asked.select("part", "key"), filters, ["part"], kind, **options)


def _checked(spark, sf_dir, kind, **options):
    """(part, o_custkey, few_false): the keys let through that are in the set, and whether at most 5 % of all others (or 3) were let through."""
    asked, passed = _filtered(spark, sf_dir, kind, **options)
    both = asked.join(passed.distinct().withColumn("passed", F.lit(True)), ["part", "key"], "left")
    rates = both.groupBy("part").agg((F.count_if(~F.col("held") & F.col("passed")) <= F.greatest(F.lit(3.0), 0.05 * F.count_if(~F.col("held")))).alias("few_false"))
    return both.where("held and passed").join(rates, "part").select("part", fn.from_le32(F.col("key")).alias("o_custkey"), "few_false")


_PASSED = """SELECT CAST(c_nationkey % 4 AS INTEGER) AS part, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL"""
_CHECKED = f"SELECT *, true AS few_false FROM ({_PASSED})"


@query(_CHECKED)
def filter_bloom(spark, sf_dir):
    """Keys that a Bloom filter lets through and that are there; few others pass."""
    return _checked(spark, sf_dir, "bloom", bits_per_key=10)


@query(_CHECKED)
def filter_cuckoo(spark, sf_dir):
    return _checked(spark, sf_dir, "cuckoo")


def _bitmap_query(fmt: str):
    def run(spark, sf_dir):
        passed = _filtered(spark, sf_dir, f"bitmap-{fmt}", key_bits=24)[1]
        return passed.select("part", fn.from_le32(F.col("key")).alias("o_custkey"))

    run.__name__ = "filter_bitmap_" + fmt.replace("-", "_").replace("+", "_plus")
    run.__doc__ = f"Exactly the keys that a bitmap in the format {fmt} holds."
    return query(_PASSED)(run)


for _fmt in ("uncompressed", "vb", "vb+", "fast-vb+", "p-f-delta", "fast-p-f-delta", "roar"):
    _bitmap_query(_fmt)


@query("SELECT CAST(c_custkey AS BIGINT) AS k, lower(lpad(to_hex(c_custkey % 256), 2, '0') || lpad(to_hex(c_custkey // 256 % 256), 2, '0') || lpad(to_hex(c_custkey // 65536 % 256), 2, '0') || '00') AS key_hex, CASE WHEN c_custkey = 0 THEN 0 ELSE CAST(floor(log2(c_custkey)) AS INTEGER) + 1 END AS width FROM customer")
def key_codec(spark, sf_dir):
    """Integers as four bytes and back, and the bits of each."""
    key = fn.le32(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(fn.from_le32(key).alias("k"), F.lower(F.hex(key)).alias("key_hex"), fn.bit_width(F.col("c_custkey")).alias("width"))


@query("""SELECT l_suppkey, printf('%04d', CAST(l_suppkey % 100 AS INTEGER)) AS epoch_label, printf('%04d-%04d', CAST(l_suppkey % 100 AS INTEGER), CAST(l_suppkey % 7 AS INTEGER)) AS table_label,
'L-' || lpad(lower(to_hex(l_suppkey)), 8, '0') || '.dat' AS data_log, 'L-' || lpad(lower(to_hex(l_suppkey)), 8, '0') || '.idx.' || lpad(lower(to_hex(l_suppkey % 16)), 2, '0') AS index_log, 'T-' || lpad(lower(to_hex(l_suppkey % 100)), 4, '0') AS rotated
FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def labels_and_names(spark, sf_dir):
    s = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(
        "l_suppkey", fn.epoch_label((s % 100).cast("int")).alias("epoch_label"), fn.table_label((s % 100).cast("int"), (s % 7).cast("int")).alias("table_label"),
        fn.log_name(s).alias("data_log"), fn.log_name(s, "index", s % 16).alias("index_log"), fn.rotated_folder(s % 100).alias("rotated"),
    )


# --- logs and streams ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM documents")
def side_offset(spark, sf_dir):
    return streams.log_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "off")


@query("""WITH l AS (SELECT conv_id, encode(string_agg(text, '' ORDER BY turn)) AS log FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, lower(substr(hex(log), 2 * 100 + 1, 2 * 300)) AS data_hex FROM l WHERE octet_length(log) > 100""")
def side_pread(spark, sf_dir):
    """300 bytes from byte 100 of the log of each conversation."""
    c = table(spark, sf_dir, "conversations")
    log = streams.log_offsets(c.select("conv_id", "turn", "text"), ["turn"], "text", ["conv_id"])
    return streams.pread(log, 100, 300, "text", ["conv_id"]).select("conv_id", F.lower(F.hex("data")).alias("data_hex"))


@query("""WITH d AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS raw FROM documents)
SELECT doc_id AS file_id, lower(substr(hex(raw), 2 * 1000 + 1, 2 * 5000)) AS data_hex FROM d WHERE octet_length(raw) > 0""")
def block_read(spark, sf_dir):
    """5000 bytes from byte 1000 of documents stored in blocks of 4096 bytes."""
    blocks = streams.blocks_of(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return streams.read_blocks(blocks, 1000, 5000).select("file_id", F.lower(F.hex("data")).alias("data_hex"))


@query("SELECT user_id AS file_id, max(ts) AS mtime, max(value) AS size FROM events GROUP BY user_id")
def stream_header(spark, sf_dir):
    return streams.headers(table(spark, sf_dir, "events"), "user_id", "ts", "value")


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE o_custkey % 16 = 3 GROUP BY ALL")
def filter_log_read(spark, sf_dir):
    """A filter written for each epoch, the one of epoch 3 read back and asked about all keys."""
    reach_from_workers(spark)
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).cast("int").alias("epoch"), fn.le32(F.col("o_custkey")).alias("key")).distinct()
    log = streams.FilterLog(spark, scratch_path(spark, "filter-log"))
    log.write(membership.build_filters(keys, ["epoch"], "bitmap-roar", key_bits=24))
    asked = keys.select(F.lit(3).alias("epoch"), "key").distinct()
    return membership.probe(asked, log.read(3), ["epoch"], "bitmap-roar", key_bits=24).select(fn.from_le32(F.col("key")).alias("o_custkey"))


# --- epochs of streams -------------------------------------------------------------------------------------------------


@query(f"""WITH {_KV}, a AS (SELECT epoch, max(epoch) OVER (ORDER BY seq * 7919 % 10007, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM kv)
SELECT epoch, count(*) AS n, count(*) FILTER (WHERE epoch < seen) AS late FROM a GROUP BY epoch""")
def epoch_admission(spark, sf_dir):
    """Writes in a shuffled order of arrival; those behind the epoch reached are late."""
    rows = kv_only(spark, sf_dir).withColumn("at", F.col("seq") * 7919 % 10007)
    return admitted(rows, ["at", "seq"]).groupBy("epoch").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """A file stream written in epochs of one micro-batch each, then read back."""
    path = scratch_path(spark, "stream-counts")
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the table can be one file or a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    rows = rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    write_epochs(rows, path, f"{path}-state", Options(lg_parts=1, mode=Mode.MULTIMAP)).awaitTermination()
    return EpochReader(spark, path).scan().groupBy(F.decode("key", "UTF-8").alias("key")).agg(F.count("*").alias("n"))


# --- namespace -----------------------------------------------------------------------------------------------------


@query(r"SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS name FROM pages")
def ns_list(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+/([^?#]*)", 1).alias("name")).distinct()


@query(r"""WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> '.') AS p FROM pages)
SELECT DISTINCT '/' || array_to_string(p[1:i], '/') AS path, CAST(i AS INTEGER) AS depth FROM (SELECT p, unnest(generate_series(1, len(p))) AS i FROM p)""")
def ns_mkdirs(spark, sf_dir):
    """Folders for the paths of all pages, made in an empty tree, some of them twice; then every path of the tree."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"), "page_id")
    empty = spark.createDataFrame([], namespace.SCHEMA)
    some = namespace.folders_created(empty, paths.where("page_id % 3 = 0"), "path", scratch_path(spark, "mkdirs"), 1, 1)
    after = namespace.folders_created(some, paths, "path", scratch_path(spark, "mkdirs"), 2, 1 << 40)
    return namespace.all_paths(after, scratch_path(spark, "mkdirs-paths")).select("path", F.col("depth").cast("int").alias("depth"))


@query(f"""WITH RECURSIVE {_INODES}, t AS (SELECT ino, '/' || name AS path, 1 AS depth FROM inodes WHERE dir_ino = 0
UNION ALL SELECT i.ino, t.path || '/' || i.name, t.depth + 1 FROM t JOIN inodes i ON i.dir_ino = t.ino)
SELECT path, ino, depth FROM t""")
def ns_resolve(spark, sf_dir):
    """Every path of the tree, a level of folders at a time."""
    return namespace.all_paths(tree(spark, sf_dir), scratch_path(spark, "ns-resolve"))


_STAT = f"""WITH {_INODES}, p AS (SELECT c_custkey, c_name, c_nationkey, '/' || r_name || CASE WHEN c_custkey % 5 = 4 THEN '/./NOWHERE/' ELSE '//' || n_name || '/' END || c_name || CASE WHEN c_custkey % 3 = 2 THEN 'x' ELSE '' END AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT p.path, CASE WHEN c_custkey % 5 = 4 OR c_custkey % 3 = 2 THEN NULL ELSE i.ino END AS ino, i.mode, i.uid, i.gid, i.ctime FROM p JOIN inodes i ON i.ino = 1000 + c_custkey)"""


@query(f"{_STAT} SELECT path, CASE WHEN ino IS NULL THEN 'not_found' ELSE 'ok' END AS status, ino, CASE WHEN ino IS NOT NULL THEN mode END AS mode FROM s")
def ns_stat(spark, sf_dir):
    return namespace.stat_many(tree(spark, sf_dir), customer_paths(spark, sf_dir).select("path"), most_depth=4).select("path", "status", "ino", "mode")


@query(f"""{_STAT} SELECT path, (uid = 3 AND mode // 64 & 4 = 4) OR (gid = 2 AND mode // 8 & 4 = 4) OR (mode & 4 = 4) AS may_read FROM s WHERE ino IS NOT NULL""")
def ns_access(spark, sf_dir):
    """Which files user 3 of group 2 may read."""
    found = namespace.stat_many(tree(spark, sf_dir), customer_paths(spark, sf_dir).select("path"), user=3, group=2, most_depth=4).where("status = 'ok'")
    return found.select("path", fn.allowed(F.col("mode"), F.col("uid"), F.col("gid"), 3, 2, 4).alias("may_read"))


@query(f"""WITH {_INODES}, w AS (SELECT DISTINCT 100 + c_nationkey AS dir_ino, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new-' || c_name END AS name FROM customer)
SELECT dir_ino, count(*) AS size FROM (SELECT dir_ino, name FROM inodes UNION SELECT dir_ino, name FROM w) GROUP BY dir_ino""")
def ns_create(spark, sf_dir):
    """Files created in bulk, half of which are there already; then the size of each folder."""
    c = table(spark, sf_dir, "customer")
    wanted = c.select((F.col("c_nationkey") + 100).cast("long").alias("dir_ino"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new-"), "c_name")).alias("name"), F.lit(0o644).alias("mode"), F.lit(1).alias("uid"), F.lit(1).alias("gid"))
    after, _ = namespace.created(tree(spark, sf_dir), wanted, fn.REGULAR, now=1, first_ino=1 << 40)
    return namespace.dir_info(after).select("dir_ino", "size")


@query(f"WITH {_INODES} SELECT dir_ino, name, ino FROM inodes WHERE NOT (ino >= 1000 AND (ino - 1000) % 4 = 1)")
def ns_unlink(spark, sf_dir):
    """Every fourth file goes; folders are not touched even if named."""
    inodes = tree(spark, sf_dir)
    gone = inodes.where("ino < 1000 or (ino - 1000) % 4 = 1").select("dir_ino", "name")
    return namespace.without(inodes, gone).select("dir_ino", "name", "ino")


@query(f"WITH {_INODES} SELECT ino, CAST(CASE WHEN ino >= 1000 AND uid = 3 THEN 32768 + 416 ELSE mode END AS INTEGER) AS mode, CASE WHEN ino >= 1000 AND uid = 3 THEN 9 ELSE gid END AS gid FROM inodes")
def ns_chmod(spark, sf_dir):
    """chmod 0640 and a new group for all files of user 3."""
    mine = fn.is_regular(F.col("mode")) & (F.col("uid") == 3)
    return namespace.changed(tree(spark, sf_dir), mine, permissions=0o640, gid=9).select("ino", "mode", "gid")


@query(f"WITH {_INODES} SELECT dir_ino, count(*) AS size, max(ctime) AS mtime FROM inodes GROUP BY dir_ino")
def ns_dir_info(spark, sf_dir):
    return namespace.dir_info(tree(spark, sf_dir))


@query(f"""WITH {_INODES}, h AS (SELECT o_custkey + 1000 AS file_id, max(epoch_us(o_orderdate)) AS mtime, max(o_orderkey) AS size FROM orders GROUP BY ALL)
SELECT ino, coalesce(h.size, 0) AS size, coalesce(h.mtime, i.ctime) AS mtime FROM inodes i LEFT JOIN h ON file_id = ino""")
def ns_data_stat(spark, sf_dir):
    """Size and time of files from the headers of their data."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).cast("long").alias("f"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_orderkey").cast("long").alias("s"))
    return namespace.with_data_stat(tree(spark, sf_dir), streams.headers(o, "f", "t", "s")).select("ino", "size", "mtime")


@query(r"""SELECT DISTINCT url, '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM pages""")
def ns_paths(spark, sf_dir):
    """Paths made absolute and tidy."""
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("url", F.concat(F.lit("/"), F.array_join(fn.path_parts(fn.full_path(path)), "/")).alias("path")).distinct()


# --- metrics -------------------------------------------------------------------------------------------------------

_HISTO = f"{_KV}, g AS (SELECT key, epoch, count(*) AS c FROM kv GROUP BY ALL), h AS (SELECT least(c, 9) AS bucket, count(*) AS n FROM g GROUP BY ALL)"


def _histogram(spark, sf_dir):
    return metrics.histogram(kv_only(spark, sf_dir).groupBy("key", "epoch").count(), F.col("count"))


@query(f"WITH {_HISTO} SELECT * FROM h")
def seek_histo(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(f"WITH {_HISTO} SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM h")
def seek_cdf(spark, sf_dir):
    return metrics.cumulative(_histogram(spark, sf_dir))


@query("SELECT l_suppkey % 8 AS rank, max(l_shipdate) AS duration, count(*) AS ops, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM lineitem GROUP BY ALL")
def rank_reduce(spark, sf_dir):
    return metrics.reduced(table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 8, F.col("l_shipdate"), F.lit(1), F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


@query("SELECT event_type AS op, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS n_ok FROM events GROUP BY ALL")
def op_counts(spark, sf_dir):
    return metrics.op_counts(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50)


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events")
def write_gaps(spark, sf_dir):
    return metrics.gaps(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), ["event_id"]).select("event_id", "gap")


# --- engines and written tables --------------------------------------------------------------------------------------------


def _kv_binary(spark, sf_dir):
    return kv_only(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "seq", "epoch")


@query(f"WITH {_KV} SELECT key, arg_min(value, seq) AS value FROM kv WHERE key = '13' GROUP BY key")
def engine_plain(spark, sf_dir):
    """A table of unordered blocks with a Bloom filter each: a key is read from the blocks that may hold it."""
    reach_from_workers(spark)
    t = engines.create(spark, scratch_path(spark, "plain"), "plaindb", Options(block_size=4 << 10, bf_bits_per_key=12))
    t.put(_kv_binary(spark, sf_dir))
    found = engines.open_table(spark, t.path, "plaindb").plan_get(b"13")
    return found.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _level(spark, sf_dir, engine):
    t = engines.create(spark, scratch_path(spark, engine), engine)
    rows = _kv_binary(spark, sf_dir)
    for low, high in ((0, 10), (10, 20)):  # two epochs of two runs each
        for half in (0, 1):
            t.put(rows.where((F.col("epoch") >= low) & (F.col("epoch") < high) & ((F.col("epoch") - low >= 5) == bool(half))))
        t.epoch_flush()
    found = t.get_many()
    return found.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


_LEVEL = f"WITH {_KV}, g AS (SELECT epoch // 10 AS e, key, arg_max(value, CAST(epoch AS BIGINT) * 1000000000 + seq) AS value FROM kv WHERE epoch >= 0 AND epoch < 20 GROUP BY ALL) SELECT key, string_agg(value, '' ORDER BY e) AS value FROM g GROUP BY key"


@query(_LEVEL)
def engine_level(spark, sf_dir):
    """Last value of each epoch from runs that are merged when the epoch ends."""
    return _level(spark, sf_dir, "leveldb")


@query(_LEVEL)
def engine_level_zero(spark, sf_dir):
    """The same from runs left as they were flushed, with Bloom filters."""
    return _level(spark, sf_dir, "leveldb-l0-bloom")


@query("SELECT CAST(0 AS BIGINT) AS n")
def engine_nothing(spark, sf_dir):
    """An engine that takes all rows and keeps none: how many files it left."""
    t = engines.create(spark, scratch_path(spark, "nothing"), "nothing")
    t.put(_kv_binary(spark, sf_dir))
    return spark.range(1).select(F.lit(stored_bytes(spark, t.path)).cast("long").alias("n"))


def _filtered_table(spark, sf_dir, **options):
    """Orders as a table of four epochs, keys of four bytes, one part."""
    writer = EpochWriter(spark, scratch_path(spark, "filtered-table"), Options(mode=Mode.MULTIMAP, bm_key_bits=24, **options))
    o = table(spark, sf_dir, "orders")
    for e in range(4):
        writer.put(o.where(F.col("o_custkey") % 8 == 2 * e).select(fn.le32(F.col("o_custkey")).alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq")))
        writer.epoch_flush()
    writer.finish()
    return EpochReader(spark, writer.path)


_HEX = "lower(lpad(to_hex(c_custkey % 256), 2, '0') || lpad(to_hex(c_custkey // 256 % 256), 2, '0') || lpad(to_hex(c_custkey // 65536 % 256), 2, '0') || '00')"
_SEEKS = f"""k AS (SELECT c_custkey, {_HEX} AS key FROM customer), o AS (SELECT DISTINCT o_custkey % 8 // 2 AS epoch, k.key FROM orders JOIN k ON o_custkey = c_custkey WHERE o_custkey % 2 = 0),
m AS (SELECT epoch, min(key) AS low, max(key) AS high FROM o GROUP BY epoch),
s AS (SELECT c_custkey, (SELECT count(*) FROM m WHERE k.key BETWEEN low AND high) AS table_seeks, (SELECT count(*) FROM o WHERE o.key = k.key) AS seeks FROM k)"""


@query(f"WITH {_SEEKS} SELECT CAST(c_custkey AS BIGINT) AS c_custkey, table_seeks, seeks FROM s")
def table_seeks(spark, sf_dir):
    """For each key the tables whose key range holds it, and those that are read after their bitmap filters: exactly those that have it."""
    reach_from_workers(spark)
    reader = _filtered_table(spark, sf_dir, filter="bitmap", bm_fmt="fast-vb+")
    found = reader.seeks(table(spark, sf_dir, "customer").select(fn.le32(F.col("c_custkey")).alias("key")))
    return found.select(fn.from_le32(F.col("key")).alias("c_custkey"), "table_seeks", "seeks")


@query(f"WITH {_SEEKS} SELECT CAST(table_seeks AS BIGINT) AS bucket, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY table_seeks) AS BIGINT) AS cum, CAST(sum(count(*)) OVER () AS BIGINT) AS total, (SELECT avg(table_seeks) FROM s) AS mean, (SELECT CAST(max(table_seeks) AS BIGINT) FROM s) AS most FROM s GROUP BY table_seeks")
def seek_stats(spark, sf_dir):
    """Histogram, cumulative counts, mean and maximum of the table seeks of all keys, filters ignored."""
    reach_from_workers(spark)
    reader = _filtered_table(spark, sf_dir, filter="bitmap", bm_fmt="vb")
    found = EpochReader(spark, reader.path, ignore_filters=True).seeks(table(spark, sf_dir, "customer").select(fn.le32(F.col("c_custkey")).alias("key")))
    return metrics.summarised(found, F.col("seeks"))


@query("SELECT CAST(o_custkey % 8 // 2 AS INTEGER) AS epoch, count(*) AS num_keys, CAST(4 * count(*) AS BIGINT) AS key_bytes, CAST(sum(strlen(o_orderstatus)) AS BIGINT) AS value_bytes, true AS stored FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL")
def table_properties(spark, sf_dir):
    """Sizes of each epoch from the manifest, with data, index and filter bytes on disk for all of them."""
    reach_from_workers(spark)
    reader = _filtered_table(spark, sf_dir, filter="bitmap", bm_fmt="p-f-delta")
    p = reader.properties()
    stored = p["data_bytes"] > 0 and p["index_bytes"] > 0 and p["filter_bytes"] > 0 and p["io_bytes"] == p["data_bytes"] + p["index_bytes"] + p["filter_bytes"]
    return reader.manifest().groupBy("epoch").agg(F.sum("n").alias("num_keys"), F.sum("key_bytes").alias("key_bytes"), F.sum("value_bytes").alias("value_bytes")).withColumn("stored", F.lit(stored))


def _side(spark, sf_dir):
    """(rows, filters): line items as (key, rank), and cuckoo filters that hold the ranks of each key."""
    reach_from_workers(spark)
    rows = table(spark, sf_dir, "lineitem").select(fn.le32(F.col("l_orderkey")).alias("key"), (F.col("l_suppkey") % 16).cast("long").alias("rank"))
    return rows, membership.written(membership.build_value_filters(rows, [], "rank", mark_bits=12, value_bits=8), scratch_path(spark, "side-filters"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, list_sort(list_distinct(list(CAST(l_suppkey % 16 AS BIGINT)))) AS ranks, true AS few_false FROM lineitem GROUP BY l_orderkey")
def side_ranks(spark, sf_dir):
    """The ranks that a side filter names for each key, checked against the data; at most 5 % more are named than there are."""
    rows, filters = _side(spark, sf_dir)
    named = membership.candidate_values(rows.select("key").distinct(), filters, [], 12, 8).withColumnRenamed("value", "rank")
    mixed = named.withColumn("there", F.lit(False)).union(rows.withColumn("there", F.lit(True))).repartition("key")  # one exchange for both groupings
    both = mixed.groupBy("key", "rank").agg(F.bool_or(~F.col("there")).alias("named"), F.bool_or("there").alias("there")).where("named")
    found = both.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.col("rank")))).alias("ranks"), F.count("*").alias("n"))
    path = scratch_path(spark, "side-ranks")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    few = found.agg((F.sum(F.col("n") - F.size("ranks")) <= 0.05 * F.sum("n")).alias("few_false"))
    return found.where(F.size("ranks") > 0).crossJoin(F.broadcast(few)).select(fn.from_le32(F.col("key")).alias("l_orderkey"), "ranks", "few_false")  # one row


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_suppkey % 16 AS BIGINT) AS rank, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def side_rank_get(spark, sf_dir):
    """Keys looked up in the ranks that a side filter names, and only there; a rank named by chance gives nothing."""
    rows, filters = _side(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(fn.le32(F.col("o_orderkey")).alias("key")).distinct()
    where = membership.candidate_values(asked, filters, [], 12, 8).withColumnRenamed("value", "rank")
    data = rows.groupBy("key", "rank").agg(F.count("*").alias("n"))
    return data.join(where, ["key", "rank"], "left_semi").select(fn.from_le32(F.col("key")).alias("l_orderkey"), "rank", "n")


# --- moving ranges and leases ------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT value AS k, CAST(event_id % 3 AS INTEGER) AS batch FROM events), b AS (SELECT batch, min(k) AS lo, max(k) AS hi FROM e GROUP BY batch),
h AS (SELECT batch, lag(lo, 1) OVER w AS l1, lag(hi, 1) OVER w AS h1, lag(lo, 2) OVER w AS l2, lag(hi, 2) OVER w AS h2 FROM b WINDOW w AS (ORDER BY batch)),
r AS (SELECT batch, k, CASE WHEN k >= l1 AND k < h1 THEN 0 WHEN k >= l2 AND k < h2 THEN 1 ELSE 2 END AS blk FROM e JOIN h USING (batch))
SELECT batch, batch AS updcnt, blk, min(k) AS smallest, max(k) AS largest, count(*) AS n, count(*) FILTER (WHERE blk = 2) AS oob FROM r GROUP BY batch, blk""")
def range_update(spark, sf_dir):
    """Three micro-batches, each by the range of the one before; the second one is run twice, by a table opened anew."""
    path = scratch_path(spark, "range-update")
    e = table(spark, sf_dir, "events").select(F.col("value").alias("fkey"), "event_id")
    for number in (0, 1, 1, 2):
        put_ranges(ranges.RangeTable(spark, path), e.where(F.col("event_id") % 3 == number), number)
    return ranges.RangeTable(spark, path).manifest().select("batch", "updcnt", "blk", "smallest", "largest", "n", "oob")


@query("""WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS name, epoch_us(ts) AS t, event_type = 'purchase' AS change, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type = 'purchase') AS i FROM events),
s AS (SELECT name, t, i, CASE WHEN change THEN 1 ELSE 0 END AS seq, CASE WHEN change THEN CAST(0 AS BIGINT) ELSE t + 86400000000 END AS due, true AS granted FROM c WHERE i = 1
UNION ALL SELECT c.name, c.t, c.i, s.seq + CASE WHEN c.change AND c.t >= s.due THEN 1 ELSE 0 END, CASE WHEN c.change OR c.t < s.due THEN s.due ELSE c.t + 86400000000 END, NOT c.change OR c.t >= s.due FROM s JOIN c ON c.name = s.name AND c.i = s.i + 1)
SELECT name, t AS "at", CAST(seq AS BIGINT) AS seq, due, granted, count(*) AS n FROM s GROUP BY ALL""")
def lease_log(spark, sf_dir):
    """Leases of a day on each user: lookups share one until it is due, a change waits for that."""
    reach_from_workers(spark)
    path = scratch_path(spark, "leases")
    schema = table(spark, sf_dir, "events").schema
    calls = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    calls = calls.select(F.col("user_id").cast("string").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "purchase").alias("change"))
    leases(calls, 86_400_000_000).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name string, at long, seq long, due long, granted boolean").parquet(path).groupBy("name", "at", "seq", "due", "granted").agg(F.count("*").alias("n"))


# --- more of the namespace -----------------------------------------------------------------------------------------------------


@query(f"WITH {_INODES}, r AS (SELECT dir_ino, name, row_number() OVER (PARTITION BY dir_ino ORDER BY name) AS i FROM inodes) SELECT dir_ino, name FROM r WHERE i <= 1000")
def ns_listdir(spark, sf_dir):
    """The names of every folder, the first 1000 of each."""
    return namespace.listing(tree(spark, sf_dir))


@query(f"""WITH {_INODES}, w AS (SELECT CAST(CASE c_custkey % 4 WHEN 0 THEN 100 + c_nationkey WHEN 1 THEN 1000 + c_custkey WHEN 2 THEN 999999999 ELSE 0 END AS BIGINT) AS dir_ino, CASE WHEN c_custkey % 10 = 3 THEN repeat('x', 256) ELSE 'new-' || c_name END AS name FROM customer)
SELECT w.dir_ino, w.name, CASE WHEN length(w.name) > 255 THEN 'name_too_long' WHEN w.dir_ino = 0 THEN 'ok' WHEN i.ino IS NULL THEN 'not_found' WHEN i.mode & 61440 <> 16384 THEN 'dir_expected'
WHEN (i.uid = 3 AND (i.mode // 64) & 3 = 3) OR (i.gid = 2 AND (i.mode // 8) & 3 = 3) OR i.mode & 3 = 3 THEN 'ok' ELSE 'access_denied' END AS status, count(*) AS n
FROM w LEFT JOIN inodes i ON i.ino = w.dir_ino GROUP BY ALL""")
def ns_denied(spark, sf_dir):
    """What user 3 of group 2 may create, and why not: folders are not theirs, no folders, not there, names too long."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    folder = F.when(k % 4 == 0, F.col("c_nationkey") + 100).when(k % 4 == 1, k + 1000).when(k % 4 == 2, 999999999).otherwise(0).cast("long")
    wanted = c.select(folder.alias("dir_ino"), F.when(k % 10 == 3, F.repeat(F.lit("x"), 256)).otherwise(F.concat(F.lit("new-"), "c_name")).alias("name"))
    return namespace.may_create(tree(spark, sf_dir), wanted, 3, 2).groupBy("dir_ino", "name", "status").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT 'f' || n_nationkey AS name, encode(n_name || ':' || n_regionkey) AS raw FROM nation)
SELECT name, lower(hex(raw)) AS data_hex, CAST(octet_length(raw) AS BIGINT) AS size FROM n UNION ALL SELECT 'key', lower(hex(encode('v1v2v3'))), 6""")
def ns_file_read(spark, sf_dir):
    """Files written through handles, closed and read by another client; and values of one key written over two epochs of an indexed folder."""
    n = namespace.Namespace(spark)
    n.mkdirs("/data/plain")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 rows
        fd = n.open(f"/data/plain/f{r[0]}", create=True, write=True)
        n.write(fd, r[1].encode())
        n.pwrite(fd, f":{r[2]}".encode(), len(r[1]))
        n.close(fd)
    n.mkdir("/data/keys", indexed=True)
    folder = n.open("/data/keys", write=True)
    fd = n.openat(folder, "key", write=True)
    for value in (b"v1", b"v2"):
        n.write(fd, value)
    n.flush(folder)
    n.write(fd, b"v3")
    n.close(fd)
    n.close(folder)
    other = n.session(cwd="/data")
    inodes = other.inodes.where(F.col("name").rlike("^f[0-9]+$")).select("name", F.col("ino").alias("file_id"), "size")
    blocks = spark.read.schema("seq long, off long, len long, data binary, file_id long").parquet(f"{n.tree.store}/blocks")
    plain = inodes.join(streams.read_blocks(blocks, 0, 1 << 20), "file_id").select("name", F.lower(F.hex("data")).alias("data_hex"), "size")
    value = other.cat("keys/key")
    return plain.union(spark.range(1).select(F.lit("key"), F.lit(value.hex()), F.lit(len(value)).cast("long")))


@query(f"WITH {_INODES} SELECT ino AS st_ino, mode AS st_mode, CAST(ctime * 1234567 // 1000000 AS BIGINT) AS st_mtime, CAST(ctime * 1234567 % 1000000 * 1000 AS BIGINT) AS st_mtime_nsec, CAST(ctime * 1234567 // 1000000 AS BIGINT) AS st_atime FROM inodes")
def ns_stat_fields(spark, sf_dir):
    """Inodes as stat fields: seconds and nanoseconds, access time as modification time."""
    t = F.col("ctime") * 1234567
    s = tree(spark, sf_dir).select(fn.stat_struct(F.col("ino"), F.col("mode"), F.col("uid"), F.col("gid"), F.col("size"), t, t).alias("s"))
    return s.select("s.st_ino", "s.st_mode", "s.st_mtime", "s.st_mtime_nsec", "s.st_atime")


@query("SELECT event_id, CAST(value AS FLOAT) AS value, CAST(4 AS INTEGER) AS size FROM events")
def float_codec(spark, sf_dir):
    """Values as 32-bit floats of four bytes, and back."""
    e = table(spark, sf_dir, "events").select("event_id", fn.float_le(F.col("value").cast("float")).alias("raw"))
    return e.select("event_id", fn.from_float_le(F.col("raw")).alias("value"), F.octet_length("raw").alias("size"))


# --- order and names --------------------------------------------------------------------------------------------------------------


def _out_of_order(rows: DataFrame, *order) -> DataFrame:
    """(n, wrong): rows, and how many of them come before the row ahead of them in their file."""
    from pyspark.sql import Window

    own = Window.partitionBy("file").orderBy("place")
    placed = rows.select(F.struct(*order).alias("x"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    return placed.withColumn("before", F.lag("x").over(own)).agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("x")).alias("wrong"))


@query(f"WITH {_KV} SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM kv WHERE epoch >= 0 AND epoch < 30")
def table_order(spark, sf_dir):
    """Files of a written table are sorted by key and order of writing."""
    writer = EpochWriter(spark, scratch_path(spark, "table-order"), Options(lg_parts=2, mode=Mode.MULTIMAP))
    writer.put(kv_only(spark, sf_dir, low=0, high=30).select("key", "value", "seq"))
    writer.finish()
    return _out_of_order(EpochReader(spark, writer.path).rows(), "part", "key", "seq")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM events")
def range_order(spark, sf_dir):
    """Files of a range table are sorted by block and key."""
    out = ranges.RangeTable(spark, scratch_path(spark, "range-order"), parts=4)
    out.update_bounds(10.0, 90.0)
    out.add(table(spark, sf_dir, "events").select(F.col("value").alias("fkey"), "event_id"), 0)
    return _out_of_order(out.rows(), "blk", "fkey")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_suppkey % 100 AS INTEGER) AS epoch, CAST(l_suppkey % 7 AS INTEGER) AS tbl,
'PlfsDir_' || lpad(upper(to_hex(l_suppkey)), 16, '0') AS folder, CAST((32768 + l_suppkey % 512) & ~18 AS INTEGER) AS mode FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def labels_parsed(spark, sf_dir):
    """Labels of tables read back, names of key folders, modes under a umask."""
    s = F.col("l_suppkey")
    epoch, tbl = fn.parsed_label(fn.table_label((s % 100).cast("int"), (s % 7).cast("int")))
    key = F.unhex(F.lpad(F.hex(s), 16, "0"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(s.cast("long").alias("l_suppkey"), epoch.alias("epoch"), tbl.alias("tbl"), fn.folder_name(key).alias("folder"), fn.masked((s % 512 + fn.REGULAR).cast("int"), 0o022).alias("mode"))
