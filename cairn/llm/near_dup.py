"""Near-duplicate documents by one-permutation MinHash with exact confirmation.

1. Each text becomes its set of word shingles. Equal sets are collapsed onto their smallest document first.
2. One hash permutation fills ``BANDS * ROWS`` bins with the least hash of each; an empty bin takes the value of the first
   filled bin of its own random order of bins (optimal densification: no second look at the text, and borrowed values stay
   independent between bins).
3. Bands of ``ROWS`` bins are bucket keys. In every bucket the document that sits in the largest buckets over all is the
   hub: each other document is a candidate of the hub only, so that pair counts follow the number of documents and not its
   square.
4. Candidates are confirmed on full sets; confirmed links join components.
5. Buckets whose members are not yet of one component are looked at again: pairs of different components, one of them
   outside the bucket's largest one, are weighed by odd sketches (parities of the hashes in each of ``2**k`` places). The
   places in which two sketches differ are at most as many as the shingles in which the sets differ, so that a pair beyond
   the threshold by its sketches is beyond it for sure; all others are confirmed on full sets. No pair that shares a bucket
   and could be a link is left out, so every link that any bucket holds is honoured.

A pair at the threshold of 0.8 shares none of the 48 buckets with probability 5e-7, and less above it; thresholds for which the
bands at hand would miss more than ``MOST_MISSED`` are refused, and so are those under 50 %, as sketches fold once.

Skew: a hub's partners are dealt into groups by salts, the hub's text is handed out in two steps; buckets that are open are
joined in salted parts of about ``PART`` rows.

Cases: texts without words (null, empty, blank) have the empty set and stand alone; a null id stands alone with a null
component and is kept; rows that repeat an id are one document; extra columns are never read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.frames import as_text, in_slices
from cairn.llm.shingles import mixed, shingle_set
from cairn.llm.storage import Scratch

BANDS, ROWS = 48, 6
SHINGLE = 5
PERCENT = 80
GROUP, SALTS, PART = 64, 64, 256
MOST_MISSED = 1e-6
SKETCH_MOST = 256
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """For every bin its own random order of all bins."""
    return np.argsort(np.random.default_rng(20240229).random((bins, bins)), axis=1).astype(np.int32)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Least hash of each bin of one permutation, empty bins densified. ``hashes`` are sorted and not empty."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    used, first = np.unique(at, return_index=True)
    out = np.zeros(bins, dtype=np.uint64)
    used = used.astype(np.int64)
    out[used] = hashes[first]
    if len(used) < bins:
        full = np.zeros(bins, dtype=bool)
        full[used] = True
        empty = np.nonzero(~full)[0]
        orders = _orders(bins)
        # a few steps settle most bins; what is left looks at its whole order
        source = np.full(len(empty), -1)
        for step in range(4):
            todo = source < 0
            at_step = orders[empty, step]
            source = np.where(todo & full[at_step], at_step, source)
        rest = np.nonzero(source < 0)[0]
        if len(rest):
            rows = orders[empty[rest]]
            source[rest] = rows[np.arange(len(rest)), full[rows].argmax(axis=1)]
        out[empty] = out[source]
    return out


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature(hashes, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mixed(key ^ s[:, k]) + np.uint64(k)
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes in each place, as 64-bit words: about three places a hash, in powers of two."""
    words = min(SKETCH_MOST, max(4, 1 << (3 * len(hashes) // 64).bit_length()))
    counts = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def apart(x: str, y: str) -> Column:
    """In how many places two sketches differ; the longer one is folded onto the shorter, once at most (sizes are close)."""
    fold = "transform(slice({0}, 1, size({1})), (v, i) -> v ^ element_at({0}, i + 1 + size({1})))"
    one = f"CASE WHEN size({x}) > size({y}) THEN {fold.format(x, y)} ELSE {x} END"
    other = f"CASE WHEN size({y}) > size({x}) THEN {fold.format(y, x)} ELSE {y} END"
    return F.expr(f"aggregate(zip_with({one}, {other}, (p, q) -> bit_count(p ^ q)), 0, (n, k) -> n + k)")


def signatures(rows: DataFrame, shingle: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, odd) from (doc_id, text); set_a and set_b are a hash of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sizes, a, b, keys, odds = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, shingle)
                whole = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
                sizes.append(len(h))
                a.append(int(whole[0]))
                b.append(int(whole[1]))
                keys.append(band_keys(h, bands, per_band) if len(h) else np.zeros(0, dtype=np.int64))
                odds.append(odd_sketch(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"])

    return rows.mapInArrow(run, SIGNATURES)


def confirmed(edges: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full shingle sets are similar enough.

    A hub's partners are dealt into groups of about ``GROUP``; each group gets one copy of the hub's text, and the rows of
    a group stream past it.
    """
    spread = edges.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    # hubs of one group need no count; the others' are looked up with a salt, as one hub can have most partners
    large = spread.where("groups > 1").select("a", "groups", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(3)), F.lit(SALTS)).cast("int"))
    edges = salted.join(large, ["a", "salt"], "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"), F.lit(0)).alias("g"))
    # the hub's text for up to SALTS heads, and from each of them to its groups
    heads = spread.select("a", F.explode(F.sequence(F.lit(0), F.least("groups", F.lit(SALTS)) - 1)).alias("head")).join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    own = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g")).withColumn("head", F.col("g") % SALTS)
    hubs = own.join(heads, ["a", "head"]).select("a", "g", F.lit(None).cast("long").alias("b"), "text")
    others = edges.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "g", "b", "text")
    dealt = hubs.union(others).repartition("a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in in_slices(batches):
            left, right = [], []
            for a, g, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h = shingle_set(text, shingle)
                if b is None:
                    hub, own = (a, g), h
                elif hub == (a, g):
                    both = len(np.intersect1d(own, h, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(h) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; links are shingle sets of at least ``percent`` % overlap."""
    if not 50 <= percent <= 100 or (1 - (percent / 100) ** rows) ** bands > MOST_MISSED:
        raise ValueError(f"{bands} bands of {rows} rows would miss too many pairs of {percent} %")
    scratch = Scratch(df.sparkSession, "near-dup")
    texts = as_text(df, id_col, text_col)
    sets = signatures(texts, shingle, bands, rows)
    # empty sets are linked with nothing: each has a key of its own, so that they do not meet in one task
    sets = scratch.write(sets.withColumn("set_a", F.when(F.col("n_shingles") > 0, F.col("set_a")).otherwise(F.xxhash64("doc_id"))))
    alike = scratch.write(sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    reps = sets.join(alike, ["set_a", "set_b"]).where("doc_id = rep").select("doc_id", "n_shingles", "bands")
    banded = scratch.write(reps.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("key")))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = banded.join(shared, "key").withColumn("w", F.sum("c").over(Window.partitionBy("doc_id"))).drop("c")
    members = scratch.write(members)
    scratch.drop(banded)
    known = scratch.write(texts.join(members.select("doc_id").distinct(), "doc_id"))
    sized = lambda n, m: F.least(n, m) * 100 >= percent * F.greatest(n, m)
    # the hub of a bucket: of most weight, then of least id
    hubs = members.groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("m"), "n")).alias("hub")).select("key", (-F.col("hub.m")).alias("a"), F.col("hub.n").alias("na"))
    pairs = members.join(hubs, "key").where((F.col("doc_id") != F.col("a")) & sized(F.col("n"), F.col("na"))).select("a", F.col("doc_id").alias("b"))
    tested = scratch.write(pairs.distinct())
    labels, stars = components(confirmed(tested, known, shingle, percent), scratch)
    # buckets that still hold two components
    labelled = scratch.write(members.drop("w").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    several = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("major"), F.ceil(F.sum("c") / PART).cast("int").alias("parts"))
    open_ = labelled.join(several.where("labels > 1").drop("labels"), "key")
    open_ = scratch.write(open_.join(sets.select("doc_id", "odd"), "doc_id"))
    one = open_.where("label <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "label", "odd")))
    close = apart("x_odd", "odd") * (100 + percent) <= (F.col("x_n") + F.col("n")) * (100 - percent)
    once = (F.col("label") == F.col("major")) | (F.col("x_doc_id") < F.col("doc_id"))
    more = one.join(open_.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int")), ["key", "part"]).where((F.col("x_label") != F.col("label")) & once & sized(F.col("x_n"), F.col("n")) & close)
    unordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    more = more.select(*unordered("x_doc_id", "doc_id")).distinct().join(tested.select(*unordered("a", "b")), ["a", "b"], "left_anti")
    more = scratch.write(more)
    if not more.isEmpty():
        labels, _ = components(confirmed(more, known, shingle, percent).union(stars), scratch)
    scratch.keep(sets, alike, labels)
    out = sets.join(alike, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, unchanged, whose document is the first of its component."""
    kept = near_duplicates(df, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return df.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")
