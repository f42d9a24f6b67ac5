"""Approximate nearest neighbours by cosine, with a hash-prefix forest.

A vector's hash string in a tree has ``LETTERS`` letters; each is the largest of the vector's coordinates, with its sign,
after a random rotation. A tree is the sorted array of these strings, cut into blocks of at most ``BLOCK`` entries that hold
the vectors in eight bits a coordinate. ``TREES`` trees are kept.

1. Descent: in every tree a query goes to the block in which its string falls, and to the longest prefix that at least
   ``LEAST`` entries of the block share. The (k+1)-th best score of these entries bounds how near the answers are.
2. Synchronous ascent: for that score the odds are known that a neighbour shares a prefix of d letters in some tree. All
   trees go up together to the longest prefix for which these odds reach ``TARGET``. Above one letter a query goes on to the
   other letters of the first place, in order of its own coordinates. The blocks that these runs of the sorted arrays touch
   are looked up by their bounds, and their entries in the runs are scored; no other block is read for the query.
3. Eight bits bound every score from both sides. What can still be among the k + 1 best is scored exactly, in double
   precision, and ranked by score and id, so that ties never depend on the order of scoring.

How far a query ascends depends on its own neighbourhood, not on the size of the table. In clustered data a few hundredths of
the entries are scored; in 64 dimensions without any structure it takes three tenths (figures in the README). A letter's
entries are dealt by a salt into sorted arrays of at most ``GROUP`` entries, so that no task sorts or holds more.

Vectors that are equal but for a power of two are one entry, with the smallest ids that an answer can need; they are collapsed
within each batch before anything moves.

Cases: null, empty and zero vectors and such with null or non-finite components take no part, nor do null ids; vectors of
different lengths are not compared; rows of equal id are never each other's neighbours; equal scores rank by id; with fewer
candidates than asked for, all are given; extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import Scratch

NEIGHBOURS = 5
EVERY = 50
TREES, LETTERS = 16, 8
BLOCK, GROUP = 8192, 1 << 19
LEAST, TARGET = 64, 0.9
WIDEST = 128  # coordinates that can be letters: a letter with its sign is one byte
_ROUNDING = 1e-5  # of scores in single precision


# --- hash strings ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _rotations(dim: int, trees: int) -> np.ndarray:
    """(dim, trees * LETTERS * w): w = min(dim, WIDEST) orthonormal directions for each letter."""
    rng, width = np.random.default_rng(977), min(dim, WIDEST)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, width)))[0].astype(np.float32) for _ in range(trees * LETTERS)], axis=1)


def strings(unit: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash strings as signed integers that sort as the strings do, and the coordinates behind the first letters: (rows, trees), (rows, trees, w)."""
    width = min(unit.shape[1], WIDEST)
    turned = (unit.astype(np.float32) @ _rotations(unit.shape[1], trees)).reshape(len(unit), trees, LETTERS, width)
    at = np.abs(turned).argmax(axis=3)
    letter = at * 2 + (np.take_along_axis(turned, at[..., None], axis=3)[..., 0] > 0)
    code = np.zeros(letter.shape[:2], dtype=np.uint64)
    for x in range(LETTERS):
        code = code << np.uint64(8) | letter[:, :, x].astype(np.uint64)
    return (code ^ np.uint64(1 << 63)).view(np.int64), turned[:, :, 0]


@lru_cache(maxsize=4)
def odds(dim: int, samples: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """(scores, p): p[i, r] is the share of neighbours at cosine scores[i] whose letter is among a vector's r + 1 nearest letters."""
    rng, width = np.random.default_rng(5), min(dim, WIDEST)
    x, z = rng.standard_normal((samples, dim)).astype(np.float32), rng.standard_normal((samples, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    x, z, scores = x[:, :width], z[:, :width], np.linspace(0, 1, 41)
    place = np.argsort(np.argsort(-np.concatenate((x, -x), axis=1), axis=1), axis=1)
    p = np.zeros((len(scores), 2 * width))
    for i, s in enumerate(scores):
        y = s * x + np.sqrt(1 - s * s) * z
        best = place[np.arange(samples), np.concatenate((y, -y), axis=1).argmax(axis=1)]
        p[i] = np.bincount(best, minlength=2 * width).cumsum() / samples
    return scores, p


@lru_cache(maxsize=16)
def levels(dim: int, trees: int, target: float) -> list[float]:
    """The least score at which each level of ascent suffices: prefixes of LETTERS, ..., 1 letters, then 2, 3, ... first letters."""
    scores, p = odds(dim)
    fine = np.linspace(0, 1, 401)
    found = lambda q: 1 - (1 - np.minimum(q, 1 - 1e-12)) ** trees
    out = []
    for depth, r in [(d, 0) for d in range(LETTERS, 0, -1)] + [(1, r) for r in range(1, p.shape[1] - 1)]:
        enough = np.nonzero(found(np.interp(fine, scores, p[:, r]) ** depth) >= target)[0]
        out.append(float(fine[enough[0]]) if len(enough) else 2.0)
    return [*out, -2.0]  # all letters are all entries


# --- tables of the index ---------------------------------------------------------------------------------------------


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part; v is the vector as bytes of doubles, scaled by a power of two to a largest component of 0.5 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not x or None in x:
                    continue
                v = np.array(x, dtype=np.float64) + 0.0  # -0.0 and 0.0 are one
                if np.isfinite(v).all() and v.any():
                    keep.append(i)
                    out.append(np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "id long, v binary")


def _collapsed(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([sorted(set(x))[:keep] for x in own.values()], pa.list_(pa.int64()))], ["v", "ids"])

    some = rows.mapInArrow(run, "v binary, ids array<long>")
    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    salted = some.groupBy("v", F.pmod(F.xxhash64("ids"), F.lit(32)).alias("salt")).agg(least)
    return salted.groupBy("v").agg(least)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, matrix of unit vectors) for each length of vector in a batch."""
    raw = column.to_pylist()
    sizes = np.array([len(v) for v in raw])
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        m = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.float64).reshape(len(at), -1)
        yield at, m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


_ENTRY = "tree int, dim int, code long, key long, small binary, step float"


def _entries(vectors: DataFrame, trees: int) -> DataFrame:
    """A row for each vector and tree; ``small`` has the unit vector's coordinates in units of ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keys = batch.column(0).to_numpy()
                for at, unit in _by_length(batch.column(1)):
                    step = np.abs(unit).max(axis=1) / 127
                    small = np.rint(unit / step[:, None]).astype(np.int8)
                    code = strings(unit, trees)[0]
                    for t in range(trees):
                        n = len(at)
                        columns = [pa.array(np.full(n, t, dtype=np.int32)), pa.array(np.full(n, unit.shape[1], dtype=np.int32)), pa.array(code[:, t]), pa.array(keys[at]), _packed(small), pa.array(step.astype(np.float32))]
                        yield pa.RecordBatch.from_arrays(columns, ["tree", "dim", "code", "key", "small", "step"])

    return vectors.select("key", "v").mapInArrow(run, _ENTRY)


def _letter(code: str | Column, place: int) -> Column:
    """A byte of a code, 0 to 255; the first is that of the signed integer, so that it differs from the letter in its top bit."""
    return F.shiftrightunsigned(code, 56 - 8 * place).bitwiseAND(255).cast("int")


_GROUP = ["tree", "dim", "letter", "salt"]
_BLOCK = [*_GROUP, "block"]


def _blocks(entries: DataFrame) -> DataFrame:
    """(tree, dim, letter, salt, block, first, last, low, high, n, payload): the sorted arrays, cut.

    Codes from ``low`` to ``high`` fall into a block; ``first`` and ``last`` are the codes it holds. The payload has the codes,
    the keys, the steps and the small vectors, each as one array.
    """
    sizes = entries.groupBy("tree", "dim", _letter("code", 0).alias("letter")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    dealt = entries.withColumn("letter", _letter("code", 0)).join(sizes, ["tree", "dim", "letter"]).withColumn("salt", F.pmod(F.hash("key"), F.col("salts")))
    dealt = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "code", "key").select(*_GROUP, "code", "key", "step", "small")
    names = [*_BLOCK, "first", "last", "low", "high", "n", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, count, number, low = None, [], 0, 0, 0
        done: list[tuple] = []

        def close(after: int | None) -> None:
            """Make a block of what is held; ``after``: the next code of the group."""
            nonlocal held, count, number, low
            codes = np.concatenate([x[0] for x in held])
            payload = b"".join((codes.tobytes(), np.concatenate([x[1] for x in held]).tobytes(), np.concatenate([x[2] for x in held]).tobytes(), *(s for x in held for s in x[3])))
            top = (place[2] << 56) - (1 << 64 if place[2] > 127 else 0)  # the letter's first code, as a signed integer
            high = after - 1 if after is not None else top + (1 << 56) - 1
            done.append((*place, number, int(codes[0]), int(codes[-1]), low if number else top, high, len(codes), payload))
            held, count, number, low = [], 0, number + 1, high + 1

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i < 5 else pa.int64() if i < 10 else pa.binary()) for i, x in enumerate(zip(*done, strict=True))], names)
            done.clear()
            return out

        for batch in batches:
            groups = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            codes, keys, steps, smalls = (*(batch.column(i).to_numpy() for i in range(4, 7)), batch.column(7).to_pylist())
            cuts = np.concatenate(([0], np.nonzero((groups[1:] != groups[:-1]).any(axis=1))[0] + 1, [len(groups)])) if len(groups) else [0]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(int(x) for x in groups[start])
                if here != place:
                    if held:
                        close(None)
                    place, number = here, 0
                while start < stop:
                    if count == BLOCK:
                        close(int(codes[start]))
                    end = min(stop, start + BLOCK - count)
                    held.append((codes[start:end], keys[start:end], steps[start:end], smalls[start:end]))
                    count += end - start
                    start = end
            if done:
                yield made()
        if held:
            close(None)
            yield made()

    kinds = ["int"] * 5 + ["long"] * 5 + ["binary"]
    return dealt.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


_ASKED = "query long, dim int, tree int, code long, unit binary, nearest binary"


def _queries(asked: DataFrame, trees: int) -> DataFrame:
    """A row for each query and tree: its string, its unit vector in single precision and the bytes of its first letters, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, unit in _by_length(batch.column(1)):
                code, first = strings(unit, trees)
                width = first.shape[2]
                order = np.argsort(-np.concatenate((first, -first), axis=2), axis=2, kind="stable")
                nearest = ((order % width * 2 + (order < width)) ^ 128).astype(np.uint8)
                for t in range(trees):
                    n = len(at)
                    columns = [pa.array(keys[at]), pa.array(np.full(n, unit.shape[1], dtype=np.int32)), pa.array(np.full(n, t, dtype=np.int32)), pa.array(code[:, t]), _packed(unit.astype(np.float32)), _packed(nearest[:, t])]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ASKED.split(", ")])

    return asked.select("query", "v").mapInArrow(run, _ASKED)


# --- search -----------------------------------------------------------------------------------------------------------


def _best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places of what can be among the k best, where each score is known to lie from ``low`` to ``high``."""
    if len(low) <= k:
        return np.arange(len(low))
    return np.nonzero(high >= np.partition(low, len(low) - k)[len(low) - k])[0]


def _run_of(codes: np.ndarray, code: int, least: int) -> tuple[int, int]:
    """The run of the longest prefix of a code that ``least`` entries share, or all entries of the first letter."""
    for depth in range(LETTERS, 0, -1):
        rest = (1 << 8 * (LETTERS - depth)) - 1
        a, b = np.searchsorted(codes, code & ~rest, "left"), np.searchsorted(codes, code | rest, "right")
        if b - a >= least:
            break
    if b - a > 4 * least:  # the entries next to the code's own place
        at = int(np.searchsorted(codes, code, "left"))
        a, b = max(a, at - 2 * least), min(b, at + 2 * least)
    return int(a), int(b)


_FOUND = "query long, key long, low float, high float, scored long"


def _scored(blocks: DataFrame, asked: DataFrame, k: int, least: int | None) -> DataFrame:
    """(query, key, low, high, scored) from (block, query, unit, code, from, to) routed to blocks.

    With ``least`` each query descends by its code; else it looks at the entries with codes ``from`` to ``to``. ``scored`` is
    the number of entries looked at, in one row for each query and block.
    """
    one = blocks.select(*_BLOCK, "n", "payload", F.lit(None).cast("long").alias("query"), F.lit(None).cast("binary").alias("unit"), *(F.lit(None).cast("long").alias(c) for c in ("code", "from", "to")))
    other = asked.select(*_BLOCK, F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("payload"), "query", "unit", "code", "from", "to")
    dealt = one.union(other).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, F.col("n").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            sizes, payloads, queries, units, codes, lows, highs = (batch.column(i).to_pylist() for i in range(5, 12))
            at, out = 0, []
            while at < len(groups):
                if sizes[at] is not None:
                    place, n, raw, dim = groups[at], sizes[at], payloads[at], groups[at][1]
                    part = lambda kind, start, count: np.frombuffer(raw, dtype=kind, count=count, offset=start)  # noqa: E731, B023
                    held = part(np.int64, 0, n), part(np.int64, 8 * n, n), part(np.float32, 16 * n, n), part(np.int8, 20 * n, n * dim).reshape(n, dim)
                    at += 1
                    continue
                stop = at
                while stop < len(groups) and stop < at + 256 and sizes[stop] is None and groups[stop] == groups[at]:
                    stop += 1
                if groups[at] == place:
                    own, keys, steps, small = held
                    if least is not None:
                        runs = [_run_of(own, codes[i], least) for i in range(at, stop)]
                    else:
                        runs = [(int(np.searchsorted(own, lows[i], "left")), int(np.searchsorted(own, highs[i], "right"))) for i in range(at, stop)]
                    whole = small.astype(np.float32) * steps[:, None] if max(b - a for a, b in runs) > 64 else None
                    for i, (a, b) in zip(range(at, stop), runs, strict=True):
                        if a >= b:
                            continue
                        q = np.frombuffer(units[i], dtype=np.float32)
                        score = whole[a:b] @ q if whole is not None else (small[a:b].astype(np.float32) @ q) * steps[a:b]
                        off = steps[a:b] * np.float32(0.5 * np.abs(q).sum()) + np.float32(_ROUNDING)
                        take = _best(score - off, score + off, k)
                        out.append((np.full(len(take), queries[i]), keys[a:b][take], (score - off)[take], (score + off)[take], np.concatenate(([b - a], np.zeros(len(take) - 1, dtype=np.int64)))))
                at = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "key", "low", "high", "scored"])

    return dealt.mapInArrow(run, _FOUND)


def _level(found: DataFrame, asked: DataFrame, dims: list[int], k: int, trees: int, target: float) -> DataFrame:
    """(query, level): how far each query ascends, from the k-th best of the lower bounds found in the descent."""
    sure = found.groupBy("query", "key").agg(F.max("low").alias("low"))
    kth = sure.groupBy("query").agg(F.get(F.sort_array(F.collect_list("low"), False), F.lit(k - 1)).alias("kth"))
    score = F.coalesce(F.col("kth"), F.lit(-1.0))
    level = F.lit(0)
    for dim in dims:
        steps = F.array(*(F.lit(x) for x in levels(dim, trees, target)))
        level = F.when(F.col("dim") == dim, F.array_position(F.transform(steps, lambda s: score >= s), True).cast("int") - 1).otherwise(level)
    return asked.select("query", "dim").distinct().join(kth, "query", "left").select("query", level.alias("level"))


def _own(rows: DataFrame, every: int) -> DataFrame:
    """The rows that are queries."""
    return rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).distinct()


def candidates(df: DataFrame, scratch: Scratch, id_col: str, vector_col: str, every: int, k: int, trees: int, least: int, target: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, asked, vectors, found): the rows that take part, the distinct queries, the distinct vectors; ``found`` has all (query, key, low, high, scored) of descent and ascent."""
    rows = scratch.write(_valid(df, id_col, vector_col))
    # one more than asked for: a query is not its own neighbour
    vectors = scratch.write(_collapsed(rows, k + 1).withColumn("key", F.monotonically_increasing_id()))
    distinct = scratch.write(_own(rows, every).select("v").distinct().withColumn("query", F.monotonically_increasing_id()))
    entries = scratch.write(_entries(vectors, trees))
    blocks = scratch.write(_blocks(entries))
    scratch.drop(entries)
    asked = scratch.write(_queries(distinct, trees).withColumns({"letter": _letter("code", 0), "second": _letter("code", 1)}))
    bounds = blocks.drop("payload", "n")
    # every second letter that a block's codes span, so that a query meets only blocks of its own two letters
    spans = bounds.withColumn("second", F.explode(F.sequence(_letter(F.least("low", "first"), 1), _letter(F.greatest("high", "last"), 1))))
    two = asked.join(spans, ["tree", "dim", "letter", "second"])
    down = two.where(F.col("code").between(F.col("low"), F.col("high"))).select(*_BLOCK, "query", "unit", "code", F.col("code").alias("from"), F.col("code").alias("to"))
    descent = scratch.write(_scored(blocks, down, k + 1, least))
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]  # lengths of vectors, not vectors
    level = scratch.write(_level(descent, asked, dims, k + 1, trees, target))
    levelled = asked.join(level, "query")
    # a prefix of two letters and more: a run within those two letters
    rest = F.expr("shiftleft(1L, 8 * level) - 1").alias("rest")
    deep = levelled.where(F.col("level") < LETTERS - 1).withColumn("rest", rest).withColumns({"from": F.col("code").bitwiseAND(F.bitwise_not("rest")), "to": F.col("code").bitwiseOR(F.col("rest"))})
    deep = deep.join(spans, ["tree", "dim", "letter", "second"]).where((F.col("first") <= F.col("to")) & (F.col("last") >= F.col("from")))
    # one first letter, or the nearest ones: whole letters
    byte = lambda i: F.conv(F.hex(F.substring(F.col("nearest"), i, F.lit(1))), 16, 10).cast("int")
    wide = levelled.where(F.col("level") >= LETTERS - 1).withColumn("letter", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.col("level") - (LETTERS - 2), F.octet_length("nearest"))), byte)))
    wide = wide.withColumns({"from": F.lit(-(1 << 63)), "to": F.lit((1 << 63) - 1)}).join(bounds, ["tree", "dim", "letter"])
    up = deep.select(*_BLOCK, "query", "unit", "code", "from", "to").union(wide.select(*_BLOCK, "query", "unit", "code", "from", "to"))
    ascent = scratch.write(_scored(blocks, up, k + 1, None))
    scratch.drop(blocks)
    return rows, distinct, vectors, descent.union(ascent)


def search(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS, trees: int = TREES, least: int = LEAST, target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``."""
    scratch = Scratch(df.sparkSession, "vector-forest")
    rows, asked, vectors, found = candidates(df, scratch, id_col, vector_col, every, k, trees, least, target)
    pairs = found.groupBy("query", "key").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    sure = F.get(F.sort_array(F.collect_list("low"), False), F.lit(k))
    kth = pairs.groupBy("query").agg(F.coalesce(sure, F.lit(-9.0)).alias("kth"))
    near = pairs.join(kth, "query").where(F.col("high") >= F.col("kth")).select("query", "key")
    both = near.join(vectors, "key").join(asked.select("query", F.col("v").alias("q")), "query").select("query", "q", "v", "ids")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for q, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                q, v = np.frombuffer(q), np.frombuffer(v)
                scores.append(float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(3)], ["query", "score", "ids"])

    scored = both.mapInArrow(exact, "query long, score double, ids array<long>").select("query", (-F.col("score")).alias("m"), F.explode("ids").alias("id"))
    best = scored.groupBy("query").agg(F.slice(F.array_distinct(F.sort_array(F.collect_list(F.struct("m", "id")))), 1, k + 1).alias("best"))
    best = scratch.write(best.join(asked, "query").select("v", "best"))
    scratch.keep(rows, best)
    ranked = _own(rows, every).join(best, "v").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.m")).alias("score"))
