"""Removal of long word passages that an earlier document has as well.

A window is ``WINDOW`` consecutive words. A word goes if some window over it also starts in a document of smaller id.

1. Anchors: only windows of 20 words that start at positions in a difference cover modulo 31 are hashed. For any two
   positions i and j some shift of at most 30 brings both into the cover, so that any 50 words that two documents share
   hold an anchor at the same place in both; 6 of 31 positions are kept.
2. Anchors that more than one document has are gathered for each document.
3. Extension: the full windows around shared anchors, and no others, are hashed and compared with the smallest document
   that has them. Windows without a shared anchor cannot repeat.

Skew: a task remembers recent hashes in a table of fixed size. What it knows to be shared (or to be in an earlier document)
it reports as one row for each document instead of sending it to the hash's own group; an anchor that a row of the same id has
sent already counts as shared, which costs a look at its windows. A document sends a window that it repeats once, with all its
places. So no group gets more than a few rows from each task. Exact copies are found by hashes of whole texts and skip steps 2
and 3. What the table forgets only costs rows, never results.

Cases: null and empty texts have no words; texts under ``WINDOW`` words lose nothing; a null id counts as larger than all;
rows that repeat id and text get the same result each; documents of equal id never remove from each other; extra columns
are never read; windows are compared by hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.frames import as_text
from cairn.llm.shingles import mixed, word_hashes
from cairn.llm.storage import Scratch

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every residue modulo 31 is a difference of two of these
SLOTS = 1 << 20
LAST = (1 << 63) - 1
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def window_hashes(words: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Hash of the ``length`` words from each position (a polynomial over the words' hashes, by prefix sums)."""
    n = len(words)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(n, base, dtype=np.uint64).cumprod()
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), (words * powers).cumsum(dtype=np.uint64)))
    back = np.full(n - length + 1, pow(base, -1, 1 << 64), dtype=np.uint64).cumprod()
    return mixed((sums[length:] - sums[: n - length + 1]) * back)


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text."""
    period, cover = (PERIOD, COVER) if window > PERIOD else (1, (0,))
    h = window_hashes(words, window - period + 1)
    at = np.nonzero(np.isin(np.arange(len(h)) % period, cover))[0]
    return at, h[at]


class _Recent:
    """A direct-mapped table of hashes, with the two things that are known of each."""

    def __init__(self):
        self.key = np.zeros(SLOTS, dtype=np.uint64)
        self.value = np.full(SLOTS, LAST, dtype=np.int64)

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (h >> np.uint64(44)).astype(np.int64)
        return at, self.key[at] == h


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = as_text(df, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("th"), "doc_id", "text")


def _own_key(ord_: int, th: int) -> np.ndarray:
    """A key of the document's own, so that rows which need no comparing are dealt evenly, copies of one text too."""
    return mixed(np.array([ord_], dtype=np.int64).view(np.uint64) ^ mixed(np.array([th], dtype=np.int64).view(np.uint64))).view(np.int64)


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(k, h, ord, th, known): a row for each distinct anchor, or its hash in ``known`` if two documents of the task, or a row of this id, have sent it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _Recent()  # value: how many documents in turn have sent a hash
        recent.value[:] = 0
        last = np.zeros(SLOTS, dtype=np.int64)  # the document that sent it last
        for batch in batches:
            ks, os, ths, knowns, hs = [], [], [], [], []
            for o, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                h = np.unique(anchors(word_hashes(text.encode()), window)[1])
                if not len(h):
                    continue
                at, same = recent.slots(h)
                known = same & ((recent.value[at] >= 2) | (last[at] == o))
                recent.value[at] = np.where(same, recent.value[at] + (last[at] != o), 1)
                recent.key[at] = h
                last[at] = o
                fresh = h[~known].view(np.int64)
                ks.append(fresh)
                hs.append(fresh)
                os.append(np.full(len(fresh), o))
                ths.append(np.full(len(fresh), th))
                knowns += [None] * len(fresh)
                if known.any():
                    ks.append(_own_key(o, th))
                    hs.append(np.array([0]))
                    os.append(np.array([o]))
                    ths.append(np.array([th]))
                    knowns.append(h[known].tobytes())
            flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (ks, os, ths, hs)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in flat), pa.array(knowns, pa.binary())], ["k", "ord", "th", "h", "known"])

    return texts.select("ord", "th", "text").mapInArrow(run, "k long, ord long, th long, h long, known binary")


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted positions as (first, last) pairs."""
    cut = np.nonzero(np.diff(starts) != 1)[0]
    return np.stack((starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]), axis=1).astype("<i4")


def _window_rows(near: DataFrame, window: int) -> DataFrame:
    """(k, k2, ord, th, s, runs, known): a row for each distinct window around a shared anchor with its place, or places as
    runs; or, ``known``, the runs of windows that an earlier document of the task had."""
    anchor = window - (PERIOD if window > PERIOD else 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _Recent()  # value: the smallest document that had the window
        second = np.zeros(SLOTS, dtype=np.uint64)
        for batch in batches:
            ks, k2s, os, ths, ss, runs, knowns = [], [], [], [], [], [], []
            for o, th, text, some, more in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                words = word_hashes(text.encode())
                w = window_hashes(words, window)
                if not len(w):
                    continue
                shared = np.unique(np.concatenate((np.array(some, dtype=np.int64).view(np.uint64), *(np.frombuffer(x, dtype=np.uint64) for x in more))))
                at, h = anchors(words, window)
                at = at[np.isin(h, shared)]
                # the windows that hold the anchor at p start in p - (window - anchor) .. p
                mark = np.zeros(len(words) + 2, dtype=np.int32)
                np.add.at(mark, np.maximum(at - (window - anchor), 0), 1)
                np.add.at(mark, at + 1, -1)
                starts = np.nonzero(mark.cumsum()[: len(w)] > 0)[0]
                if not len(starts):
                    continue
                h, h2 = w[starts], window_hashes(words, window, _OTHER_BASE)[starts]
                slot, same = recent.slots(h)
                same &= second[slot] == h2
                earlier = same & (recent.value[slot] < o)
                better = ~same | (recent.value[slot] > o)
                recent.key[slot[better]], second[slot[better]] = h[better], h2[better]
                recent.value[slot[better]] = o
                fresh = np.nonzero(~earlier)[0]
                order = fresh[np.lexsort((starts[fresh], h2[fresh], h[fresh]))]
                first = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))) if len(order) else np.zeros(0, dtype=bool)
                heads = np.nonzero(first)[0]
                single = np.diff(np.append(heads, len(order))) == 1
                places = starts[order[heads]]
                ks.append(h[order[heads]].view(np.int64))
                k2s.append(h2[order[heads]].view(np.int64))
                os.append(np.full(len(heads), o))
                ths.append(np.full(len(heads), th))
                ss.append(np.where(single, places, -1))
                own = [None] * len(heads)
                for i in np.nonzero(~single)[0].tolist():
                    own[i] = _runs(starts[order[heads[i] : heads[i + 1] if i + 1 < len(heads) else len(order)]]).tobytes()
                runs += own
                knowns.append(np.zeros(len(heads), dtype=bool))
                if earlier.any():
                    ks.append(_own_key(o, th))
                    k2s.append(np.array([0]))
                    os.append(np.array([o]))
                    ths.append(np.array([th]))
                    ss.append(np.array([-1]))
                    runs.append(_runs(starts[earlier]).tobytes())
                    knowns.append(np.array([True]))
            flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (ks, k2s, os, ths, ss)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in flat), pa.array(runs, pa.binary()), pa.array(np.concatenate(knowns) if knowns else [], pa.bool_())], ["k", "k2", "ord", "th", "s", "runs", "known"])

    # doc_id is not needed, but with it this exchange of texts is the one of the last step, and is made once
    return near.select("ord", "th", "text", "hs", "knowns", "doc_id").mapInArrow(run, "k long, k2 long, ord long, th long, s long, runs binary, known boolean")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, and with ``with_text`` the kept words joined by one space."""
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = df.sparkSession
    scratch = Scratch(spark, "substring-dup")
    texts = _texts(df, id_col, text_col)
    ids = texts.select("ord", "th", F.xxhash64("text", F.lit(1)).alias("th2"))
    first = scratch.write(ids.groupBy("th", "th2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last"))
    copies = scratch.write(ids.join(first, ["th", "th2"]).where("ord > first").select("ord", "th").distinct())
    rows = _anchor_rows(texts, window)
    key = Window.partitionBy("k")
    rows = rows.select("*", (F.min("ord").over(key) < F.max("ord").over(key)).alias("shared"))
    found = rows.where("shared or known is not null").groupBy("ord", "th").agg(F.collect_list(F.when(F.col("known").isNull(), F.col("h"))).alias("hs"), F.collect_list("known").alias("knowns"))
    shared = scratch.write(found.join(copies, ["ord", "th"], "left_anti"))
    scratch.keep(shared, copies)
    dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord", "th")
    windows = _window_rows(dealt.join(shared, ["ord", "th"]), window)
    windows = windows.select("ord", "th", "s", "runs", "known", F.min("ord").over(Window.partitionBy("k", "k2")).alias("least"))
    gone = windows.where("known or least < ord").groupBy("ord", "th").agg(F.collect_list(F.when(F.col("s") >= 0, F.col("s").cast("int"))).alias("starts"), F.collect_list("runs").alias("runs"))
    gone = gone.select("ord", "th", "starts", "runs", F.lit(False).alias("whole"))
    whole = copies.select("ord", "th", F.array().cast("array<int>").alias("starts"), F.array().cast("array<binary>").alias("runs"), F.lit(True).alias("whole"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, kept_texts = [], [], [], []
            for text, starts, runs, everything in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                total.append(n)
                if everything and n >= window:
                    words = []
                elif starts or runs:
                    mark = np.zeros(n + 1, dtype=np.int32)
                    at = np.array(starts, dtype=np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    for a, b in (p for r in runs for p in np.frombuffer(r, dtype="<i4").reshape(-1, 2)):
                        mark[a] += 1
                        mark[b + window] -= 1
                    words = [w for w, c in zip(words, mark.cumsum().tolist(), strict=False) if not c]
                removed.append(n - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_texts, pa.string())] if with_text else [])], names)

    out = dealt.join(gone.union(whole), ["ord", "th"], "left").select("doc_id", "text", "starts", "runs", "whole")
    return out.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
