"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over hashed character n-grams (log-odds of the
two halves of the languages, every language weighing the same) gives a signed margin: the mean log-odds of the text's n-grams,
with ``PRIOR`` n-grams of no evidence added, so that a margin does not grow with the text and a few letters are no proof.
Loss-weighted decoding adds up the logistic loss of each bit against each codeword, weighted by how reliable that bit is for
that language, and picks the codeword of least loss. The score is the softmax share of the winner; rows whose winner leads by
little (mixed languages, a few odd letters) are flagged as ambiguous. A text counts as rejected only where the winner's share is
below ``REJECTED_BELOW``, as mixed texts still are texts.

Reliability, the scale of each bit's margins and the sharpness of the score come from rows that the classifiers have not seen:
a quarter of the training sample. Languages with under ``SPLIT_FROM`` rows use the same rows for both.

The classifiers are fitted on a bounded sample, picked by a hash of the id: about ``TRAIN_PER_LANG`` rows of each language, and
of fewer (``TRAIN_LEAST`` at least) where there are so many languages that this would be over ``TRAIN_ROWS`` rows. No language
is left out. N-grams are counted by Spark, a row of counts for each language comes to the driver, no texts. Counts of rows per
language cover all data. Prediction reads whole texts and nothing but texts.

Cases: null texts and texts without letters give ``und`` with score 0; rows with null id or null lang are never trained
on; with no trainable row at all every text is ``und``; with one language every text with letters gets it; repeated rows
are predicted row by row; equal losses go to the language that sorts first; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
TRAIN_PER_LANG, TRAIN_LEAST, TRAIN_ROWS = 600, 20, 240_000
UNSEEN_ROWS = 20_000
SPLIT_FROM = 40
PRIOR = 30.0
AMBIGUOUS_BELOW, REJECTED_BELOW = 0.9, 0.4
UNKNOWN = "und"
_BOUNDS = pa.schema([("lang", pa.string()), *((x, pa.int64()) for x in ("taken", "kept_back", "tested"))])
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point to lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for start, stop in ((0, 0xD800), (0xE000, 0x30000), (0x30000, 0x33480)):
        for c in range(start, stop):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str | None) -> np.ndarray:
    """Buckets of the 1- to 3-grams of a text's letters, every other run of characters being one word boundary."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    letters = _folded()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    if not letters.any():
        return np.zeros(0, dtype=np.uint32)
    letters = np.concatenate(([0], letters, [0])).astype(np.uint32)
    letters = letters[np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))]
    a, b, c = (letters * m for m in _MULTIPLIERS)
    one = a[letters != 0]
    two = b[:-1] + (a[1:] ^ np.uint32(0x27D4EB2F))
    three = c[:-2] + b[1:-1] * np.uint32(5) + (a[2:] ^ np.uint32(0x165667B1))
    h = np.concatenate((one, two, three))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A code matrix (languages x bits): the exhaustive code up to 7 languages, else the widest-spread random one."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 7:
        columns = [(1, *x) for x in product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(columns, dtype=np.int8).T
    bits, rng, best, spread = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1.0
    for _ in range(50):
        code = rng.choice(np.array([1, -1], dtype=np.int8), (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = bits - code.astype(int) @ code.T
        np.fill_diagonal(apart, 2 * bits)
        if apart.min() > spread:
            best, spread = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # of each bit's margins
    trust: np.ndarray  # languages x bits, each row adds up to the number of bits
    sharpness: float = 1.0

    def margins(self, text: str | None) -> np.ndarray | None:
        """Signed evidence of each bit; None without a letter."""
        found = grams(text)
        if not len(found):
            return None
        return self.weights[found].sum(axis=0, dtype=np.float64) / (len(found) + PRIOR)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language for one row of margins, or for each row of several."""
        signed = self.code * (margins * self.scale)[..., None, :]
        return (self.trust * np.logaddexp(0, -signed)).sum(axis=-1)

    def shares(self, margins: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        loss = self.losses(margins) * (self.sharpness if sharpness is None else sharpness)
        share = np.exp(loss.min(axis=-1, keepdims=True) - loss)
        return share / share.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        margins = self.margins(text) if self.languages else None
        if margins is None:
            return UNKNOWN, 0.0, True
        share = self.shares(margins)
        best = int(np.argmax(share))
        score = float(share[best])
        return self.languages[best], score, score < AMBIGUOUS_BELOW

    def fitted(self, seen: list[tuple[str, np.ndarray]]) -> Model:
        """This model with scale, trust and sharpness from (language, margins) of rows that it was not made of."""
        if not seen or not self.code.shape[1]:
            return self
        index = {lang: i for i, lang in enumerate(self.languages)}
        truth, margins = np.array([index[lang] for lang, _ in seen]), np.array([m for _, m in seen])
        # a usual margin is 3 after scaling: a bit that is as clear as usual is right with 95 %
        scale = 3 / np.maximum(np.median(np.abs(margins), axis=0), 1e-9)
        right = 1 / (1 + np.exp(-self.code[truth] * margins * scale))
        trust = np.ones(self.code.shape)
        for k in np.unique(truth):
            own = right[truth == k]
            trust[k] = (own.sum(axis=0) + 1) / (len(own) + 2)
        out = replace(self, scale=scale, trust=trust / trust.sum(axis=1, keepdims=True) * self.code.shape[1])
        likelihood = lambda t: np.log(np.maximum(out.shares(margins, t)[np.arange(len(truth)), truth], 1e-12)).mean()
        return replace(out, sharpness=max((0.25, 0.35, 0.5, 0.7, 1.0), key=likelihood))


def classifiers(counts: Iterable[tuple[str, np.ndarray]], languages: list[str]) -> Model:
    """Classifiers of all bits from (language, n-gram counts), one language at a time."""
    code = codewords(len(languages))
    sums = np.zeros((2, code.shape[1], BUCKETS))  # shares of the n-grams, added up over both halves of the languages
    index, floor = {lang: i for i, lang in enumerate(languages)}, 0.0
    for lang, own in counts:
        k, total = index[lang], max(1, own.sum())
        floor = max(floor, 0.5 / total)
        for half, sign in enumerate((1, -1)):
            sums[half, code[k] == sign] += own / total
    members = np.stack([(code > 0).sum(axis=0), (code < 0).sum(axis=0)])[:, :, None]
    # n-grams as rare as the floor are no evidence, whichever half has them
    odds = np.log(sums / np.maximum(members, 1) + floor)
    return Model(languages, code, (odds[0] - odds[1]).T.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape))


def fit(rows: list[tuple[str, str]], unseen: list[tuple[str, str]] | None = None) -> Model:
    """A model of (language, text) rows; without ``unseen`` ones all is fitted on the same rows."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        own = np.bincount(grams(text), minlength=BUCKETS)
        counts[lang] = counts[lang] + own if lang in counts else own
    model = classifiers(counts.items(), sorted(counts))
    seen = [(lang, model.margins(text)) for lang, text in (rows if unseen is None else unseen)]
    return model.fitted([(lang, m) for lang, m in seen if m is not None])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, buckets, counts): the n-grams of each language, those of ``rows`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, own = None, np.zeros(BUCKETS, dtype=np.int64)

        def row() -> pa.RecordBatch:
            at = np.nonzero(own)[0]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<i4").tobytes()]), pa.array([own[at].astype("<i8").tobytes()])], ["lang", "buckets", "counts"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != lang:
                    if lang is not None:
                        yield row()
                    lang, own = name, np.zeros(BUCKETS, dtype=np.int64)
                own += np.bincount(grams(text), minlength=BUCKETS)
        if lang is not None:
            yield row()

    return rows.repartition("lang").sortWithinPartitions("lang").mapInArrow(run, "lang string, buckets binary, counts binary")


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, margins) of the rows (lang, text) that have a letter."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, shared.value.margins(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [(lang, m.tobytes()) for lang, m in found if m is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.binary())], ["lang", "margins"])

    return rows.mapInArrow(run, "lang string, margins binary")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG, most_rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of the rows that are not held out."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return classifiers([], [])
    own = min(per_lang, max(TRAIN_LEAST, most_rows // len(languages)))
    tested = max(1, UNSEEN_ROWS // len(languages))
    whole = 1 << 40
    bounds = []
    for lang, n in counts.items():
        taken = min(1.0, own / n) * whole
        split = n >= SPLIT_FROM
        bounds.append({"lang": lang, "taken": int(taken), "kept_back": int(taken * 0.25) if split else 0, "tested": int(min(taken * (0.25 if split else 1.0), tested / n * whole))})
    bound = df.sparkSession.createDataFrame(pa.Table.from_pylist(bounds, _BOUNDS))  # as Arrow: rows from Python objects would start workers of their own
    pick = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(whole)).alias("pick")
    some = rows.select("lang", "text", pick).join(F.broadcast(bound), "lang")  # as many rows as languages, collected above
    counted = _counted(some.where(F.col("pick").between(F.col("kept_back"), F.col("taken"))).select("lang", "text"))
    decoded = ((r["lang"], _dense(r["buckets"], r["counts"])) for r in counted.toLocalIterator())
    model = classifiers(decoded, languages)
    seen = _margins(some.where(F.col("pick") < F.col("tested")).select("lang", "text"), model).collect()
    return model.fitted([(r["lang"], np.frombuffer(r["margins"])) for r in seen])


def _dense(buckets: bytes, counts: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[np.frombuffer(buckets, dtype="<i4")] = np.frombuffer(counts, dtype="<i8")
    return out


def predictor(df: DataFrame, model: Model):
    """A column function text -> struct(lang_pred, score, ambiguous)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict


def identify(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""
    predict = predictor(df, model or train(df, id_col, text_col, lang_col))
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def keep_identified(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = REJECTED_BELOW) -> DataFrame:
    """The rows of ``df``, unchanged, whose language is told apart: those without letters, and those of a score below ``least``, go."""
    predict = predictor(df, model or train(df, id_col, text_col, lang_col))
    name = "__identified"
    out = df.withColumn(name, predict(F.col(text_col).cast("string")))
    return out.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
