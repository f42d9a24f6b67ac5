"""A cleaning pipeline over ``documents``: language, repeated lines, near copies, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again for the next. All stages but the last return the columns of ``docs``.

Cases: null and empty texts have no language and go in the first stage; a null id is a document like any other and is nobody's
copy; rows that repeat id and text share one fate; ties go to the smaller id; texts are read whole, however long; an empty
table gives an empty result of the same columns; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe_encode, decontaminate, language_id, line_dup, near_dup
from cairn.llm.frames import table
from cairn.llm.storage import Scratch
from cairn.session import reach_from_workers


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; those without letters and those that could be any language go."""
    reach_from_workers(spark)  # before any Python: workers of an older environment stay beside those of the new one
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines, and the single long lines, that stand earlier; those of which no line is left go."""
    out = line_dup.line_runs_removed(docs, long_line=line_dup.LONG_LINE)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    text_length = F.length("text").cast("long")
    return out.select(*(F.when(F.col("n_removed") > 0, text_length).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (shingles of five words, similarity 0.8)."""
    reach_from_workers(spark)
    return near_dup.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    reach_from_workers(spark)
    return bpe_encode.round_trip(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: Trained models, full-set similarity and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions of
#: its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.keep(docs)  # the table before it is not needed any more
    return STAGES[-1][1](spark, docs, sf_dir)
