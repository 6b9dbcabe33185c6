"""The training-data pipeline over `documents`: reject, clean, deduplicate, mix, tokenise.

Each stage takes the table its predecessor wrote. A run owns what it writes to the shared scratch folder: once a stage's rows are written,
what the stage itself wrote on the way and the table before it are deleted, by this run alone. The last stage's rows are computed when
they are read, so what they read stays: until the end of the block with pipeline_run(), for good with run(), whose result anyone may hold.

Defined cases of every stage: other columns pass through, and those an operator adds for itself are named `__...` (an input must not
hold such names); repeated rows are rows of their own and stay, but where a stage says otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import line_dedup, mixing, ngram_join, quality_crf, sentencepiece_codec
from corpusmill.llm.shared import delete, identified, materialize, recording

ORACLE_SQL = None  # a trained field, whole-text components and Viterbi paths have no SQL form


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        taken = [c for c in docs.columns if c.startswith("__")]
        if taken:
            raise ValueError(f"columns {taken} have names that stages use themselves")
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, taught by the labels outside the held-out fifth, doesn't reject.

    A null or empty text has a score like any other; rows without id teach nothing; with no labels nothing is rejected
    that the untaught field wouldn't reject; a score of exactly the threshold stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(5))
    model = quality_crf.fit(docs, labels, usable=fold != 0)
    scored = quality_crf.score(docs, model, score_col="__score")
    return scored.filter(F.col("__score") >= quality_crf.THRESHOLD).select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates after the first document that has them.

    Null texts stay null; a text that loses all its lines is empty, and its row stays; the first document is the one with the
    smallest id (null before all others), of repeated ids any one row; within one document repeated lines stay.
    """
    return line_dedup.dedup_lines(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more.

    The smallest id stays; null, empty and blank texts and rows without id are in no group and stay; of rows that repeat an id
    all stay or go together.
    """
    return ngram_join.keep_one_of_each(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the source schedule.

    A null source is a source of its own; texts don't matter; null and repeated ids are rows like others, ties in a source's order
    going by row number.
    """
    return mixing.mixed(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids in place of the text, and their slot and position in the source schedule.

    Rows of files have no order that lasts, so the schedule is in columns: rows read by position keep the weights. A null or empty
    text has no pieces; null and repeated ids and null sources are as in mix.
    """
    named = identified(docs, "rows")
    places = mixing.schedule(named, row_col="__row").select("__row", "slot", "position")
    coded = sentencepiece_codec.encode(named)
    coded = coded.withColumn("n_pieces", F.size("piece_ids").cast("long")).drop("text")
    return coded.join(places.hint("merge"), "__row").drop("__row")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]


def _chain(spark: SparkSession, sf_dir: str, owned: list[str]) -> DataFrame:
    """The last stage's rows; owned: the folders that they read, when all is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with recording(owned):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, owned, but=docs)
    with recording(owned):
        return STAGES[-1][1](spark, docs, sf_dir)


@contextmanager
def pipeline_run(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The pipeline's rows; all that the run wrote is deleted at the end of the block."""
    owned: list[str] = []
    try:
        yield _chain(spark, sf_dir, owned)
    finally:
        delete(spark, owned)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows."""
    return _chain(spark, sf_dir, [])
