"""A training corpus from raw documents: quality, toxicity, near copies, personal data, then packed token sequences.

Every stage takes (spark, docs, sf_dir), reads the labels of ``sf_dir`` where it learns from them, and returns a DataFrame. ``run`` writes each result as Parquet
in the shared folder and reads it back for the next stage. All stages but the last return the columns of documents.

A stage's result must be written before the next stage is called, as ``run`` does: a call deletes what the stage before it has staged in the shared
folder, unless its ``docs`` still read it. What a stage needs only on the way to its decisions is deleted before it returns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox import StagingScope
from sluicebox.llm.common import prepare, stage, table
from sluicebox.llm.minhash import near_duplicates
from sluicebox.llm.packing import pack, token_pieces
from sluicebox.llm.pii import pseudonymised, session_key
from sluicebox.llm.quality import quality_scores
from sluicebox.llm.toxicity import language_thresholds, threshold_of, toxicity_scores, train_model

LEAST_QUALITY = 0.3
_BEFORE: list[StagingScope] = []


def _step(function: Callable) -> Callable:
    """A stage in a staging scope of its own, which ends with the next stage."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark, docs)
        with StagingScope(spark) as scope:
            _BEFORE.append(scope)
            return function(prepare(spark), docs, sf_dir)

    return run


def _release(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Delete what stages before have staged, but for what ``docs`` reads; scopes of sessions that are gone are forgotten."""
    read = docs.inputFiles() if docs is not None else []
    for scope in list(_BEFORE):
        if not any(path.split("/sluicebox/")[-1] in file for path in scope.paths for file in read):
            if scope.spark is spark:
                scope.release()
            _BEFORE.remove(scope)


def _kept(spark: SparkSession, rows: DataFrame, decide: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``decide`` names by ``__row``; all else that it stages is deleted.

    The numbers of the others, which are fewer, are staged, and whole rows meet these alone: where they are few, the texts are not shuffled for it.
    """
    with StagingScope(spark) as scope:
        found = decide()
        with StagingScope(spark) as kept:
            others = stage(rows.select("__row").join(found, "__row", "left_anti"), "others")
    scope.release()
    _BEFORE[-1].paths += kept.paths
    return rows.join(others, "__row", "left_anti")


def _with_row(docs: DataFrame) -> DataFrame:
    """Rows numbered for joining decisions back, so that repeated and null ids do no harm."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


@_step
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least ``LEAST_QUALITY``; learned from all labels."""
    rows = _with_row(docs)

    def decide() -> DataFrame:
        scores = quality_scores(rows, table(spark, sf_dir, "labels"), F.lit(True), row_col="__row")
        return scores.where(F.col("score") >= LEAST_QUALITY).select(F.col("row").alias("__row"))

    return _kept(spark, rows, decide).select(*docs.columns)


@_step
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold."""
    labels = table(spark, sf_dir, "labels")
    rows = _with_row(docs)

    def decide() -> DataFrame:
        model = train_model(rows, labels, F.lit(True))
        scores = stage(toxicity_scores(rows, model, id_col="__row").withColumnRenamed("doc_id", "__row"), "toxicity")
        known = labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("label"))
        least = language_thresholds(rows.select("__row", "doc_id", "lang").join(known, "doc_id").join(scores, "__row").select("lang", "score", "label"))
        limit = threshold_of(F.col("lang"), least)
        return rows.select("__row", "lang").join(scores, "__row").where(F.col("score") < limit).select("__row")

    return _kept(spark, rows, decide).select(*docs.columns)


@_step
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id, and of repeated rows of this id the first; null ids come last."""
    rows = _with_row(docs)

    def decide() -> DataFrame:
        classes = near_duplicates(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
        order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first")
        return classes.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(order).select("first.__row")

    return _kept(spark, rows, decide).select(*docs.columns)


@_step
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows the text."""
    new = pseudonymised(docs, session_key(spark), count_col=None)
    return new.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else new


@_step
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Trained models and tokenizer ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        made = function(spark, docs, sf_dir)
        with StagingScope(spark) as output:
            docs = stage(made, name.replace(" ", "-"))
        if before:
            before.release()
        before = output
    _release(spark)
    return docs
