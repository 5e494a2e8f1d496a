"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

language ID -> near duplicates -> repeated passages -> mixing -> packing. Every
stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the
last return the columns of documents.

As a stage's result is written before the next stage is called, each stage
first deletes the scratch tables of those before it: of the stages of the same
run(), or, for stages called one by one, of those called so before. Tables of
other queries, held or not, are left alone.

Defined results: those of the operators that the stages call. A stage given an
empty table returns an empty table.
"""

from __future__ import annotations

import contextvars
import functools

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import common, langid, minhash, mixing, packing, suffixes

#: Scratch tables of stages called one by one, and those of the run that is calling stages.
_alone: list[str] = []
_of_run: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("run", default=None)


def stage(function):
    """A stage that deletes its predecessors' scratch tables and keeps account of its own."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _of_run.get()
        made = _alone if made is None else made
        common.sweep(spark, made)
        with common.collecting(made):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter or with an unsure language go."""
    return langid.keep_identified(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.drop_near_duplicates(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffixes.remove_repeats(docs)


@stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: for each pass, each document taken, with the words that were taken."""
    return mixing.mixed_texts(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing_sources),
    ("packing", packed_sequences),
]

#: No stage but mixing could be written in SQL; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token = _of_run.set([])
    try:
        for i, (name, function) in enumerate(STAGES):
            docs = function(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = common.materialise(docs, f"pipeline-{name}", swept=False)
                if i:
                    common.forget(before)
                before = docs
        return docs
    finally:
        _of_run.reset(token)
