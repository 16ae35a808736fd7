"""The cleaning pipeline over documents: each stage works on what the stage before it kept.

A stage's result is written before the next stage begins, so each stage first clears
away the scratch tables of the stage before, and no others.

Defined results: documents with a null or empty text pass every filter that their other
columns pass, are no duplicates of each other, and have no tokens; rows with a null id
stay; of rows that repeat an id, one stays; an empty table gives an empty result. Texts
of any length are read whole. Further columns of documents are passed through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, near_dedup, quality, toxicity
from tessella.llm.queries import public_vocabulary
from tessella.session import Scratch, materialise, table

_scratch = Scratch()


def _stage(function):
    """A stage that owns its scratch tables until the next stage begins."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.clear(spark)
        with _scratch:
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality."""
    return quality.reject(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: contaminated ones go, single passages are cut out."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed, see bpe.encode), and a digest of what they decode to."""
    ranks, pattern = public_vocabulary()
    return bpe.digest(docs, ranks, pattern, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("bpe", encode),
]

#: The classifiers have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES[:-1]:
        own = Scratch()
        result = stage(spark, docs, sf_dir)
        with own:
            docs = materialise(result, f"pipeline-{name}")
        before.clear(spark)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
