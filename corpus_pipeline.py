"""A training-corpus pipeline: filters by a classifier and by rules, near-duplicate removal, packing.

Each stage takes the documents that the one before it kept and returns a DataFrame; it is written as Parquet in the shared
folder and read again for the next one.

Decisions are made row by row: a null id or one that is on several rows neither saves nor condemns another row, and of repeated rows
the near-copy stage leaves one. Null and empty texts are judged like others (the rules reject them). Empty tables give empty
results, labels that are missing a classifier that knows the share of good ones only, and further columns pass through all stages
but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import packing, quality, rules, simhash
from orrery.llm.common import dropped, split_of, table, written
from orrery.llm.queries import WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier, learned from four fifths of the labels, predicts to be of low quality."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), split_of("doc_id", 5) != 0)
    # The rows themselves are scored: an id may be missing or on several rows.
    return quality.scored_rows(docs, model).filter(quality.predicted() != 0).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that a rule of the policy rejects."""
    return rules.judged_rows(docs).filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id."""
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences."""
    return packing.packed(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier is trained here, so SQL can't give these rows; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
