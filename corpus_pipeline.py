"""A training corpus from raw documents: quality classifier, near-duplicates, benchmark decontamination, personal data,
mixing. Every stage takes what its predecessor kept; all but the last return the columns of documents. A stage's result is
to be written before the next stage is called; one pipeline at a time runs in a process."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from allelo.llm import decontaminate, mixing, pii, quality, simhash
from allelo.llm.common import stored
from allelo.store import made_here, remove

#: Tables that the stage before this one stored on its way.
_left: list[str] = []


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stage(work):
    """A stage: what it stores on its way is removed when the next one begins, which reads its written result."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        with made_here() as folders:
            out = work(spark, docs, sf_dir)
        _left.extend(folders)
        return out

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labelled ones, does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group with a similarity of 0.8 or more on 5-word shingles."""
    return simhash.keep_one_similar(docs, 0.8)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets in their texts."""
    return pii.surrogates(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each copy that the mix takes, with mix_copy, mix_position and mix_words."""
    return mixing.curriculum_mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mix),
]

#: The network and the keyed surrogates are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
