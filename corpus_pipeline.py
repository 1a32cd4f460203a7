"""The training-data pipeline: filter, deduplicate, mix and pack ``documents``.

Each stage is one operator of ``marlstone.llm`` over everything its predecessor
kept, written as Parquet and read again. Part of that subpackage.

Defined results: null and empty texts are scored like any other, and are copies
of one another to both deduplication stages, of which the largest identifier
stays; null identifiers are kept apart by their texts; of repeated rows one
stays; texts without words are never taken by the mix; very long texts are read
whole and packed in pieces; an empty table gives an empty table; extra columns,
whatever their names, are carried up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bt_quality, budget_mix, certified_packing, dart_minhash, trie_dedup
from marlstone.llm.common import Written, documents, labels
from marlstone.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    return bt_quality.accepted(docs, labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest identifier of each group of equal texts."""
    return trie_dedup.deduplicated(docs, largest=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once, twice or not at all."""
    return budget_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    return certified_packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned scores, trie and dart hashing, knapsack and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's table goes once its successor is written, the last of them once packing has
    put its pieces into a table of its own."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        table = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        docs = table.__enter__()
        if before is not None:
            before.__exit__()
        before = table
    packed = STAGES[-1][1](spark, docs, sf_dir)
    if before is not None:
        before.__exit__()
    return packed
