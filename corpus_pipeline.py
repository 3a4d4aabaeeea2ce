"""A corpus pipeline of five stages over documents; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import exact_dedup, jaccard_join, packing, quality, repeated_phrases
from refloom.llm.common import Scratch, scratch_path, table
from refloom.llm.queries import WORD_BPE


_BEFORE: list[Scratch] = []


def _own(spark: SparkSession) -> Scratch:
    """Scratch tables of a stage. Those of the stage before are deleted, as its result has been written by now; nobody else's are."""
    while _BEFORE:
        _BEFORE.pop().release()
    _BEFORE.append(Scratch(spark))
    return _BEFORE[-1]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    with _own(spark):
        return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with _own(spark):
        return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts."""
    with _own(spark):
        return jaccard_join.keep_one(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that recur."""
    with _own(spark):
        return repeated_phrases.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    with _own(spark):
        pieces = packing.concatenate_and_cut(docs, WORD_BPE, end_id=1)
        return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("repeated_passages", remove_passages),
    ("packing", pack),
]

#: Training, components and tokenisation cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the result of each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
