"""Token counts through a digest cache.

A cache row is (content_digest, tokenizer_digest, n_tokens). Contents are joined to it by digest, only
distinct contents that it lacks are encoded, and their counts are appended, so a second run over the same
contents encodes nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.bpe import encoder
from refloom.llm.common import scratch_path, small_batches, spread_join, whole_text

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache at a path; an empty one where nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return spark.createDataFrame([], CACHE_SCHEMA)


def _count(tokenizer: str, version: str):
    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(x) // 4 for x in enc.encode(b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs; missing counts are appended to the cache at that path first.

    The normalised content is the text itself in UTF-8 with null as empty: the byte-level tokenizers have no
    normaliser, so any other change of the text could change its count. Null and empty texts count 0; repeated
    rows and null ids each give a row; other columns are ignored; an empty table gives an empty result and
    writes no counts. Equal contents are collapsed in the map tasks before they are shuffled, so one content
    that fills a third of the table costs one row for each task; its rows are dealt over several when counts are
    joined back to ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col), text.alias("content"), F.unhex(F.sha2(text, 256)).alias("content_digest"))
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version)
    distinct = rows.groupBy("content_digest").agg(F.first("content").alias("content"))
    missing = distinct.join(known.select("content_digest"), "content_digest", "left_anti")  # on the partitioning that the collapse made
    missing.mapInArrow(_count(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    sizes = rows.select(id_col, F.octet_length("content").cast("long").alias("n_bytes"), "content_digest")
    return spread_join(sizes, counts, "content_digest", how="left").select(id_col, "n_bytes", "n_tokens")
