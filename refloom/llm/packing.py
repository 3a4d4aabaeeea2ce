"""Packing by concatenate and cut.

Pass one encodes every document and writes its ids with the running token count inside its partition.
Prefix sums over the partitions' totals turn those into offsets in the one concatenation of all documents.
Pass two cuts the concatenation into windows of fixed length; a document that crosses a boundary gives
one record on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.bpe import encoder
from refloom.llm.common import lean, small_batches, whole_text, written

SEQUENCE_TOKENS = 2048
#: Rows of the partitions' prefix sums up to which they are broadcast.
MOST_BASES = 500_000

_ENCODED = "part int, doc_id long, start_in_part long, doc_tokens long, ids binary"


def _encode(tokenizer: str, end_id: int):
    @lean
    def run(batches):
        from pyspark import TaskContext

        enc, part, total = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype="<i4").tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column("content").to_pylist())]
            n = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
            starts = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(n), part, np.int32)), "doc_id": b.column("doc_id"), "start_in_part": pa.array(starts), "doc_tokens": pa.array(n), "ids": pa.array(ids, pa.binary())})

    return run


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, written to the shared folder: (part, doc_id, start_in_part, doc_tokens, ids), ids as little-endian 32-bit."""
    small_batches(docs.sparkSession, mb=4)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("content"))
    return written(rows.mapInArrow(_encode(tokenizer, end_id), _ENCODED), "encoded")


def pack(encoded: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the sequences.

    Every sequence but the last is full. A partition's total is one row of the prefix sum, so what meets in one
    task there is one row for each partition of pass one, whatever the corpus holds.
    """
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # a row of 12 bytes for each partition; more partitions than MOST_BASES are joined by a shuffle
    small = bases.count() <= MOST_BASES
    placed = encoded.join(F.broadcast(bases) if small else bases, "part").withColumn("at", F.col("base") + F.col("start_in_part"))
    size = F.lit(sequence_tokens).cast("long")
    first, last = F.expr(f"at div {sequence_tokens}"), F.expr(f"(at + doc_tokens - 1) div {sequence_tokens}")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * size)
    end = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * size)
    pieces = pieces.withColumns({"start": begin - F.col("at"), "length": end - begin, "offset": begin - F.col("sequence_id") * size})
    cut = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return pieces.select("doc_id", "start", "length", cut.alias("ids"), "doc_tokens", "sequence_id", "offset")


def concatenate_and_cut(docs: DataFrame, tokenizer: str, end_id: int, sequence_tokens: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed; see pack() for the columns.

    A null text counts as empty and is packed as its end token alone, so every row has at least one piece.
    Repeated rows are packed each; null ids are kept; other columns are ignored; an empty table gives no pieces.
    """
    return pack(encode_partitions(docs, tokenizer, end_id, id_col, text_col), sequence_tokens)
