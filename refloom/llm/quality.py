"""A quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams inside words are hashed to vectors; a document is the
mean of its vectors; a softmax over two classes reads it. Vectors and output weights are learned by stochastic gradient descent in
numpy from a bounded sample of labelled rows. As the softmax of two classes depends on the difference of
their scores alone, and that is linear in the mean, scoring needs one number for each hash bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import give_back_freed, lean, small_batches, whole_text
from refloom.llm.textkernel import _BYTE_BASE, Words, _powers, _tables, mix, words

BUCKETS = 1 << 18
DIMENSIONS = 16
NGRAMS = (3, 4)
#: Labelled rows that training takes at most, chosen by a hash of their id; the documented bound of the sample.
TRAIN_ROWS = 6_000
UPDATES, RATE, SEED = 24_000, 1.0, 7
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_U = np.uint64


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, every pair of neighbouring words and every character n-gram inside a word."""
    data, n = w.data, len(w.data)
    docs, buckets = [w.doc], [w.hashes % _U(BUCKETS)]
    if len(w.starts) > 1:
        pair = w.doc[1:] == w.doc[:-1]
        docs.append(w.doc[1:][pair])
        buckets.append(mix(w.hashes[:-1] * _U(3) + w.hashes[1:])[pair] % _U(BUCKETS))
    if n and len(w.starts):
        _, values, _ = _tables()
        power, inverse = _powers(_BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(values[data] * power[:n], out=sums[1:])
        chars = np.flatnonzero((data & 0xC0) != 0x80)  # where code points start
        word = np.searchsorted(w.starts, chars, "right") - 1
        inside = (word >= 0) & (chars < w.ends[word])
        chars, word = chars[inside], word[inside]
        for k in NGRAMS:
            if len(chars) < k:
                continue
            first, of = chars[: len(chars) - k + 1], word[: len(chars) - k + 1]
            after = np.append(chars[k:], n)[: len(first)]
            after = np.minimum(after, w.ends[of])
            whole = of == word[k - 1 :]
            first, of, after = first[whole], of[whole], after[whole]
            edges = (first == w.starts[of]).astype(_U) * _U(2) + (after == w.ends[of]).astype(_U)
            h = mix((sums[after] - sums[first]) * inverse[first] + edges * _U(0x9E3779B97F4A7C15) + _U(k))
            docs.append(w.doc[of])
            buckets.append(h % _U(BUCKETS))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIMENSIONS
    weights: np.ndarray  # 2 x DIMENSIONS
    bias: np.ndarray  # 2

    def flat(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1, and the log odds of an empty text."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, distinct buckets, shares): between its bounds each text has its buckets and their shares of its features."""
    bounds, ids, shares = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for _, n, w in words(texts):
        doc, bucket = features(w)
        key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
        of = key // BUCKETS
        bounds.append(bounds[-1][-1] + np.searchsorted(of, np.arange(1, n + 1)))
        ids.append((key % BUCKETS).astype(np.int32))
        shares.append((count / np.bincount(doc, minlength=n)[of]).astype(np.float32))
    return np.concatenate(bounds), np.concatenate(ids), np.concatenate(shares)


def train(bags_: list[tuple[np.ndarray, np.ndarray]], labels: list[int], updates: int = UPDATES, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit a model to texts as (buckets, shares). One class only, or no rows, give the share of class 1 (one half without rows) to every text."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    y = np.asarray(labels, dtype=np.int64)
    if not len(y):
        return Model(vectors, weights, bias)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias[:] = np.log([1 - share, share])
    if y.min() == y.max():
        return Model(vectors, weights, bias)
    weights[:] = rng.normal(0, 0.1, weights.shape)
    done = 0
    while done < updates:
        for i in rng.permutation(len(y)):
            ids, share_of = bags_[i]
            step = rate * max(0.05, 1 - done / updates)
            done += 1
            if not len(ids):
                continue
            mean = share_of @ vectors[ids]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ weights
            weights -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            vectors[ids] -= (step * len(ids) ** 0.5) * np.outer(share_of, back)
    return Model(vectors, weights, bias)


def fold(id_col: str):
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


@lean
def _bags_of(batches):
    """Texts to their buckets and shares, so that a long text costs training its distinct buckets, not its length."""
    for b in batches:
        bounds, ids, shares = bags(b.column("content"))
        parts = [(ids[x:y].astype("<i4").tobytes(), shares[x:y].astype("<f4").tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "quality": b.column("quality"), "ids": pa.array([p[0] for p in parts], pa.binary()), "shares": pa.array([p[1] for p in parts], pa.binary())})


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """(row_id, quality, ids, shares) of at most rows texts, of any length, with labels outside the held-out fold.

    Ids come from labels alone, so no text is shuffled for it. Of texts with one id the least in order is taken.
    A text has at most BUCKETS buckets, eight bytes each.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT)).groupBy(F.col(id_col).alias("row_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("row_id"), "row_id").limit(rows)  # a row is 12 bytes
    texts = docs.select(F.col(id_col).alias("row_id"), whole_text(text_col).alias("content")).join(F.broadcast(chosen), "row_id")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.groupBy("row_id").agg(F.first("quality").cast("long").alias("quality"), F.min("content").alias("content")).mapInArrow(_bags_of, f"row_id {kind}, quality long, ids binary, shares binary").toArrow()
    return found.to_pandas().sort_values("row_id").reset_index(drop=True)


def _score(shared):
    @lean
    def run(batches):
        table, zero = shared.value
        for b in batches:
            out = np.empty(b.num_rows)
            for at, n, w in words(b.column("content")):
                doc, bucket = features(w)
                total = np.bincount(doc, weights=table[bucket], minlength=n)
                count = np.bincount(doc, minlength=n)
                out[at : at + n] = 1 / (1 + np.exp(-(zero + total / np.maximum(1, count))))
            rest = [c for c in range(b.num_columns) if b.schema.names[c] != "content"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out)], names=[*(b.schema.names[c] for c in rest), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; score is the probability of label 1.

    Null and empty texts have no features and get the score of the bias alone. Repeated rows get a row each,
    null ids are kept, other columns are ignored, an empty table gives an empty result. Nothing is shuffled;
    each task gets 1 MB of model, whatever the corpus holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.flat())
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, whole_text(text_col).alias("content")).mapInArrow(_score(shared), f"`{id_col}` {kind}, score double")
    return scored.select(id_col, (fold(id_col) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.flat())

    @lean
    def run(batches):
        for b, scores in ((b, next(_score(shared)([pa.RecordBatch.from_arrays([b.column(text_col)], names=["content"])]))) for b in batches):
            yield b.filter(pa.array(scores.column("score").to_numpy() >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the training sample. What training held goes back to the system, as the driver lives on."""
    sample = training_sample(docs, labels, id_col=id_col, text_col=text_col)
    model = train([(np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4")) for i, x in zip(sample["ids"], sample["shares"], strict=True)], sample["quality"].tolist())
    del sample
    give_back_freed()
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels and score all of docs."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
