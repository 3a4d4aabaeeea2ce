"""BPE encoding by tree concatenation, and decoding.

A text is halved again and again; the leaves are encoded, then joined pairwise. Around a join a window of
the text is encoded anew and grown until its tokens agree with both sides on a stretch of whole tokens;
outside that stretch each side keeps its own tokens. A window that has grown to the whole of both halves is
exact by itself. The leaves of most texts are encoded and joined in the task that reads them; those of a very
long one are dealt over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.bpe import Encoder, encoder
from refloom.llm.common import shuffle_partitions, small_batches, whole_text

#: Code points of a leaf at most; a text of more is cut. Some 39 % of documents and 75 % of their text are.
LEAF_CHARS = 2_048
#: Texts of more code points than this are cut into parts of at most half of it, whose trees grow in tasks of their own.
DEALT_CHARS = 262_144
#: Code points on either side of a join in the first window, and those next to a cut that never count as agreement.
WINDOW_CHARS = 64
MARGIN_CHARS = 8
#: Consecutive equal tokens that make an agreement.
AGREE_TOKENS = 3


def leaves(text: str, most: int) -> list[str]:
    """text cut in halves until no piece has more than most code points."""
    if len(text) <= most:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], most) + leaves(text[half:], most)


def _agreement(one, other, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Indices (in one, in other) of a token both have at the same place between low and high, inside a run of AGREE_TOKENS equal ones. last: the last such run, else the first."""
    ids, starts, ends = one
    first, stop = (int(np.searchsorted(other[1], low)), int(np.searchsorted(other[2], high, "right")))
    at = {t: k for k, t in enumerate(zip(*(x[first:stop].tolist() for x in other), strict=True), start=first)}
    first, stop = int(np.searchsorted(starts, low)), int(np.searchsorted(ends, high, "right"))
    hits = [(k, at[t]) for k, t in enumerate(zip(*(x[first:stop].tolist() for x in one), strict=True), start=first) if t in at]
    hits = [h for h in hits if h[0] == 0 or ends[h[0] - 1] <= starts[h[0]]]
    runs = [h for n, h in enumerate(hits) if n + 1 >= AGREE_TOKENS and all(hits[n - j] == (h[0] - j, h[1] - j) for j in range(AGREE_TOKENS))]
    if not runs:
        return None
    pick = runs[-1] if last else runs[0]
    return pick[0] - 1, pick[1] - 1  # the middle of the run


class Part:
    """A stretch of text with its ids. Places of tokens are found near its ends alone, where joins need them."""

    def __init__(self, enc: Encoder, text: str, ids: np.ndarray):
        self.enc, self.text, self.ids = enc, text, ids

    def _checked(self, text: str, shift: int, last: bool):
        ids, starts, ends = self.enc.spans_of_chunks([text])[0]
        own = self.ids[len(self.ids) - len(ids) :] if last else self.ids[: len(ids)]
        return (ids, starts + shift, ends + shift) if np.array_equal(own, ids) else None

    def tail(self, width: int):
        """Tokens (ids, starts, ends) of the last width code points at least."""
        cut = len(self.text) - 2 * width
        at = self.enc.boundary(self.text, cut) if cut > 0 else None
        found = self._checked(self.text[at:], at, True) if at is not None and at <= len(self.text) - width else None
        return found or self.enc.spans_of_chunks([self.text])[0]

    def head(self, width: int):
        """Tokens (ids, starts, ends) of the first width code points at least."""
        at = self.enc.boundary(self.text, width)
        return (self._checked(self.text[:at], 0, False) if at is not None else None) or self.enc.spans_of_chunks([self.text])[0]


def join(left: Part, right: Part) -> Part:
    """One part of two neighbours."""
    enc, text, cut, width = left.enc, left.text + right.text, len(left.text), WINDOW_CHARS
    while True:
        tail, (ids, starts, ends) = left.tail(width), right.head(width)
        head = (ids, starts + cut, ends + cut)
        low, high = max(0, cut - width), min(len(text), cut + width)
        if low:  # a window starts where the left side starts a token, and ends where the right side ends one
            k = int(np.searchsorted(tail[1], low, "right")) - 1
            low = int(tail[1][k]) if k >= 0 else 0
        if high < len(text):
            k = int(np.searchsorted(head[2], high, "left"))
            high = int(head[2][k]) if k < len(head[2]) else len(text)
        ids, starts, ends = enc.spans_of_chunks([text[low:high]])[0]
        window = (ids, starts + low, ends + low)
        a = (0, 0) if low == 0 else _agreement(tail, window, low + MARGIN_CHARS, cut - MARGIN_CHARS, last=False)
        b = (len(right.ids), len(ids)) if high == len(text) else _agreement(head, window, cut + MARGIN_CHARS, high - MARGIN_CHARS, last=True)
        if a and b and a[1] <= b[1]:
            stop = 0 if low == 0 else len(left.ids) - len(tail[0]) + a[0]
            return Part(enc, text, np.concatenate([left.ids[:stop], ids[a[1] : b[1]], right.ids[b[0] :]]))
        width *= 2


def tree(parts: list[Part]) -> np.ndarray:
    """Ids of the parts' concatenation, joined pairwise as they were cut."""
    while len(parts) > 1:
        parts = [parts[i] if i + 1 == len(parts) else join(parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
    return parts[0].ids


def grown(enc: Encoder, texts: list[str], most: int = LEAF_CHARS) -> list[np.ndarray]:
    """Ids of each text by a tree of its own; the leaves of all are encoded in one call."""
    cut = [leaves(t, most) for t in texts]
    encoded = iter(enc.encode([p for pieces in cut for p in pieces]))
    return [tree([Part(enc, p, np.frombuffer(next(encoded), "<i4")) for p in pieces]) for pieces in cut]


def _in_place(tokenizer: str, with_text: bool, leaf_chars: int):
    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids = [x.astype("<i4").tobytes() for x in grown(enc, b.column("content").to_pylist(), leaf_chars)]
            yield _result(enc, b.column("row_id"), ids, with_text)

    return run


def _result(enc: Encoder, row_ids, ids: list[bytes], with_text: bool) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    flat = np.frombuffer(b"".join(ids), dtype="<i4")
    columns = {"row_id": row_ids, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}
    if with_text:
        columns["decoded"] = pa.array([enc.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _cut(dealt_chars: int):
    def run(batches):
        for b in batches:
            for row, text in zip(b.column("row_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                pieces = leaves(text, dealt_chars // 2)
                yield pa.RecordBatch.from_pydict({"row_id": pa.array([row] * len(pieces), pa.int64()), "digest": pa.array([_digest(text)] * len(pieces), pa.binary()), "leaf": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.string())})

    return run


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.sha256(text.encode("utf-8")).digest()


def _encode_parts(tokenizer: str, leaf_chars: int):
    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids = grown(enc, b.column("piece").to_pylist(), leaf_chars)
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("row_id", "digest", "leaf", "piece")} | {"ids": pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary())})

    return run


def _join_parts(tokenizer: str, with_text: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer)
        copies = int((group["leaf"] == 0).sum())  # repeated rows cut alike
        group = group.drop_duplicates("leaf").sort_values("leaf")
        ids = tree([Part(enc, p, np.frombuffer(x, "<i4")) for p, x in zip(group["piece"], group["ids"], strict=True)]).astype("<i4")
        out = {"row_id": [group["row_id"].iloc[0]] * copies, "ids": [ids] * copies}
        if with_text:
            out["decoded"] = [enc.decode(ids.tolist())] * copies
        return pd.DataFrame(out)

    return run


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, leaf_chars: int = LEAF_CHARS, dealt_chars: int = DEALT_CHARS) -> DataFrame:
    """(id, ids array<int>, decoded string) of every row, as the tokenizer's library gives them for the whole text.

    A text of up to leaf_chars code points is a single leaf. One of up to dealt_chars is cut and joined where it
    lies, without a shuffle; parts of a longer one are dealt out over the cluster and joined in one task for each
    such text. Null counts as empty, which has no ids and decodes to the empty text; repeated rows and null ids
    give a row each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, mb=2)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int"):
        raise TypeError(f"{id_col} must be an integer column, not {kind}")
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), whole_text(text_col).alias("content"))
    schema = "row_id long, ids array<int>" + ", decoded string" * decode
    near = rows.where(F.length("content") <= dealt_chars).mapInArrow(_in_place(tokenizer, decode, leaf_chars), schema)
    pieces = rows.where(F.length("content") > dealt_chars).mapInArrow(_cut(dealt_chars), "row_id long, digest binary, leaf int, piece string")
    dealt = pieces.repartition(shuffle_partitions(spark), "row_id", "leaf")
    encoded = dealt.mapInArrow(_encode_parts(tokenizer, leaf_chars), "row_id long, digest binary, leaf int, piece string, ids binary")
    far = encoded.groupBy("row_id", "digest").applyInPandas(_join_parts(tokenizer, decode), schema)
    return near.unionByName(far).withColumnRenamed("row_id", id_col)
