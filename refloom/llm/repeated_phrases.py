"""Substring duplicates by repeated-phrase automata.

A window is WINDOW consecutive words of one document; a window recurs if its word sequence starts at any
other place too. Each window has an anchor, the first of certain phrases of ANCHOR words inside it, so equal
windows have equal anchors; an anchor that is selected at one place only rules its windows out. Neighbouring
windows with one anchor make a fragment, at most 2 * WINDOW - ANCHOR words of text, and fragments are sharded
by their anchor. A shard confirms which windows recur, word by word, and takes each recurring passage from
one fragment; the passages are compiled into Aho-Corasick automata, over which all fragments of the shard are
streamed. What the automata match, and nothing else, is removed from the documents.

A passage is a run of windows that always follow each other: every place of one is a place of all. So one
copy of it finds all others, and a match never covers more than windows that recur.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import GROWN, hand_back, lean, shuffle_partitions, small_batches, spread_join, whole_text, written
from refloom.llm.textkernel import Words, words

WINDOW = 35
ANCHOR = 8
#: Bits of the map of recurring anchors (16 MB), whatever the corpus holds. A full map rules nothing out; results are the same.
ANCHOR_BITS = 27
#: Cells in which phrases are counted, and the share and number of all phrases from which a cell is hot, so 2^15 cells at most are.
CELLS, HOT_SHARE, HOT_PLACES = 1 << 18, 1 / (1 << 15), 1000
#: Entries, or bytes of fragments, that a task holds before it hands them on.
FLUSH = 1 << 20
SHARD_BYTES = 2 << 20
#: Windows that are put into fragments at a time.
STRETCH = 1 << 20

_U = np.uint64
_PLACE_BITS = 24
_LOW = _U((1 << _PLACE_BITS) - 1)


def _sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive values."""
    have, m = 1, x
    while have < k:
        step = min(have, k - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


class Anchored:
    """Windows of a run of words: first (word of every window), place (word of its anchor, from the run's start), keys (hash of the phrase at every word)."""

    def __init__(self, w: Words, start: int, stop: int, window: int, anchor: int):
        end = min(len(w.starts), stop + window - 1)
        doc, self.start, self.span = w.doc[start:end], start, window - anchor + 1
        n = max(0, end - start - window + 1)
        self.first = start + np.flatnonzero(doc[:n] == doc[window - 1 :][:n])
        self.keys = w.phrase_at(start, end, anchor) if len(self.first) else np.zeros(0, _U)
        self.place = self._least(self.keys >> _U(1)) if len(self.first) else self.first

    def _least(self, order: np.ndarray) -> np.ndarray:
        packed = (order & ~_LOW) | np.arange(len(order), dtype=_U)  # of equal phrases the leftmost
        return (_sliding_least(packed, self.span)[self.first - self.start] & _LOW).astype(np.int64)

    def without(self, hot: np.ndarray | None) -> np.ndarray:
        """place, if phrases of hot cells come after all others."""
        late = None if hot is None else hot[cells(self.keys)]
        return self.place if late is None or not late.any() else self._least((self.keys >> _U(1)) | (late.astype(_U) << _U(63)))


def cells(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _U(8)) % _U(CELLS)).astype(np.int64)


def _stretches(w: Words, window: int):
    """Runs of windows, by their first words."""
    for start in range(0, max(0, len(w.starts) - window + 1), STRETCH):
        yield start, min(start + STRETCH, len(w.starts) - window + 1)


def _selected(window: int, anchor: int):
    """Anchors selected in the task's texts: (key, places, cell null), places 1 or 2 for more; and (key null, places, cell) of cells with half of HOT_SHARE here, and of none with all phrases' number."""

    def flush(kept):
        keys, n = np.unique(np.concatenate(kept), return_counts=True)
        n = np.minimum(n, 2)
        return pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "places": pa.array(n, pa.int64()), "cell": pa.nulls(len(n), pa.int32())})

    @lean
    def run(batches):
        kept, n, table = [], 0, np.zeros(CELLS, np.int64)
        for b in batches:
            for _, _, w in words(b.column("content")):
                for start, stop in _stretches(w, window):
                    a = Anchored(w, start, stop, window, anchor)
                    if not len(a.first):
                        continue
                    np.add.at(table, cells(a.keys), 1)
                    kept.append(a.keys[np.unique(a.place)])
                    n += len(kept[-1])
                    if n > FLUSH:
                        yield flush(kept)
                        kept, n = [], 0
        if n:
            yield flush(kept)
        total = int(table.sum())
        some = np.flatnonzero((table > 1) & (table >= total * HOT_SHARE / 2))
        yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(some) + 1, pa.int64()), "places": pa.array([total, *table[some].tolist()], pa.int64()), "cell": pa.array([-1, *some.tolist()], pa.int32())})

    return run


def _mapped(recurring: DataFrame) -> np.ndarray:
    """The map of anchors, as bytes; made of at most 2^ANCHOR_BITS / 2^15 pieces."""
    at = F.shiftrightunsigned("key", 64 - ANCHOR_BITS) + 1  # the built-in counts from 1
    pieces = recurring.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    bits = np.zeros(1 << (ANCHOR_BITS - 3), np.uint8)
    for bucket, piece in zip(pieces.column("bucket").to_pylist(), pieces.column("bits"), strict=True):
        raw = np.frombuffer(piece.as_buffer(), np.uint8)
        bits[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(raw)] = raw
    return bits


def _is_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> _U(64 - ANCHOR_BITS)
    return ((bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1) > 0


def _fragments(w: Words, window: int, anchor: int, bits: np.ndarray, hot: np.ndarray | None):
    """(text, first word, anchor key, byte start, byte end) of each fragment of windows that may recur; words and bytes count from the block's start."""
    for start, stop in _stretches(w, window):
        plain = Anchored(w, start, stop, window, anchor)
        if not len(plain.first):
            continue
        may = _is_set(bits, plain.keys)[plain.place]
        if not may.any():
            continue
        first, place = plain.first[may], plain.without(hot)[may]
        new = np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1))
        a = first[new]
        b = first[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] + window - 1
        yield from zip(w.doc[a].tolist(), a.tolist(), plain.keys[place[new]].view(np.int64).tolist(), w.starts[a].tolist(), w.ends[b].tolist(), strict=True)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _distinct_fragments(window: int, anchor: int, shared):
    """(anchor, fragment, places) of the task's texts, places 1 or 2 for more; equal fragments are one while they are held."""

    def flush(held):
        for at in range(0, len(held), 4000):
            part = list(held.items())[at : at + 4000]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([k for _, (k, _) in part], pa.int64()), "fragment": pa.array([f for f, _ in part], pa.binary()), "places": pa.array([n for _, (_, n) in part], pa.int64())})

    @lean
    def run(batches):
        bits, hot = shared.value
        bits, held, size = np.frombuffer(bits, np.uint8), {}, 0
        for b in batches:
            for _, _, w in words(b.column("content")):
                raw = w.data.tobytes()
                for _, _, key, low, high in _fragments(w, window, anchor, bits, hot):
                    f = raw[low:high]
                    known = held.get(f)
                    if known is None:
                        held[f] = (key, 1)
                        size += len(f) + 150
                    elif known[1] == 1:
                        held[f] = (key, 2)
                if size > 8 * FLUSH:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return run


def _places(window: int, anchor: int, shared):
    """(text_key, first, digest) of every fragment of the task's texts, equal texts being one while their keys are held."""

    @lean
    def run(batches):
        bits, hot = shared.value
        bits, seen = np.frombuffer(bits, np.uint8), set()
        for b in batches:
            keys = b.column("text_key").to_pylist()
            out = ([], [], [])
            for at, n, w in words(b.column("content")):
                raw, bounds, fresh = w.data.tobytes(), w.bounds(n), [k not in seen for k in keys[at : at + n]]
                for doc, first, _, low, high in _fragments(w, window, anchor, bits, hot):
                    if fresh[doc]:
                        out[0].append(keys[at + doc])
                        out[1].append(first - int(bounds[doc]))
                        out[2].append(_digest(raw[low:high]))
                seen.update(keys[at : at + n])
                if len(seen) > FLUSH >> 4:
                    seen.clear()
            yield pa.RecordBatch.from_pydict({"text_key": pa.array(out[0], pa.binary()), "first": pa.array(out[1], pa.int32()), "digest": pa.array(out[2], pa.binary())})

    return run


def _numbered(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each pair, equal for equal pairs alone; one place of each number)."""
    _, sample, number = np.unique(one, return_index=True, return_inverse=True)
    if (other != other[sample][number]).any():
        _, sample, number = np.unique(np.stack([one, other], axis=1), axis=0, return_index=True, return_inverse=True)
    return number.ravel(), sample


def recurring_passages(w: Words, places: np.ndarray, window: int) -> list[np.ndarray]:
    """The passages of distinct fragments, the texts of w, each once as places of its words; places are 1 or 2 for more of each."""
    at, one = w.phrases(window)
    if not len(at):
        return []
    name, sample = _numbered(one, w.phrases(window, second=True)[1])
    of = w.doc[at]
    seen = np.bincount(name)  # over distinct fragments
    recurs = np.bincount(name, weights=places[of]) > 1
    follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (of[1:] == of[:-1]))
    _, where, n = np.unique(name[follows] * np.int64(len(sample)) + name[follows + 1], return_inverse=True, return_counts=True)
    always = np.zeros(len(at), bool)  # are a window and the one before it always next to each other
    always[follows + 1] = (n[where] == seen[name[follows]]) & (n[where] == seen[name[follows + 1]])
    first = sample[recurs & ~always[sample]]
    ends = np.flatnonzero(~np.append(always[1:], False))
    last = ends[np.searchsorted(ends, first)]
    return [np.arange(a, b) for a, b in zip(at[first].tolist(), (at[last] + window).tolist(), strict=True)]


def automaton_of(patterns: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        automaton.add_word(p)
    automaton.make_automaton()
    return automaton


def covered_by(automaton: ahocorasick.Automaton, ids: np.ndarray) -> np.ndarray:
    """Which of the ids lie in a match."""
    cover = np.zeros(len(ids) + 1, np.int64)
    hits = np.asarray(list(automaton.iter(tuple(ids.tolist()))), np.int64).reshape(-1, 2)
    np.add.at(cover, hits[:, 0] - hits[:, 1] + 1, 1)
    np.add.at(cover, hits[:, 0] + 1, -1)
    return np.cumsum(cover[:-1]) > 0


def _shard(fragments: dict[bytes, int], window: int):
    """(digest, spans) of the fragments in which passages are found; fragments give their number of places. spans are starts and ends in turn."""
    texts = list(fragments)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(f) for f in texts], out=offsets[1:])
    w = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=False)
    passages = recurring_passages(w, np.fromiter(fragments.values(), np.int64, len(texts)), window)
    if not passages:
        return
    number, _ = _numbered(w.hashes, w.second())
    number = number + 1
    automaton = automaton_of([tuple(number[p].tolist()) for p in passages])
    # a zero, which no passage holds, parts the fragments
    stream = np.zeros(len(number) + len(texts), np.int64)
    where = np.arange(len(number)) + w.doc
    stream[where] = number
    hit = covered_by(automaton, stream)
    bounds = w.bounds(len(texts)) + np.arange(len(texts) + 1)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    if not len(turns):
        return
    of = np.searchsorted(bounds, turns[::2], "right") - 1
    for i, at in zip(np.unique(of).tolist(), np.split(turns, 2 * (np.flatnonzero(np.diff(of)) + 1)), strict=True):
        yield _digest(texts[i]), (at - bounds[i]).tolist()


def _located(window: int):
    """Rows sorted by anchor to (digest, spans). Anchors are taken together up to SHARD_BYTES, for one automaton; no anchor is parted."""

    def flush(held):
        rows = list(_shard(held, window)) if held else []
        for at in range(0, len(rows), 4000):
            part = rows[at : at + 4000]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in part], pa.binary()), "spans": pa.array([s for _, s in part], pa.list_(pa.int32()))})

    @lean
    def run(batches):
        held, mine, size, last = {}, {}, 0, None
        for b in batches:
            for anchor, fragment, places in zip(*(b.column(n).to_pylist() for n in ("anchor", "fragment", "places")), strict=True):
                if anchor != last:
                    if sum(mine.values()) > 1:  # an anchor of one place has nothing that recurs
                        held |= mine
                        size += sum(map(len, mine))
                        if size > SHARD_BYTES:
                            yield from flush(held)
                            held, size = {}, 0
                    last, mine = anchor, {}
                mine[fragment] = min(2, mine.get(fragment, 0) + places)
        yield from flush(held | mine)

    return run


def covered(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(text_key, spans) of the distinct texts (text_key, content, repeated rows included) that lose words.

    spans are (first word, words or parts of it as starts and ends in turn), in any order, and may meet or overlap.
    """
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    selected = texts.select("content").mapInArrow(_selected(window, anchor), "key long, places long, cell int")
    counts = selected.groupBy("key", "cell").agg(F.sum("places").alias("places")).where("places > 1").persist()
    try:
        load = dict(counts.where("cell is not null").select("cell", "places").collect())  # CELLS rows at most
        bits = _mapped(counts.where("key is not null"))
    finally:
        counts.unpersist()
    hot, least = np.zeros(CELLS, bool), max(HOT_PLACES, load.pop(-1, 0) * HOT_SHARE / 2)
    hot[[cell for cell, n in load.items() if n >= least]] = True
    shared = spark.sparkContext.broadcast((bits.tobytes(), hot if hot.any() else None))

    fragments = texts.select("content").mapInArrow(_distinct_fragments(window, anchor, shared), "anchor long, fragment binary, places long")
    located = fragments.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_located(window), "digest binary, spans array<int>")
    places = written(texts.mapInArrow(_places(window, anchor, shared), "text_key binary, first int, digest binary"), "places")
    found = spread_join(places, located, "digest").select("text_key", F.struct("first", "spans").alias("s"))
    return found.groupBy("text_key").agg(F.collect_set("s").alias("spans"))


_STRIPPED = "struct<n_words:long,n_removed:long,kept_text:string>"


def _strip(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        own = text.encode("utf-8").split()
        if found is None or not len(found):
            rows.append((len(own), 0, b" ".join(own).decode("utf-8")))
            continue
        gone = np.zeros(len(own) + 1, np.int32)
        for s in found:
            edges = np.asarray(s["spans"]) + s["first"]
            np.add.at(gone, edges[::2], 1)
            np.add.at(gone, edges[1::2], -1)
        keep = np.cumsum(gone[:-1]) == 0
        kept = [x for x, k in zip(own, keep.tolist(), strict=True) if k]
        rows.append((len(own), len(own) - len(kept), b" ".join(kept).decode("utf-8")))
    hand_back(GROWN)
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])


def _stripped_rows(docs: DataFrame, text_col: str, window: int, anchor: int) -> DataFrame:
    """(row, stripped): every row of docs as a struct, and what is left of its text."""
    small_batches(docs.sparkSession)
    key = F.unhex(F.md5(F.encode(whole_text(text_col), "utf-8"))).alias("text_key")
    spans = covered(docs.select(key, whole_text(text_col).alias("content")), window, anchor)
    rows = spread_join(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key), spans, "text_key", how="left")
    strip = F.pandas_udf(_strip, _STRIPPED)
    return rows.select("row", strip(F.coalesce(F.col("row").getField(text_col), F.lit("")), "spans").alias("stripped"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row: its words without those covered by a window that recurs.

    Words are runs of anything but space and 0x09 to 0x0D and compared as they are. Windows are judged on the
    input, so both of two copies lose a passage. kept_text joins the words by one space. Texts of fewer than
    window words lose nothing; null counts as empty, with no words; repeated rows are copies of each other and
    get a row each, as do null ids; other columns are ignored; an empty table gives an empty result.

    What a task holds is bounded by bytes: fragments have at most 2 * window - anchor words, and a shard's task
    reads them sorted by anchor. Phrases that a share of all places has are anchors only where nothing else is in
    a window, so what is common does not gather unlike fragments in one task.
    """
    rows = _stripped_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", window, anchor)
    return rows.select(F.col("row.id").cast("long").alias(id_col), "stripped.*")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with kept_text as the text of each row that lost words, and length_col as its new length; other rows and columns stay as they are."""
    rows = _stripped_rows(docs, text_col, WINDOW, ANCHOR)
    changed = F.col("stripped.n_removed") > 0

    def column(name: str) -> Column:
        own = F.col("row").getField(name)
        if name == text_col:
            return F.when(changed, F.col("stripped.kept_text")).otherwise(own)
        if name == length_col:
            return F.when(changed, F.length("stripped.kept_text").cast(docs.schema[name].dataType)).otherwise(own)
        return own

    return rows.select(*(column(c).alias(c) for c in docs.columns))
