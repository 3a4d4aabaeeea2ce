"""Encoders around public tokenizer files. Ids equal the library's for the whole text; only the way there is cheaper."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from refloom.llm.common import worker_state

#: Chunks a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48
#: Code points of the texts that are cut into chunks at a time; a longer text is cut alone. The chunks of many texts at once leave the remembered ones scattered.
RUN_CHARS = 1 << 18

# Between two of these characters a single space always starts a new pre-token of the byte-level pattern.
_CUT_AT_SPACE = re.compile("(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")
# Where white space is dropped before the merges, ASCII white space always parts pre-tokens, and so does the
# end of a word of Latin letters before any other ASCII character but an apostrophe.
_WORDS = re.compile("(?<![^ \\t\\n\\r])[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\\x00-&(-@\\[-`{-~]|\\Z)|[^ \\t\\n\\r]+")

_SPACE = re.compile("[ \\t\\n\\r]")


def _chunker(spec: dict):
    """How a text may be cut so that the chunks' ids, concatenated, are those of the whole text; None where no rule is known."""
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return _CUT_AT_SPACE.split
    if pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        plain = normalizer["type"] == "Sequence" and {n["type"] for n in normalizer["normalizers"]} <= {"NFC", "Replace", "Lowercase"}
        pattern = split["pattern"].get("Regex", "")
        # every alternative is letters, one digit or a run without white space, and none looks around
        if split["behavior"] == "Removed" and split["invert"] and plain and not level["add_prefix_space"] and not level["use_regex"] and "(?" not in pattern and pattern.endswith("[^\\s\\p{L}\\p{N}]+"):
            return _WORDS.findall
    return None


#: ids, starts and ends in code points of a text's tokens.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def _spans_of(encoding) -> Spans:
    offsets = np.asarray(encoding.offsets, dtype=np.int64).reshape(-1, 2)
    return np.asarray(encoding.ids, dtype="<i4"), offsets[:, 0], offsets[:, 1]


class _Known(dict):
    """Ids by chunk; what is looked up in vain is noted in new and reads as None."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, chunk: str) -> None:
        self.new.add(chunk)


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian int32 bytes, without special tokens added.

    A .json file is read by tokenizers, a .model file by sentencepiece. Where the file's rules allow a
    text to be cut at white space, each distinct chunk is encoded once and remembered, up to CACHE_ENTRIES.
    """

    def __init__(self, path: str):
        self.path, self.cache, self.chunks, self.mark, self.ends, self.hf, self.sp = path, _Known(), None, None, None, None, None
        self.known_spans: dict[str, tuple[bytes, bytes, bytes]] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        self.hf.no_truncation()
        self.hf.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer", "added_tokens")}
        self.chunks = _chunker(spec)
        plain = [t for t in spec["added_tokens"] if t["special"] and "<" in t["content"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark = (plain[-1]["content"], plain[-1]["id"]) if plain else None
        suffix = getattr(self.hf.model, "end_of_word_suffix", None)
        if suffix and self.chunks == _WORDS.findall:
            vocab = self.hf.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _direct(self, texts: list[str]) -> list[bytes]:
        if self.sp:
            return [np.asarray(x, dtype="<i4").tobytes() for x in self.sp.encode(texts, num_threads=1)]
        return [np.asarray(x.ids, dtype="<i4").tobytes() for x in self.hf.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """As _direct(), but many chunks in a call, parted by a special token, which the library always cuts out first."""
        mark, mark_id = self.mark
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids = np.asarray(self.hf.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, dtype="<i4")
            cuts = (np.flatnonzero(ids == mark_id) * 4).tolist()
            if len(cuts) != len(part) - 1:
                out += self._direct(part)
                continue
            raw = ids.tobytes()
            out += [raw[s + 4 : e] for s, e in zip([-4, *cuts], [*cuts, len(raw)], strict=True)]
        return out

    def _alphabetic(self, chunks: list[str]) -> list[bytes]:
        """As _joined(), for chunks of letters that each end in one token with the end-of-word suffix."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            ids = np.asarray(self.hf.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<i4")
            cuts = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(cuts) != len(part):
                out += self._joined(part)
                continue
            raw = ids.tobytes()
            out += [raw[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Empty texts have none."""
        if self.chunks is None:
            return self._direct(texts)
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > RUN_CHARS:
                out += self._by_chunks(texts[at:i])
                at, size = i, 0
            size += len(t)
        return out + self._by_chunks(texts[at:])

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        pieces = [self.chunks(t) for t in texts]
        cache.new = set()
        found = [list(map(cache.__getitem__, p)) for p in pieces]
        new = cache.new
        if not new:
            return [b"".join(f) for f in found]
        letters = [c for c in new if c.isalpha()] if self.ends is not None else []
        ids = dict(zip(letters, self._alphabetic(letters), strict=True))
        marked = [c for c in new if c not in ids and "<" not in c] if self.mark else []
        ids.update(zip(marked, self._joined(marked), strict=True))
        rest = [c for c in new if c not in ids]
        ids.update(zip(rest, self._direct(rest), strict=True))
        room = CACHE_ENTRIES - len(cache)
        if room > 0:
            cache.update(((c, x) for c, x in list(ids.items())[:room] if len(c) <= CACHE_CHARS))
        return [b"".join([ids[c] if x is None else x for c, x in zip(p, f, strict=True)]) for p, f in zip(pieces, found, strict=True)]

    def decode(self, ids: list[int]) -> str:
        if self.sp:
            return self.sp.decode(ids)
        return self.hf.decode(ids, skip_special_tokens=False)

    def spans(self, text: str) -> Spans:
        """ids, starts and ends in code points, as the library gives them for a text of its own."""
        if self.sp:
            pieces = self.sp.encode(text, out_type="immutable_proto").pieces
            return np.asarray([p.id for p in pieces], "<i4"), np.asarray([p.begin for p in pieces], np.int64), np.asarray([p.end for p in pieces], np.int64)
        return _spans_of(self.hf.encode(text, add_special_tokens=False))

    def spans_of_chunks(self, texts: list[str]) -> list[Spans]:
        """spans() of each text. Where the file's rules allow, distinct chunks are encoded once and remembered, as in encode()."""
        if self.chunks is None or self.hf is None:
            return [self.spans(t) for t in texts]
        cut = [self._places(t) for t in texts]
        known, new = self.known_spans, {c: None for pieces, _ in cut for c in pieces if c not in self.known_spans}
        if new:
            encoded = self.hf.encode_batch(list(new), add_special_tokens=False)
            new = {c: tuple(x.astype("<i4").tobytes() for x in _spans_of(e)) for c, e in zip(new, encoded, strict=True)}
            if len(known) < CACHE_ENTRIES // 4:
                known.update((c, x) for c, x in new.items() if len(c) <= CACHE_CHARS)
        out = []
        for pieces, at in cut:
            found = [known.get(c) or new[c] for c in pieces]
            shift = np.repeat(np.asarray(at, np.int64), np.asarray([len(f[0]) for f in found], np.int64) // 4)
            ids, starts, ends = (np.frombuffer(b"".join([f[k] for f in found]), "<i4") for k in range(3))
            out.append((ids, starts + shift, ends + shift))
        return out

    def boundary(self, text: str, at: int) -> int | None:
        """The first place from at on where the file's rules always part tokens, or None."""
        found = None if self.chunks is None or self.hf is None else (_SPACE if self.chunks == _WORDS.findall else _CUT_AT_SPACE).search(text, max(0, at))
        return found and found.start()

    def _places(self, text: str) -> tuple[list[str], list[int]]:
        """The chunks of a text and where they begin."""
        if self.chunks == _WORDS.findall:
            found = list(_WORDS.finditer(text))
            return [m[0] for m in found], [m.start() for m in found]
        pieces = self.chunks(text)
        return pieces, np.cumsum([0, *map(len, pieces)])[:-1].tolist()


def encoder(path: str) -> Encoder:
    """The encoder of this Python process for path."""
    kept = worker_state().__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
