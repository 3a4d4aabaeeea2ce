"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing names and empty tables, against brute force."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from refloom.llm import bpe_tree, embedding_dedup, exact_dedup, jaccard_join, packing, quality, repeated_phrases, resharding, token_counts, warc
from refloom.llm.textkernel import words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
random.seed(5)
WORDS = ["".join(random.choice("abcdeéß") for _ in range(random.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".\n"]) for _ in range(n))


PASSAGE = prose(60, 1)
TEXTS = [
    None, "", " \t\n", "one", "two words", prose(100, 2), prose(100, 2), prose(100, 2) + "  ", prose(40, 3) + " " + PASSAGE + " " + prose(40, 4), prose(30, 5) + " " + PASSAGE,
    prose(6000, 6), "a " * 80, "A b c D e f", "a B c d e F", "x" * 3000, "<|endoftext|> it's 'stop 日本 🎉 É ﬁ İ", prose(100, 2).replace(" ", "", 1), "two\twords", prose(90, 2) + " zz",
]
IDS = [3, 7, 1, 2, 9, 30, 12, 12, 40, 41, 50, 60, 70, 71, 80, 90, None, 100, 110]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns named as the operators' own, rows repeated, ids null and out of order."""
    rows = [(i, t, "en", n, n, "c", "l", "k") for n, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    rows += [rows[5], rows[8], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, row_id int, content string, list string, keep_id string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def test_exact_dedup(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows]
    expected = []
    for (i, _), n in zip(rows, norm, strict=True):
        group = [r for r, m in zip(rows, norm, strict=True) if m == n]
        keep = min(group, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        expected.append((i, keep, len(group), i == keep))
    for budget in (exact_dedup.TRIE_BYTES, 50):
        same(exact_dedup.duplicate_groups(docs, trie_bytes=budget).select("doc_id", "keep_id", "group_size", "kept"), expected)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm))


def test_trie():
    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(500)]
    trie, plain = exact_dedup.Trie(), {}
    for k in keys:
        trie.insert(k, 1, lambda a, b: a + b)
        plain[k] = plain.get(k, 0) + 1
    assert trie.held <= sum(map(len, plain))
    before = dict(trie.pop_before(b"ab"))
    assert before == {k: v for k, v in plain.items() if k < b"ab"}
    assert dict(trie.pop_all()) == {k: v for k, v in plain.items() if k >= b"ab"} and trie.held == 0


@pytest.mark.parametrize(("leaf_chars", "dealt_chars"), [(16, 64), (64, 262_144), (1_024, 262_144)])
def test_bpe_tree(docs, rows, leaf_chars, dealt_chars):
    t = Tokenizer.from_file(WORD)
    expected = []
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        expected.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    same(bpe_tree.encode_decode(docs, WORD, leaf_chars=leaf_chars, dealt_chars=dealt_chars), expected)


def test_bpe_tree_hard_texts():
    from refloom.llm.bpe import Encoder

    enc, r = Encoder(WORD), random.Random(3)
    for text in ["a" * 9000, "".join(r.choice("abc") for _ in range(9000)), "".join(r.choice("é́e'sdtlv!. \nßİ日") for _ in range(9000)), "!'s" * 3000, "<|endoftext|>" * 700, "漢" * 5000, " " * 5000]:
        pieces, expected = bpe_tree.leaves(text, 512), enc.hf.encode(text, add_special_tokens=False).ids
        assert bpe_tree.tree([bpe_tree.Part(enc, p, enc.spans(p)[0]) for p in pieces]).tolist() == expected
        assert bpe_tree.grown(enc, [text], 300)[0].tolist() == expected


def test_bpe_tree_random_texts():
    from refloom.llm.bpe import Encoder

    for path in (WORD, BYTE):
        enc, r = Encoder(path), random.Random(4)
        texts = ["".join(r.choice(["a", "the ", "é", "é", " ", "\n\n", "'s", "1", "23", "-", "日本", "İ", "ß", "\u00a0", "\u3000", ".", "<|", "X", "fox"]) for _ in range(r.randint(0, 400))) for _ in range(150)]
        for text, got in zip(texts, bpe_tree.grown(enc, texts, 48), strict=True):
            assert got.tolist() == enc.hf.encode(text, add_special_tokens=False).ids, text


def test_packing(docs, rows):
    t = Tokenizer.from_file(WORD)
    packed = packing.concatenate_and_cut(docs, WORD, end_id=1, sequence_tokens=128).collect()
    places = sorted((p.sequence_id, p.offset, p.length) for p in packed)
    assert all(a[:2] == ((b[0], b[1] + b[2]) if b[1] + b[2] < 128 else (b[0] + 1, 0)) for b, a in zip(places, places[1:], strict=False)) and places[0][:2] == (0, 0)
    whole = sorted((i is None, i, tuple(t.encode(x, add_special_tokens=False).ids + [1])) for i, x in rows)
    stream = b"".join(p.ids for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)))
    tokens, starts = np.frombuffer(stream, "<u4").tolist(), [p for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    at, got = 0, []
    for p in starts:
        got.append((p.doc_id is None, p.doc_id, tuple(tokens[at : at + p.doc_tokens])))
        at += p.doc_tokens
    assert sorted(got) == whole and at == len(tokens)


def brute_components(ids, linked):
    comp = {k: k for k in range(len(ids))}
    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b) and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = {k: new if v == old else v for k, v in comp.items()}
    return [min(ids[k] for k in comp if comp[k] == comp[n]) for n in range(len(ids))]


def test_jaccard_components(docs, rows):
    named = [(i, t) for i, t in rows if i is not None]
    sets = []
    for _, t in named:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = brute_components([i for i, _ in named], lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    # an id names one document: rows with an id of their own text are compared
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.similar_components(docs).where("doc_id is not null").collect()}
    for (i, _), s, c in zip(named, sets, comp, strict=True):
        assert got[i, len(s)] == c, i
    assert jaccard_join.similar_components(docs).where("doc_id is null and component_id is null").count() == 1


def test_jaccard_random_near_copies(spark):
    r, texts = random.Random(9), []
    for family in range(6):
        base = prose(60, 100 + family).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    expected = brute_components(list(range(len(texts))), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    same(jaccard_join.similar_components(df).select("doc_id", "component_id"), list(enumerate(expected)))
    assert jaccard_join.keep_one(df).count() == len(set(expected))


def removed(texts, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    count = {}
    for w in words:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] = count.get(tuple(w[k : k + window]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_repeated_phrases(docs, rows):
    same(repeated_phrases.remove_repeated(docs), [(i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows]), strict=True)])
    clean = repeated_phrases.cleaned(docs)
    assert clean.dtypes == docs.dtypes
    before, after = ({(r.n_chars if r.text is None or r.text == "" else 0, r.row_id, r.lang) for r in d.collect()} for d in (docs, clean))
    assert {x[1:] for x in before} == {x[1:] for x in after}
    assert {r.row_id for r in clean.collect() if r.text is None} == {r.row_id for r in docs.collect() if r.text is None}


def test_repeated_phrases_bounds_and_overlaps(spark):
    base = prose(120, 50).split()
    texts = [" ".join(base), " ".join(base[10:44]), " ".join(base[10:45]), " ".join(["q"] + base[30:80] + base[70:110]), " ".join(["z"] * 36), " ".join(["y"] * 35), " ".join(base[60:95] + ["w"] + base[60:94])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same(repeated_phrases.remove_repeated(df), [(i, *r) for i, r in enumerate(removed(texts))])


def test_token_counts_and_cache(spark, docs, rows, tmp_path):
    t = Tokenizer.from_file(BYTE)
    expected = [(i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows]
    cache = f"file://{tmp_path}/cache"
    same(token_counts.count_tokens(docs, BYTE, cache), expected)
    n = spark.read.parquet(cache).count()
    assert n == len({x for _, x in rows})
    same(token_counts.count_tokens(docs, BYTE, cache), expected)
    assert spark.read.parquet(cache).count() == n
    same(token_counts.count_tokens(docs, WORD, cache).select("n_bytes"), [(x[1],) for x in expected])
    assert spark.read.parquet(cache).count() == 2 * n


def test_sentencepiece_counts(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    same(token_counts.count_tokens(docs, path).select("doc_id", "n_tokens"), [(i, len(sp.encode(x))) for i, x in rows])


def test_resharding(docs, rows):
    out = resharding.initial_and_new(docs, 5, 7).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.content, r.size) for r in out) == sorted((i is None, i, t, len(t.encode()) + 8) for i, t in rows)
    counts = {}
    for r in out:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(j, [])) for j in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_resharding_moves_the_smallest_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "CELL_ROWS", 40)
    r = random.Random(12)
    sizes = [r.choice([5, 5, 20, 21, 90, 300, 2000]) for _ in range(500)]
    rows = [(i if i % 3 else None, "x" * n) for i, n in enumerate(sizes)] + [(7, "same")] * 200
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    resharding.lay_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, old)
    before = [(x.old, x.row_id, x.content) for x in spark.read.parquet(old).collect()]
    for shards in (7, 3):
        out = resharding.reshard(spark, old, new + str(shards), shards).collect()
        counts = [sum(x.shard == j for x in out) for j in range(shards)]
        assert max(counts) - min(counts) <= 1 and sorted((x.shard, x.slot) for x in out) == [(j, k) for j in range(shards) for k in range(counts[j])]
        least = 0
        for k in range(5):  # what a shard gives are its smallest rows
            mine = sorted(len(c) + 8 for o, _, c in before if o == k)
            least += sum(mine[: max(0, len(mine) - counts[k])]) if k < shards else sum(mine)
        stay = sum(counts) - sum(max(0, sum(o == k for o, _, _ in before) - (counts[k] if k < shards else 0)) for k in range(5))
        written = sum(x.size for x in out)
        assert stay > 0 and least < written
        plan = [t for t in resharding.plan_transfers([tuple(x) for x in spark.read.parquet(old).groupBy("old", "block").agg({"old": "count", "size": "sum"}).orderBy("old", "block").select("old", "block", "count(old)", "sum(size)").collect()], shards)]
        assert sum(t.high - t.low for t in plan if t.shard != t.old) == len(before) - stay


def test_transfers_move_the_fewest_bytes():
    # shard 0 has 4 rows too many, and its second block is the lighter one
    blocks = [(0, 0, 6, 6000), (0, 1, 6, 600), (1, 0, 4, 400)]
    moves = [t for t in resharding.plan_transfers(blocks, 2) if t.shard != t.old]
    assert [(t.old, t.block, t.high - t.low, t.shard) for t in moves] == [(0, 1, 4, 1)]


def test_warc(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u", ""), (4, "u\r\nX: y", None), (6, "v", "é" * 40_000 + "\r\n\r\n0\r\n"), (7, "w", "é" * 40_000 + "\r\n\r\n0\r\n"), (None, "n", "alone"), (8, "z", "z" * 16_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[5], "x"), (*rows[6], "x")], "page_id long, url string, html string, payload string")
    every = [r for r in rows] + [rows[5], rows[6]]
    keep = {}
    for i, _, h in every:
        if i is not None:
            keep[h or ""] = max(keep.get(h or "", i), i)
    expected = []
    for i, _, h in every:
        b, last = (h or "").encode(), keep.get(h or "", i)
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last == i else "revisit", None if last == i else last))
    out = warc.resolve_revisits(warc.round_trip(pages)).select("page_id", "payload_bytes", "digest", "type", "refers_to")
    same(out, expected)


def test_warc_faults():
    assert warc.dechunked(warc.chunked(b"x" * 9000)) == b"x" * 9000 and warc.dechunked(b"3;a=b\r\nabc\r\n0\r\nT: x\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"abc"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(bad)
    parts = [(2, 6, b"def"), (1, None, b"abc")]
    assert warc.reassembled(parts) == b"abcdef" and warc.reassembled([*parts, parts[0]]) == b"abcdef"
    for bad in ([parts[0]], [(1, None, b"abc"), (2, 7, b"def")], [(1, None, b"a"), (3, 2, b"b")]):
        with pytest.raises(warc.WarcError):
            warc.reassembled(bad)
    with pytest.raises(warc.WarcError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    vectors = [b + rng.standard_normal(16) * s for b in base for s in (0, 0, 0.1, 0.3)] + [base[0] * 5, base[1] * -1, base[2] * 1e200, base[3] * 1e-200]
    raw = [x.tolist() for x in vectors] + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [], [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(1000 - i, v, 0) for i, v in enumerate(raw)], "vec_id long, embedding array<double>, node int").repartition(3)
    good = [i for i, v in enumerate(raw) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.asarray(raw[i]) / np.abs(raw[i]).max() for i in good}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    links = {(a, b) for a in good for b in good if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    true, found = len(links), sum(r.n_links for r in got.values())
    assert 0.97 * true <= found <= true and len(got) == len(raw)
    comp = brute_components([1000 - i for i in range(len(raw))], lambda a, b: (a, b) in links)
    assert sum(got[1000 - i].component_id == c for i, c in enumerate(comp)) >= 0.97 * len(comp)
    assert all(got[1000 - i].n_links == 0 for i in range(len(raw)) if i not in good)


def test_many_equal_and_near_vectors(spark):
    rng = np.random.default_rng(4)
    hub = rng.standard_normal(8)
    near = [(hub + rng.standard_normal(8) * 0.01).tolist() for _ in range(2500)]  # more than two blocks of a bucket
    df = spark.createDataFrame([(i, v) for i, v in enumerate(near + [hub.tolist()] * 50)], "vec_id long, embedding array<float>")
    rows = embedding_dedup.near_duplicates(df).collect()
    assert {r.component_id for r in rows} == {0} and {r.n_links for r in rows} == {2549}


def test_quality(spark, docs):
    r = random.Random(8)
    rows = [(i, prose(60, 200 + i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60, 200 + i).split())) for i in range(400)]
    labelled = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(400) if r.random() < 0.6] + [(1000, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(labelled, labels).collect()
    assert len(out) == 402 and all(0 <= x.score <= 1 for x in out)
    for x in out:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == (x.score >= 0.3)
    held = [x for x in out if x.held_out and x.doc_id < 400]
    assert np.mean([x.predicted == (x.doc_id % 3 > 0) for x in held]) > 0.95
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    one = quality.classify(labelled, labels.where("quality = 1"))
    assert one.where("predicted = 0").count() == 0
    model = quality.fit(labelled, labels)
    kept = quality.keep_good(docs, model)
    assert kept.dtypes == docs.dtypes


def auc(scores, labels):
    place = np.argsort(np.argsort(scores, kind="stable"))
    ones = labels.sum()
    return (place[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the given tables")
def test_quality_on_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    known = docs.join(labels.select("doc_id", "quality"), "doc_id")
    out = quality.score(known, model).where("held_out").join(known.select("doc_id", "quality", "text"), "doc_id").collect()
    assert auc(np.asarray([r.score for r in out]), np.asarray([r.quality for r in out])) > 0.93
    # scored one by one, from the vectors' mean and a softmax
    for r in out[:40]:
        (_, _, w), *more = words(pa.array([r.text]))
        assert not more
        z = model.weights @ model.vectors[quality.features(w)[1]].mean(axis=0) + model.bias
        assert abs(1 / (1 + np.exp(z[0] - z[1])) - r.score) < 1e-4


def test_training_takes_long_texts(spark):
    docs = spark.createDataFrame([(i, prose(12_000 if i % 2 else 20, i)) for i in range(1, 9)], "doc_id long, text string")
    sample = quality.training_sample(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int"))
    assert set(sample["row_id"]) == {i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5}
    for i, ids, shares in zip(sample["row_id"], sample["ids"], sample["shares"], strict=True):
        (_, ours, theirs) = quality.bags(pa.array([prose(12_000 if i % 2 else 20, i)]))
        assert np.array_equal(np.frombuffer(ids, "<i4"), ours) and np.allclose(np.frombuffer(shares, "<f4"), theirs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    vectors, pages = spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        exact_dedup.duplicate_groups(docs), exact_dedup.drop_duplicates(docs), bpe_tree.encode_decode(docs, WORD), packing.concatenate_and_cut(docs, WORD, 1), token_counts.count_tokens(docs, BYTE),
        jaccard_join.similar_components(docs), repeated_phrases.remove_repeated(docs), repeated_phrases.cleaned(docs), embedding_dedup.near_duplicates(vectors), quality.classify(docs, labels),
        resharding.initial_and_new(docs, 3, 4), warc.resolve_revisits(warc.round_trip(pages)),
    ):
        assert df.count() == 0


def test_automata_alone_decide_what_is_removed(monkeypatch):
    base = prose(80, 70).split()
    fragments = {" ".join(base).encode(): 1, " ".join(["q"] + base[5:60]).encode(): 1, "\n".join(base[20:54]).encode(): 2}
    found = dict(repeated_phrases._shard(fragments, 35))
    assert sorted(found.values()) == [[1, 56], [5, 60]]

    class Silent:
        def iter(self, ids):
            return iter(())

    monkeypatch.setattr(repeated_phrases, "automaton_of", lambda patterns: Silent())
    assert not list(repeated_phrases._shard(fragments, 35))


def test_passages_are_compiled_once():
    base = prose(100, 71).split()
    fragments = {" ".join(base).encode(): 1, " ".join(base[:70] + ["x"]).encode(): 1, " ".join(["y"] + base[30:]).encode(): 1}
    offsets = np.cumsum([0, *map(len, fragments)])
    w = repeated_phrases.Words(np.frombuffer(b"".join(fragments), np.uint8), offsets, lower=False)
    passages = repeated_phrases.recurring_passages(w, np.ones(3, np.int64), 35)
    # windows of both others, of one and of the other of them
    assert sorted(len(p) for p in passages) == [40, 64, 64]


def test_repeated_phrases_common_line_and_many_null_ids(spark, monkeypatch):
    monkeypatch.setattr(repeated_phrases, "HOT_PLACES", 5)
    line = " ".join(WORDS[:20])
    texts = [prose(30, 400 + i) + " " + line + " " + prose(30, 500 + i) for i in range(60)] + [prose(30, 400) + " " + line + " end"] * 40
    df = spark.createDataFrame([(None if i % 2 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, text_key string, _salt int").repartition(5)
    expected = removed(texts)
    same(repeated_phrases.remove_repeated(df), [(None if i % 2 else i, *r) for i, r in enumerate(expected)])
    monkeypatch.setattr("refloom.llm.common.HEAVY_ROWS", 5)
    same(repeated_phrases.remove_repeated(df), [(None if i % 2 else i, *r) for i, r in enumerate(expected)])
    assert sorted((r._salt, r.text_key) for r in repeated_phrases.cleaned(df).collect()) == [(1, "x")] * 100


def test_windows_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeated_phrases, "STRETCH", 7)
    base = prose(200, 72)
    texts = [base, base + " more", prose(50, 73) + " " + base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(repeated_phrases.remove_repeated(df), [(i, *r) for i, r in enumerate(removed(texts))])
