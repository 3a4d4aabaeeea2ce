"""The pipeline, stage by stage, against brute force on a small corpus."""

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from refloom.llm import quality
from tests.llm.test_edges import PASSAGE, WORD, WORDS, brute_components, prose, removed


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, texts = random.Random(3), []
    for i in range(120):
        good = prose(50 + i % 40, 300 + i)
        texts.append(good if i % 4 else " ".join(w.upper() + "!!" for w in good.split()))
    texts += [texts[1], texts[1] + " ", texts[2]] + [t + " tail" for t in texts[5:8]]
    texts += [prose(30, 900 + k) + " " + PASSAGE + " " + prose(20, 950 + k) for k in range(4)] + ["", None, r.choice(WORDS)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs, last = spark.read.parquet(f"{tmp_path}/{name}"), docs
        if name == "packing":
            break
        assert docs.dtypes == last.dtypes
        rows = docs.collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows)
        if name == "quality":
            model = quality.fit(last, spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(now) == {r.doc_id for r in quality.score(last, model).where("predicted = 1").collect()}
            assert {i for i in range(120) if i % 4} <= set(now) and not {i for i in range(120) if i % 4 == 0} & set(now)
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[n] = min(best.get(n, (1, 0)), (-len(t or ""), i))
            assert set(now) == {i for _, i in best.values()}
        if name == "near_dedup":
            ids = sorted(before)
            sets = [shingles(before[i] or "") for i in ids]
            comp = brute_components(ids, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
            assert set(now) == set(comp) and len(now) < len(before)
        if name == "repeated_passages":
            ids = list(before)
            expected = {i: before[i] if not gone else text for i, (_, gone, text) in zip(ids, removed([before[i] or "" for i in ids]), strict=True)}
            assert now == expected and any(now[i] != before[i] for i in now)
            assert all(r.n_chars == len(r.text or "") for r in rows)
        before = kept[name] = now
    tokenizer, got = Tokenizer.from_file(WORD), {}
    for p in docs.collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 2048
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert np.array_equal(np.cumsum([0] + [x[2] for x in places[:-1]]), [s * 2048 + o for s, o, _ in places])


def test_results_of_others_outlive_the_pipeline(spark, folder):
    from refloom.llm import embedding_dedup, packing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lazy = packing.concatenate_and_cut(docs, WORD, 1)
    vectors = embedding_dedup.near_duplicates(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<float>"))
    corpus_pipeline.run(spark, folder).count()
    assert lazy.select("doc_id").distinct().count() == docs.count() and vectors.count() == 20


def test_empty_table_and_clashing_columns(spark, tmp_path):
    clash = ["_digest", "_copy", "_kept_id", "_gone_id", "row", "text_key", "_salt", "kept_id", "digest", "copy", "content", "id"]
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    for rows in ([], [(i, t, "en", "s", len(t or ""), *clash) for i, t in enumerate([prose(40, 7), prose(40, 7) + " ", prose(41, 8), None])]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = tmp_path / f"{name}-{len(rows)}"
            stage(spark, docs, str(tmp_path)).write.parquet(str(out))
            last, docs = docs, spark.read.parquet(str(out))
            if name != "packing":
                assert docs.columns == last.columns and {tuple(r[c] for c in clash) for r in docs.collect()} == {tuple(clash)} - (set() if rows else {tuple(clash)})
        assert bool(docs.count()) == bool(rows)
