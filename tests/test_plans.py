import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from refloom.__main__ import main
from refloom.functions import metadata as M
from refloom.plans import convert, ingest, repair
from refloom.sources import docx as D
from refloom.streaming import references
from tests.test_documents import CSL, MAPPING, document, instruction, mark, para

COLUMNS = "doc_id string, path string, content binary"


def cited(cid, key, display, doi="10.1234/ax"):
    payload = {"citationID": cid, "properties": {"dontUpdate": False}, "citationItems": [{"uris": [f"http://local/items/{key}"], "itemData": {"type": "b", "title": "t", "author": "a", "issued": "1", "DOI": doi}}]}
    return para(mark("begin"), instruction(" ADDIN ZOTERO_ITEM CSL_CITATION " + json.dumps(payload)), mark("separate"), display, mark("end"))


@pytest.fixture(scope="module")
def docs(spark):
    content = document(cited("cit0", "K1", "(doi:10.1234/ax)"), cited("cit0", "K2", "(doi:10.5678/by)", "10.5678/by"))
    return spark.createDataFrame([("a", "/x/a.docx", bytearray(content))], COLUMNS)


def ids(row):
    return [json.loads(f["instruction"].split("CSL_CITATION")[1]) for f in D.describe(bytes(row.content))["fields"]]


def test_renumber_documents(spark, docs):
    out = repair.renumber_documents(docs, prefix="s").first()
    assert out.changed == 2 and [p["citationID"] for p in ids(out)] == ["s0", "s1"]
    chosen = spark.createDataFrame([("a", "(doi:10.5678/by)")], "doc_id string, display string")
    assert [p["citationID"] for p in ids(repair.renumber_documents(docs, chosen, "s").first())] == ["cit0", "s0"]
    assert repair.renumber_documents(docs, chosen.limit(0), "s").first().changed == 0
    original = spark.createDataFrame([("a", "/x/o.docx", bytearray(document(cited("cit0", "K1", "(doi:10.1234/ax)"))))], COLUMNS)
    assert [r.display for r in repair.new_displays(docs, original).collect()] == ["(doi:10.5678/by)"]


def test_relink_documents(spark, docs):
    out = repair.relink_documents(docs, spark.createDataFrame([("K1", "NEW")], "old string, new string")).first()
    assert out.changed == 1 and [p["citationItems"][0]["uris"][0] for p in ids(out)] == ["http://local/items/NEW", "http://local/items/K2"]


@pytest.mark.parametrize("mapping,why", [
    ([("K1", "10.1234/ax"), ("K2", "10.5678/by")], [None, None]),
    ([("K9", "10.1234/ax"), ("K2", "10.5678/by")], ["uri differs", None]),
])
def test_audit_documents(spark, docs, mapping, why):
    source = spark.createDataFrame([("a", "/x/s.docx", bytearray(document(para("a (doi:10.1234/ax)"), para("b (doi:10.5678/by) and (doi:10.5678/by)"))))], COLUMNS)
    rows = repair.audit_documents(source, docs, spark.createDataFrame(mapping, "item_key string, doi string")).collect()
    got = sorted(((r.para, r.why) for r in rows), key=str)
    assert got == sorted([(0, why[0]), (1, why[1]), (1, "no field")], key=str)


def test_cite_in_tables(spark):
    def row(*cells):
        return "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"

    table = "<w:tbl>" + row("Strain", "DOI", "Ref") + row("x", "doi:10.1234/ax", "(1)") + row("y", "10.9/none", "(2)") + row("short") + "</w:tbl>"
    docs = spark.createDataFrame([("a", "/x/a.docx", bytearray(document(table)))], COLUMNS)
    mapping = spark.createDataFrame([("ax", 0, "K1", "", CSL, "10.1234/AX", "Gao", "2014", False)], MAPPING)
    out = repair.cite_in_tables(docs, mapping, 1, 2)
    found = D.describe(bytes(out.first().content))
    assert out.first().changed == 1 and [f["display"] for f in found["fields"] if "CSL_CITATION" in f["instruction"]] == ["(1)"]
    again = repair.cite_in_tables(out.select("doc_id", "path", "content"), mapping, 1, 2).first()
    assert again.changed == 0
    assert convert.verify(out.select("doc_id", "path", "content"), spark.createDataFrame([("K1",)], "item_key string")).first().ok


def test_ingest(spark):
    texts = ["Intro", "[1] Smith J. Human emotion. Cognition. 2007. doi:10.1/a.", "[2] Lee M. A study. J Sci. 2020.", "[3] Void N. Nothing here. J. 1999."]
    paragraphs = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, para int, text string")
    none = F.lit(None).cast("string")

    def stage(rows, provider):
        raw = spark.createDataFrame(rows, "ref_key string, title string, fam string, year int, doi string, rank int")
        author = F.array(F.struct(F.col("fam").alias("family"), F.lit("X").alias("given"), none.alias("name")))
        csl = M.from_provider(F.lit("journal-article"), F.col("title"), author, F.array(F.array("year")), none, none, none, none, none, F.col("doi"))
        return raw.select("ref_key", F.lit(provider).alias("provider"), csl.alias("csl"), "rank")

    stages = [stage([("smith2007", "Human emotion", "Smith", 2007, "10.1/A", 0)], "doi"), stage([("smith2007", "Wrong", "Wrong", 1900, "", 0), ("lee2020", "A study", "Lee", 2020, "10.2/b", 0), ("void1999", "Unlike", "Nobody", 1800, "", 0)], "search")]
    items = spark.createDataFrame([("K1", 0, "Human Emotion", "10.1/a")], "key string, ord int, title string, doi string")
    run = ingest.plan(paragraphs, stages, items)
    resolved = {r.ref_key: (r.provider, r.confidence, r.level, r.resolve_error) for r in run.resolved.collect()}
    assert resolved == {"smith2007": ("doi", 1.0, "HIGH", False), "lee2020": ("search", 1.0, "HIGH", False), "void1999": (None, 0.0, "UNKNOWN", True)}
    assert {r.ref_key: (r.outcome, r.target_key) for r in run.plan.collect()} == {"smith2007": ("precheck_reused", "K1"), "lee2020": ("create", None)}
    stats = run.statistics.first()
    assert (stats.total, stats.resolved, stats.low_confidence, stats.dups, stats.imported, stats.skipped, stats.warnings) == (3, 2, 1, 1, 2, 1, 0)


    def library(there):
        def call(tool, args):
            if tool == "search_library":
                return {"results": [{"key": "THERE001"}] if there else []}
            if tool == "get_item_details":
                return {"key": "THERE001", "DOI": "10.2/B"}
            assert tool == "write_item" and not there
            return {"data": {"key": "NEWKEY01"}} if args["itemType"] == "journalArticle" else {}

        return call

    # a task that runs again finds what it has created
    assert [r.item_key for r in ingest.create_items(ingest.creations(run), lambda: library(True)).collect()] == ["THERE001"]
    created = ingest.create_items(ingest.creations(run), lambda: library(False))
    mapping = {r.ref_key: (r.itemKey, r.uri, r.first_author, r.year) for r in ingest.imported(run, created, "http://l/items/").collect()}
    assert mapping == {"smith2007": ("K1", "http://l/items/K1", "Smith", "2007"), "lee2020": ("NEWKEY01", "http://l/items/NEWKEY01", "Lee", "2020")}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.docx").write_bytes(document(para("a (doi:10.1234/ax)")))
    (tmp_path / "o.docx").write_bytes(document(cited("cit0", "K1", "(doi:10.1234/ax)")))
    (tmp_path / "m.json").write_text('{"item_key": "K1", "doi": "10.1234/ax"}\n')
    (tmp_path / "bad.json").write_text('{"item_key": "K2", "doi": "10.1234/ax"}\n')
    assert main(["audit", f"{tmp_path}/s.docx", f"{tmp_path}/o.docx", f"{tmp_path}/m.json"]) == 0
    assert main(["audit", f"{tmp_path}/s.docx", f"{tmp_path}/o.docx", f"{tmp_path}/bad.json"]) == 1
    assert main(["scan", f"{tmp_path}/none.docx"]) == 2
    capsys.readouterr()
    assert main(["scan", f"{tmp_path}/o.docx"]) == 0 and json.loads(capsys.readouterr().out)[0]["n_citation"] == 1
    (tmp_path / "out").mkdir()
    assert main(["relink", f"{tmp_path}/o.docx", "K1=K7", "--out", f"{tmp_path}/out"]) == 0
    assert "items/K7" in zipfile.ZipFile(tmp_path / "out" / "o.docx").read("word/document.xml").decode()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"ts": "2024-01-01T00:00:00Z", "text": "[1] Smith J. Human emotion. Cognition. 2007."})
    (tmp_path / "in" / "a.json").write_text(f"{line}\n{line}\n" + json.dumps({"ts": "2024-01-01T00:01:00Z", "text": " "}) + "\n")
    stream = references.parsed_stream(spark.readStream.schema("ts timestamp, text string").json(f"{tmp_path}/in"))
    references.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(60)
    assert [r.parsed.base_key for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["smith2007"]


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
