import io
import os
import zipfile

import pytest

from refloom.plans import convert as C
from refloom.sources import docx as D

HEAD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="urn:w14"'


def document(*paras):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {HEAD}><w:body>{"".join(paras)}</w:body></w:document>')
        z.writestr("word/styles.xml", "<x/>")
    return out.getvalue()


def para(*runs):
    return "<w:p>" + "".join(r if r.startswith("<") else f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def mark(kind):
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def instruction(text):
    return f"<w:r><w:instrText>{text}</w:instrText></w:r>"


def test_field_over_paragraphs_and_split_instruction():
    d = D.describe(document(para("before ", mark("begin"), instruction(' ADDIN ZOTERO_ITEM CSL_CITATION {"citationID":'), instruction('"a1"}'), mark("separate"), "shown"), para("still (10.1/x)"), para(mark("end"), "after")))
    assert len(d["fields"]) == 1 and d["fields"][0]["closed"] and d["fields"][0]["display"] == "shownstill (10.1/x)"
    assert d["fields"][0]["instruction"].endswith('"citationID":"a1"}')
    assert [p["text"] for p in d["paragraphs"]] == ["before ", "", "after"] and d["structure_errors"] == 0


def test_nested_fields_and_stories():
    box = f"<w:r><w:txbxContent>{para(mark('begin'), instruction('X'), mark('separate'), 'box', mark('end'))}</w:txbxContent></w:r>"
    d = D.describe(document(para(mark("begin"), instruction("A "), mark("begin"), instruction("B"), mark("separate"), "1", mark("end"), instruction("C"), mark("separate"), "yes", box, mark("end"))))
    assert [(f["instruction"], f["display"], f["around"]) for f in d["fields"]] == [("A C", "yes", []), ("B", "1", [0]), ("X", "box", [])]
    assert d["structure_errors"] == 0


@pytest.mark.parametrize("runs", [[mark("end")], [mark("begin")], [mark("separate")], [mark("end"), mark("begin")], [mark("begin"), mark("separate"), mark("separate"), mark("end")]])
def test_malformed_fields_are_errors(runs):
    assert D.describe(document(para(*runs)))["structure_errors"] > 0


def test_atomic_save(tmp_path):
    path = tmp_path / "a.docx"
    path.write_bytes(b"old")
    with pytest.raises(TypeError):
        D.save_document("not bytes", str(path))
    assert path.read_bytes() == b"old" and os.listdir(tmp_path) == ["a.docx"]
    D.save_document(b"new", str(path))
    assert path.read_bytes() == b"new"


MAPPING = "ref_key string, ord int, item_key string, uri string, csl string, doi string, first_author string, year string, is_nih boolean"
CSL = '{"type":"book","title":"t","author":"a","issued":"1"}'


@pytest.fixture(scope="module")
def converted(spark):
    kept = para("Old ", mark("begin"), instruction(' ADDIN ZOTERO_ITEM CSL_CITATION {"citationID":"cit7","citationItems":[{"uris":["http://local/items/K1"],"itemData":{"type":"b","title":"t","author":"a","issued":"1"}}]} '), mark("separate"), "(10.1234/ax)", mark("end"))
    table = f"<w:tbl><w:tr><w:tc>{para('10.1234/ax')}</w:tc></w:tr></w:tbl>"
    source = document(para("Claim (10.1234/ax; ", "10.5678/by) and"), para("more (Smith, 2007)."), kept, table, para("[1] Smith J. A. B. 2007."))
    docs = spark.createDataFrame([("a", "/x/a.docx", bytearray(source))], "doc_id string, path string, content binary")
    mapping = spark.createDataFrame([("ax", 0, "K1", "", CSL, "10.1234/AX", "Gao", "2014", False), ("by", 1, "K2", "", CSL, "10.5678/by", "Ng", "2001", False), ("s", 2, "K3", "", CSL, "", "Smith", "2007", False)], MAPPING)
    return docs, mapping, C.convert(docs, mapping, reference_paras=[3], tables=True).cache()


def test_conversion(spark, converted):
    docs, mapping, out = converted
    row = out.first()
    assert row.citations == 3
    assert zipfile.ZipFile(io.BytesIO(row.content)).read("word/styles.xml") == b"<x/>"
    found = D.describe(bytes(row.content))
    ids = [f["instruction"] for f in found["fields"] if "CSL_CITATION" in f["instruction"]]
    assert [i.split('"citationID":"')[1].split('"')[0] for i in ids] == ["cit8", "cit9", "cit7", "cit10"]
    keys = spark.createDataFrame([("K1",), ("K2",), ("K3",)], "item_key string")
    checked = C.verify(out.select("doc_id", "path", "content"), keys, docs, mapping).first()
    assert checked.ok and checked.cites == 4 and checked.missed == 0
    missed = C.verify(docs, keys, docs, mapping).first()
    assert not missed.ok and missed.missed == 3
    assert not C.verify(out.select("doc_id", "path", "content"), keys.limit(1)).first().ok


def test_conversion_twice_changes_nothing(converted):
    _, mapping, out = converted
    again = C.convert(out.select("doc_id", "path", "content"), mapping, reference_paras=[4], tables=True).first()
    assert again.citations == 0
    first, second = (D.describe(bytes(x)) for x in (out.first().content, again.content))
    assert first["fields"] == second["fields"]


def test_scan(converted):
    row = C.scan(converted[2].select("doc_id", "path", "content")).first()
    assert (row.n_citation, row.n_bibliography, row.n_preferences, row.n_duplicated, row.n_nested, row.max_numeric) == (4, 1, 1, 0, 0, 10)


def test_deep_nesting_and_equal_names(spark, tmp_path):
    from xml.etree import ElementTree as ET

    inner = root = ET.Element(D.tag("body"))
    for _ in range(5000):
        inner = ET.SubElement(inner, D.tag("sdt"))
    p = ET.SubElement(inner, D.tag("p"))
    ET.SubElement(p, D.tag("t")).text = "deep"
    parsed = D.parse_tree(root)
    assert parsed.outside[0] == ["deep"] and parsed.errors == 0
    rows = [(f"file:/x/a/n.docx", bytearray(b"1")), (f"file:/x/b/n.docx", bytearray(b"2"))]
    D.save_documents(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path))
    assert (tmp_path / "a/n.docx").read_bytes() == b"1" and (tmp_path / "b/n.docx").read_bytes() == b"2"
