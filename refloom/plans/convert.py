"""Turning the plain citations of Word documents into fields, and checking the result.

Text blocks are runs of plain text inside a paragraph. The citations in them are found by the plan of
operators.spans, numbered by windows, made into payloads by Column functions, and written back document by document.
"""

from __future__ import annotations

import copy
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions import text as T
from refloom.functions.arrow import arrow
from refloom.operators import audit, fields, spans
from refloom.sources.docx import XML_SPACE, fields_of, main_part, paragraphs_of, parse_documents, parse_tree, tag, with_main_part

# The schema named in payloads, and the default style and program version of the preferences.
SCHEMA = "https://github.com/citation-style-language/schema/raw/master/csl-citation.json"
VERSION, LOCALE = "9.0.6", "en-US"
DROPPED = ("proofErr", "lastRenderedPageBreak")


def _name(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _pieces(paragraph, protected: set[int]):
    """What a paragraph consists of: (is text, element), a run with other content than text cut into one run for each child."""
    for child in paragraph:
        name = _name(child)
        if name in DROPPED and id(child) not in protected:
            continue
        if name != "r":
            yield False, child
            continue
        content = [c for c in child if _name(c) != "rPr"]
        plain = [_name(c) == "t" and id(c) not in protected for c in content]
        if not content or all(plain) or not any(plain):
            yield bool(content) and all(plain), child
            continue
        style = child.find(tag("rPr"))
        for c, is_text in zip(content, plain, strict=True):
            if _name(c) in DROPPED and id(c) not in protected:
                continue
            part = ET.Element(child.tag, dict(child.attrib))
            if style is not None:
                part.append(copy.deepcopy(style))
            part.append(c)
            yield is_text, part


def _blocks(paragraph, protected: set[int]) -> list[list]:
    """Pieces in order, with runs of text next to each other in one list."""
    out: list[list] = []
    text_before = False
    for is_text, element in _pieces(paragraph, protected):
        if is_text and text_before:
            out[-1].append(element)
        else:
            out.append([element] if is_text else element)
        text_before = is_text
    return out


def _text(run) -> str:
    return "".join(t.text or "" for t in run.findall(tag("t")))


def _targets(root, tables: bool):
    """(paragraph number in the document, position in the body or None, paragraph) of what may be converted."""
    body = root.find(tag("body"))
    top = {id(p): i for i, p in enumerate(body.findall(tag("p")))}
    cells = {id(p) for c in body.iter(tag("tc")) for p in c.iter(tag("p"))} if tables else set()
    for number, p in enumerate(root.iter(tag("p"))):
        if id(p) in top or id(p) in cells:
            yield number, top.get(id(p)), p


@arrow("array<struct<para:int,body_para:int,block:int,text:string>>")
def text_blocks(contents: pd.Series) -> pd.Series:
    def find(content):
        root = main_part(content)
        protected = parse_tree(root).protected
        return [
            {"para": n, "body_para": at, "block": k, "text": "".join(_text(r) for r in b)}
            for n, at, p in _targets(root, tables=True) for k, b in enumerate(_blocks(p, protected)) if isinstance(b, list)
        ]

    return contents.map(find)


def citation_payloads(found: DataFrame, mapping: DataFrame, first_id: DataFrame, prefix: str) -> DataFrame:
    """found (doc_id, para, start, end, display, keys) with citation_id and payload.

    mapping: (ref_key, item_key, uri, csl), csl as JSON. Ids count on from first_id (doc_id, next_id) in text
    order; item numbers follow first use in the document.
    """
    order = ["para", "start"]
    numbered = found.join(first_id, "doc_id", "left").withColumn("citation_id", F.concat(F.lit("cit"), (F.coalesce("next_id", F.lit(0)) + F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).cast("string")))
    uses = numbered.select("doc_id", "para", "start", "citation_id", "display", F.posexplode("keys").alias("no", "ref_key"))
    item_ids = fields.first_use_id(uses, ["doc_id"], "ref_key", ["para", "start", "no"])
    rows = uses.join(item_ids, ["doc_id", "ref_key"]).join(mapping, "ref_key")
    item = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit(', "uris": ['), F.to_json(F.array(T.item_uri("item_key", "uri", None, prefix))).substr(F.lit(2), F.length(F.to_json(F.array(T.item_uri("item_key", "uri", None, prefix)))) - 2), F.lit('], "itemData": '), "csl", F.lit("}"))
    grouped = rows.groupBy("doc_id", "para", "start", "citation_id", "display").agg(F.array_sort(F.collect_list(F.struct("no", item.alias("item")))).alias("items"))
    head = F.to_json(F.struct("citation_id", F.struct(F.col("display").alias("formattedCitation"), F.col("display").alias("plainCitation"), F.lit(False).alias("dontUpdate"), F.lit(0).alias("noteIndex")).alias("properties")))
    head = F.replace(head, F.lit('"citation_id"'), F.lit('"citationID"'))
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(',"citationItems":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit(f'],"schema":"{SCHEMA}"}}'))
    return found.join(grouped.select("doc_id", "para", "start", "citation_id", body.alias("payload")), ["doc_id", "para", "start"])


def _field(instruction: str, display: str, style) -> list:
    """The five runs of a field."""
    runs = []
    for part in ("begin", "instruction", "separate", "display", "end"):
        run = ET.Element(tag("r"))
        if style is not None:
            run.append(copy.deepcopy(style))
        if part in ("instruction", "display"):
            leaf = ET.SubElement(run, tag("instrText" if part == "instruction" else "t"), {XML_SPACE: "preserve"})
            leaf.text = f" ADDIN {instruction} " if part == "instruction" else display
        else:
            ET.SubElement(run, tag("fldChar"), {tag("fldCharType"): part})
        runs.append(run)
    return runs


def _cut(runs: list, low: int, high: int) -> list:
    """Runs with the characters low to high of those of runs."""
    out, at = [], 0
    for run in runs:
        text = _text(run)
        part = text[max(0, low - at) : max(0, high - at)]
        at += len(text)
        if part:
            new = ET.Element(run.tag, dict(run.attrib))
            style = run.find(tag("rPr"))
            if style is not None:
                new.append(copy.deepcopy(style))
            ET.SubElement(new, tag("t"), {XML_SPACE: "preserve"}).text = part
            out.append(new)
    return out


def _style_at(runs: list, place: int):
    at = 0
    for run in runs:
        at += len(_text(run))
        if place <= at:
            return run.find(tag("rPr"))
    return None


def rewrite(content: bytes, citations: list[tuple[int, int, int, int, str, str]], bibliography: tuple[list[int], str] | None = None, preferences: str | None = None) -> bytes:
    """A document with citations (para, block, start, end, display, payload) as fields, and a bibliography and preferences where it has none."""
    root = main_part(content)
    parsed = parse_tree(root)
    wanted: dict[tuple[int, int], list] = {}
    for para, block, *rest in citations:
        wanted.setdefault((para, block), []).append(tuple(rest))
    body = root.find(tag("body"))
    top = body.findall(tag("p"))
    for number, _, p in list(_targets(root, tables=True)):
        blocks = _blocks(p, parsed.protected)
        if not any((number, k) in wanted for k in range(len(blocks))):
            continue
        children = []
        for k, block in enumerate(blocks):
            if not isinstance(block, list):
                children.append(block)
                continue
            at = 0
            for start, end, display, payload in sorted(wanted.get((number, k), [])):
                children += _cut(block, at, start) + _field(f"{fields.CITATION_MARK} {payload}", display, _style_at(block, start))
                at = end
            children += _cut(block, at, sum(len(_text(r)) for r in block)) if at else block
        p[:] = children
    kinds = "".join(f.text for f in parsed.fields if f.closed)
    if bibliography and bibliography[0] and fields.BIBLIOGRAPHY_MARK not in kinds:
        first, last = top[bibliography[0][0]], top[bibliography[0][-1]]
        at = next((i for i, c in enumerate(first) if _name(c) == "r"), 0)
        opening = _field(f"{fields.BIBLIOGRAPHY_MARK} {bibliography[1]} CSL_BIBLIOGRAPHY", "", None)
        for i, run in enumerate(opening[:3]):
            first.insert(at + i, run)
        last.append(opening[4])
    if preferences and fields.PREFERENCES_MARK not in kinds:
        hidden = ET.Element(tag("p"))
        style = ET.Element(tag("rPr"))
        ET.SubElement(style, tag("vanish"))
        for run in _field(f"{fields.PREFERENCES_MARK} {preferences}", "", style):
            hidden.append(run)
        body.insert(0, hidden)
    return with_main_part(content, root)


def preferences(style_id: str = T.STYLE_BASE + "apa", locale: str = LOCALE, version: str = VERSION) -> str:
    """The JSON of a document's preferences; the session is fixed, so that output depends on input alone."""
    import json

    return json.dumps({
        "style": {"styleID": style_id, "locale": locale, "hasBibliography": True, "bibliographyStyleHasBeenSet": False},
        "prefs": {"fieldType": "Field", "automaticJournalAbbreviations": False}, "sessionID": "sessrefloom", "zoteroVersion": version, "dataVersion": 4,
    })


def convert(docs: DataFrame, mapping: DataFrame, text_map: DataFrame | None = None, body_range: tuple[int, int] | None = None, reference_paras: list[int] | None = None, tables: bool = False, prefix: str = "http://local/items/", style_id: str = T.STYLE_BASE + "apa") -> DataFrame:
    """docs (doc_id, path, content) with the citations of mapping as fields: (doc_id, path, content, citations).

    mapping: (ref_key, ord, item_key, uri, csl, doi, first_author, year, is_nih), csl as JSON. Fields that are there
    already stay as they are, and their numbers are not used again.
    """
    parsed = parse_documents(docs)
    known = fields.with_payload(fields_of(parsed).where("closed")).select("doc_id", F.col("payload.citationID").alias("citation_id"))
    blocks = docs.select("doc_id", F.explode(text_blocks("content")).alias("b")).select("doc_id", "b.*")
    low, high = body_range or (0, 2**31 - 1)
    wanted = F.col("body_para").between(low, high - 1)
    blocks = blocks.where(wanted | F.col("body_para").isNull() if tables else wanted)
    texts = blocks.select("doc_id", F.struct("para", "block").alias("para"), "text")
    found = citation_payloads(spans.find_citations(texts, mapping, text_map), mapping.select("ref_key", "item_key", "uri", "csl"), fields.next_id(known, ["doc_id"]), prefix)
    listed = mapping.where(F.coalesce("item_key", F.lit("")) != "").agg(F.to_json(F.collect_list(F.array(T.item_uri("item_key", "uri", None, prefix)))).alias("u")).first()["u"] if reference_paras else "[]"
    bibliography = (reference_paras, f'{{"uncited": {listed}, "omitted": [], "custom": []}}') if reference_paras else None
    prefs = preferences(style_id)

    def write(doc: pd.DataFrame, cites: pd.DataFrame) -> pd.DataFrame:
        rows = [(p["para"], p["block"], int(s), int(e), d, j) for p, s, e, d, j in zip(cites["para"], cites["start"], cites["end"], cites["display"], cites["payload"], strict=True)]
        return pd.DataFrame({"doc_id": doc["doc_id"], "path": doc["path"], "content": [rewrite(c, rows, bibliography, prefs) for c in doc["content"]], "citations": [len(rows)] * len(doc)})

    found = found.select(F.col("doc_id").alias("of_doc"), "para", "start", "end", "display", "payload")
    return docs.groupBy("doc_id").cogroup(found.groupBy("of_doc")).applyInPandas(write, "doc_id string, path string, content binary, citations long")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its fields by kind, placeholders, ids and structure errors."""
    parsed = parse_documents(docs).cache()
    every = fields.with_payload(fields_of(parsed).where("closed"))
    kinds = every.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("citation", "bibliography", "preferences")), F.count(F.lit(1)).alias("n_fields"), F.max("payload.style.styleID").alias("style"))
    ids = fields.citation_id_stats(every.where("payload.citationItems is not null").select("doc_id", F.col("payload.citationID").alias("citation_id")), ["doc_id"])
    keys = fields.document_keys(every, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_item_keys"))
    texts = paragraphs_of(parsed).select("doc_id", "para", "text")
    groups = spans.extract_doi_groups(texts).select("doc_id", "para", F.lit(True).alias("group"), "dois").unionByName(spans.extract_loose_dois(texts).select("doc_id", "para", F.lit(False).alias("group"), F.array("doi").alias("dois")))
    placeholders = groups.groupBy("doc_id").agg(F.count_if("group").alias("n_groups"), F.count_if(~F.col("group")).alias("n_loose"), F.array_sort(F.collect_set("para")).alias("placeholder_paras"), F.size(F.array_distinct(F.flatten(F.collect_list("dois")))).alias("n_dois"))
    nested = nested_citations(every)
    base = parsed.select("doc_id", "d.begins", "d.ends", "d.structure_errors", F.col("d.body_paragraphs").alias("paragraphs"), "d.tables")
    for more in (kinds, ids, keys, placeholders, nested):
        base = base.join(more, "doc_id", "left")
    return base.na.fill(0)


def nested_citations(every: DataFrame) -> DataFrame:
    """(doc_id, n_nested): citations with a citation among the fields around them."""
    cites = every.where("kind = 'citation'").select("doc_id", "field_no", "around")
    inside = cites.select("doc_id", "field_no", F.explode("around").alias("outer")).join(cites.select("doc_id", F.col("field_no").alias("outer")), ["doc_id", "outer"], "left_semi")
    return inside.groupBy("doc_id").agg(F.countDistinct("field_no").alias("n_nested"))


def verify(converted: DataFrame, valid_keys: DataFrame, source: DataFrame | None = None, mapping: DataFrame | None = None, text_map: DataFrame | None = None) -> DataFrame:
    """One row for each document: counts of bad payloads, URIs and items, missed citations, and ok.

    With source and mapping the finder of convert() is run over the source, and every display it finds must be
    among the displays of the converted document as often.
    """
    parsed = parse_documents(converted)
    every = fields.with_payload(fields_of(parsed).where("closed"))
    cites = every.where("kind = 'citation'")
    bad = every.where("kind <> 'other'").groupBy("doc_id").agg(F.count_if(F.col("payload").isNull()).alias("bad_json"), F.count_if(F.col("kind") == "citation").alias("cites"))
    items = cites.where("payload is not null").select("doc_id", F.explode_outer("payload.citationItems").alias("i")).select("doc_id", F.get("i.uris", F.lit(0)).alias("uri"), *(F.col(f"i.itemData.{c}").alias(c) for c in ("type", "title", "author", "issued", "abstract")))
    counts = audit.verify_counters(audit.verify_items(items, valid_keys), ["doc_id"]).drop("ok")
    ids = fields.citation_id_stats(cites.select("doc_id", F.col("payload.citationID").alias("citation_id")), ["doc_id"]).select("doc_id", "n_duplicated")
    out = parsed.select("doc_id", "d.structure_errors").join(bad, "doc_id", "left").join(counts, "doc_id", "left").join(ids, "doc_id", "left").join(nested_citations(every), "doc_id", "left")
    if source is not None and mapping is not None:
        old = parse_documents(source)
        kept = fields.with_payload(fields_of(old).where("closed")).where("kind = 'citation'").select("doc_id", "display")
        expected = spans.find_citations(paragraphs_of(old).select("doc_id", "para", "text"), mapping, text_map).select("doc_id", "display").unionByName(kept)
        canonical = [F.col("doc_id"), T.canonical("display").alias("display")]
        missed = audit.multiset_difference(expected.select(*canonical), cites.select(*canonical)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("missed"))
        out = out.join(missed, "doc_id", "left")
    counted = [c for c in out.columns if c not in ("doc_id", "cites", "items", "with_abstract")]
    out = out.na.fill(0)
    ok = F.lit(True)
    for c in counted:
        ok = ok & (F.col(c) == 0)
    return out.withColumn("ok", ok)
