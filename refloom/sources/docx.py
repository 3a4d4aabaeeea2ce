"""Word documents as a source and a sink.

A document is a row (doc_id, content). Its main part is read once, in one pass without recursion, into a table
of tokens in document order; fields, their depth, what they protect and what is malformed are derived from that
table. Fields run on across paragraphs, and a text box is a story of its own.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections import defaultdict
from dataclasses import dataclass, field
from typing import NamedTuple
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.arrow import arrow

# The names of the format.
NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
MAIN_PART = "word/document.xml"


def tag(name: str) -> str:
    return f"{{{NS}}}{name}"


_KINDS = {tag("fldSimple"): "simple", tag("fldChar"): "mark", tag("instrText"): "instruction", tag("t"): "text"}
_PARAGRAPH, _STORY, _SIMPLE = tag("p"), tag("txbxContent"), tag("fldSimple")
_SCOPES = {_PARAGRAPH, _STORY, _SIMPLE}


class Token(NamedTuple):
    """An element, or the close of a simple field, with its story and the paragraph it lies in (-1: none)."""

    kind: str  # begin, separate, end, unknown (marks); simple, close; instruction, text; other
    story: int
    para: int
    element: ET.Element


def tokens_of(root) -> tuple[list[Token], list]:
    """(tokens, paragraphs) of a tree, in document order."""
    tokens, paragraphs, stories, paras, n_stories = [], [], [0], [-1], 1
    todo = [(root, False)]
    while todo:
        element, leaving = todo.pop()
        if leaving:
            if element.tag == _SIMPLE:
                tokens.append(Token("close", stories[-1], paras[-1], element))
            elif element.tag == _PARAGRAPH:
                paras.pop()
            else:
                stories.pop()
            continue
        if element.tag == _STORY:
            stories.append(n_stories)
            n_stories += 1
        elif element.tag == _PARAGRAPH:
            paras.append(len(paragraphs))
            paragraphs.append(element)
        kind = _KINDS.get(element.tag, "other")
        if kind == "mark":
            marked = element.get(tag("fldCharType"))
            kind = marked if marked in ("begin", "separate", "end") else "unknown"
        tokens.append(Token(kind, stories[-1], paras[-1], element))
        if element.tag in _SCOPES:
            todo.append((element, True))
        todo += [(child, False) for child in reversed(element)]
    return tokens, paragraphs


@dataclass(eq=False)
class Field:
    """A field in the order of its beginning; opener is the element that begins it."""

    number: int
    para: int
    opener: ET.Element
    parent: Field | None
    shows: bool  # has its result begun
    instruction: list = field(default_factory=list)  # XML elements that hold it
    display: list[str] = field(default_factory=list)
    closed: bool = False

    @property
    def simple(self) -> bool:
        return self.opener.tag == _SIMPLE

    @property
    def around(self) -> list[Field]:
        """The fields it lies in, outermost first."""
        return [*self.parent.around, self.parent] if self.parent else []

    @property
    def text(self) -> str:
        return "".join(e.get(tag("instr"), "") if e.tag == _SIMPLE else e.text or "" for e in self.instruction)


@dataclass
class Parsed:
    """What a document's tokens tell."""

    paragraphs: list
    fields: list[Field] = field(default_factory=list)
    outside: dict[int, list[str]] = field(default_factory=lambda: defaultdict(list))
    protected: set[int] = field(default_factory=set)  # ids of elements that are part of a field
    marks: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    errors: int = 0

    @property
    def begins(self) -> int:
        return self.marks["begin"]

    @property
    def ends(self) -> int:
        return self.marks["end"]


def _story_fields(tokens: list[tuple[int, Token]], out: Parsed) -> list[tuple[int, Field]]:
    """The fields of one story, each with its token's place. inner is the innermost open field; its parents are the others."""
    found: list[tuple[int, Field]] = []
    inner: Field | None = None
    for place, (kind, _, para, element) in tokens:
        out.marks[kind] += 1
        if kind == "close":
            while inner and inner.opener is not element:
                out.errors, inner = out.errors + 1, inner.parent
            if inner:
                inner.closed, inner = True, inner.parent
            continue
        if inner or kind in ("simple", "begin", "separate", "end", "unknown"):
            out.protected.add(id(element))
        if kind in ("simple", "begin"):
            inner = Field(0, para, element, inner, kind == "simple", [element] if kind == "simple" else [])
            found.append((place, inner))
        elif kind == "end" and inner and not inner.simple:
            inner.closed, inner = True, inner.parent
        elif kind == "separate" and inner and not inner.shows:
            inner.shows = True
        elif kind in ("end", "separate", "unknown"):
            out.errors += 1
        elif kind == "instruction" and inner and not inner.shows:
            inner.instruction.append(element)
        elif kind == "text" and inner:
            reader = inner  # a result is seen in all fields around it, up to one that is still being told what it is
            while reader and reader.shows:
                reader.display.append(element.text or "")
                reader = reader.parent
        elif kind == "text" and para >= 0:
            out.outside[para].append(element.text or "")
    while inner:
        out.errors, inner = out.errors + 1, inner.parent
    return found


def parse_tree(root) -> Parsed:
    tokens, paragraphs = tokens_of(root)
    out, stories = Parsed(paragraphs), defaultdict(list)
    for place, token in enumerate(tokens):
        stories[token.story].append((place, token))
    found = [f for story in stories.values() for f in _story_fields(story, out)]
    out.fields = [f for _, f in sorted(found, key=lambda x: x[0])]
    for number, f in enumerate(out.fields):
        f.number = number
    return out


def main_part(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ET.fromstring(z.read(MAIN_PART))


FIELDS = "array<struct<field_no:int,para:int,around:array<int>,instruction:string,display:string,closed:boolean>>"
PARAGRAPHS = "array<struct<para:int,body_para:int,in_cell:boolean,text:string>>"
CELLS = "array<struct<table_no:int,row:int,col:int,text:string,has_field:boolean>>"
DOCUMENT = f"struct<fields:{FIELDS},paragraphs:{PARAGRAPHS},cells:{CELLS},begins:int,ends:int,structure_errors:int,body_paragraphs:int,tables:int>"


def describe(content: bytes) -> dict:
    """One document as nested rows."""
    root = main_part(content)
    parsed, body = parse_tree(root), root.find(tag("body"))
    body_no = {id(p): i for i, p in enumerate(body.findall(tag("p")))}
    in_cell = {id(p) for c in body.iter(tag("tc")) for p in c.iter(tag("p"))}
    number = {id(p): i for i, p in enumerate(parsed.paragraphs)}
    outside = ["".join(parsed.outside[i]) for i in range(len(parsed.paragraphs))]
    tables = body.findall(tag("tbl"))
    cells = [
        {"table_no": t, "row": r, "col": c, "text": "".join(outside[number[id(p)]] for p in cell.iter(tag("p"))), "has_field": any(id(e) in parsed.protected for e in cell.iter())}
        for t, tbl in enumerate(tables) for r, tr in enumerate(tbl.findall(tag("tr"))) for c, cell in enumerate(tr.findall(tag("tc")))
    ]
    return {
        "fields": [{"field_no": f.number, "para": f.para, "around": [a.number for a in f.around], "instruction": f.text, "display": "".join(f.display), "closed": f.closed} for f in parsed.fields],
        "paragraphs": [{"para": i, "body_para": body_no.get(id(p)), "in_cell": id(p) in in_cell, "text": outside[i]} for i, p in enumerate(parsed.paragraphs)],
        "cells": cells, "begins": parsed.begins, "ends": parsed.ends, "structure_errors": parsed.errors, "body_paragraphs": len(body_no), "tables": len(tables),
    }


@arrow(DOCUMENT)
def parsed_document(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(c) for c in contents], columns=["fields", "paragraphs", "cells", "begins", "ends", "structure_errors", "body_paragraphs", "tables"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the documents at a path; doc_id is the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "path", "content")


def parse_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, d) with d a struct of DOCUMENT; cache it where several readers share it."""
    return docs.select("doc_id", parsed_document("content").alias("d"))


def fields_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("d.fields").alias("f")).select("doc_id", "f.*")


def paragraphs_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, para, body_para, in_cell, text): text outside fields. para counts all paragraphs, body_para those of the body alone."""
    return parsed.select("doc_id", F.explode("d.paragraphs").alias("p")).select("doc_id", "p.*")


def cells_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("d.cells").alias("c")).select("doc_id", "c.*")


# ------------------------------------------------------------------ sink


def with_main_part(content: bytes, root) -> bytes:
    """The archive with another main part; all other members stay. Namespaces keep their prefixes, used or not."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        old = z.read(MAIN_PART)
        declared = [ns for _, ns in ET.iterparse(io.BytesIO(old), events=("start-ns",))]
        for prefix, uri in declared:
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        xml = ET.tostring(root, encoding="unicode")
        head = xml[: xml.index(">")]
        missing = "".join(f' xmlns:{p}="{u}"' for p, u in dict(declared).items() if p and f"xmlns:{p}=" not in head)
        at = re.match(r"<[^\s>/]+", xml).end()
        xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + xml[:at] + missing + xml[at:]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            new.comment = z.comment
            for item in z.infolist():
                new.writestr(item, xml.encode("utf-8") if item.filename == MAIN_PART else z.read(item.filename))
        return out.getvalue()


def save_document(content: bytes, path: str) -> None:
    """Write beside the target, then rename: a failure leaves the target as it was."""
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def save_documents(docs: DataFrame, folder: str) -> None:
    """Write docs (path, content) into a folder that all executors share, one file each, under their paths below the folder that all of them lie in."""
    ends = docs.agg(F.min("path").alias("low"), F.max("path").alias("high")).first()
    if ends.low is None:
        return
    base = os.path.dirname(os.path.commonprefix([ends.low, ends.high]))

    def write(rows) -> None:
        for row in rows:
            path = os.path.join(folder, row.path[len(base) :].lstrip("/"))
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            save_document(bytes(row.content), path)

    docs.select("path", "content").foreachPartition(write)
