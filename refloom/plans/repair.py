"""Changing and reconciling the fields of Word documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions import text as T
from refloom.operators import audit, fields, spans
from refloom.plans.convert import _field, preferences
from refloom.sources.docx import fields_of, main_part, paragraphs_of, parse_documents, parse_tree, tag, with_main_part

REWRITTEN = "doc_id string, path string, content binary, changed long"


def citations_of(docs: DataFrame) -> DataFrame:
    """(doc_id, field_no, display, citation_id, instruction, payload) of closed citation fields with a payload."""
    every = fields.with_payload(fields_of(parse_documents(docs)).where("closed")).where("kind = 'citation' and payload is not null")
    return every.select("doc_id", "field_no", "display", F.col("payload.citationID").alias("citation_id"), "instruction", "payload")


def rewrite_instructions(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the instructions that changes (doc_id, field_no, new_instruction) names replaced; nested fields stay untouched."""

    def write(doc: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        wanted = dict(zip(new["field_no"].tolist(), new["new_instruction"], strict=True))

        def one(content):
            if not wanted:
                return content
            root = main_part(content)
            for f in parse_tree(root).fields:
                if f.number in wanted:
                    for k, element in enumerate(f.instruction):
                        text = wanted[f.number] if k == 0 else ""
                        if element.tag == tag("fldSimple"):
                            element.set(tag("instr"), text)
                        else:
                            element.text = text
            return with_main_part(content, root)

        return pd.DataFrame({"doc_id": doc["doc_id"], "path": doc["path"], "content": [one(c) for c in doc["content"]], "changed": [len(wanted)] * len(doc)})

    named = changes.select(F.col("doc_id").alias("of_doc"), "field_no", "new_instruction")
    return docs.select("doc_id", "path", "content").groupBy("doc_id").cogroup(named.groupBy("of_doc")).applyInPandas(write, REWRITTEN)


def new_displays(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """(doc_id, display) of citations that the original of a document, by the same doc_id, does not show."""
    old = fields_of(parse_documents(originals)).where("closed and display <> ''").select("doc_id", "display")
    return citations_of(docs).where("display <> ''").select("doc_id", "display").distinct().join(old, ["doc_id", "display"], "left_anti")


def renumber_documents(docs: DataFrame, selected: DataFrame | None = None, prefix: str = "new") -> DataFrame:
    """docs whose selected citations (doc_id, display; all if None) have ids of their own; an empty selection changes nothing."""
    cites = citations_of(docs)
    chosen = cites.select("doc_id", "display").distinct() if selected is None else selected
    out = fields.renumber(cites, chosen, ["doc_id"], ["field_no"], prefix).where("new_id <> citation_id or citation_id is null")
    quoted = F.concat(F.lit('"citationID": '), F.to_json(F.array("new_id")).substr(F.lit(2), F.length("new_id") + 2))
    renamed = F.expr(r"""regexp_replace(instruction, '"citationID"\\s*:\\s*"[^"]*"', replace(quoted, '$', '\\$'))""")
    changes = out.withColumn("quoted", quoted).select("doc_id", "field_no", renamed.alias("new_instruction"))
    return rewrite_instructions(docs, changes)


def relink_documents(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """docs whose citations name the new keys of replacements (old, new); changed counts fields."""
    cites = citations_of(docs)
    uris = cites.select("doc_id", "field_no", F.flatten(F.transform("payload.citationItems", lambda i: F.coalesce(i["uris"], F.array().cast("array<string>")))).alias("uris"))
    moved = fields.relink(uris, replacements, ["doc_id", "field_no"]).where("touched")
    pairs = moved.join(uris, ["doc_id", "field_no"]).join(cites.select("doc_id", "field_no", "instruction"), ["doc_id", "field_no"])
    both = F.arrays_zip(F.col("uris").alias("a"), F.col("new_uris").alias("b"))
    new = F.aggregate(both, F.col("instruction"), lambda text, p: F.replace(text, F.concat(F.lit('"'), p["a"], F.lit('"')), F.concat(F.lit('"'), p["b"], F.lit('"'))))
    return rewrite_instructions(docs, pairs.select("doc_id", "field_no", new.alias("new_instruction")))


def audit_documents(sources: DataFrame, outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, para, display, why) of every DOI group of the sources against the fields of the outputs with the same doc_id.

    mapping: (item_key, doi). An item's DOI is that of its data, else that of its key in the mapping.
    """
    keys = mapping.where("item_key is not null").select(T.normalize_doi("doi").alias("doi"), "item_key").distinct()
    groups = spans.extract_doi_groups(paragraphs_of(parse_documents(sources)).select("doc_id", "para", "text")).select("doc_id", "para", "start", "display", "dois")
    cites = citations_of(outputs)
    items = cites.select("doc_id", "field_no", F.posexplode("payload.citationItems").alias("_no", "i"))
    items = items.select("doc_id", "field_no", T.item_key(F.get("i.uris", F.lit(0))).alias("item_key"), T.normalize_doi("i.itemData.DOI").alias("own"))
    known = items.join(keys.withColumnRenamed("doi", "by_key"), "item_key", "left").select("doc_id", "field_no", "item_key", F.coalesce(F.nullif("own", F.lit("")), "by_key", F.lit("")).alias("doi"))
    each = known.groupBy("doc_id", "field_no").agg(F.collect_list("doi").alias("dois"), F.collect_list("item_key").alias("keys"))
    found = cites.join(each, ["doc_id", "field_no"]).select("doc_id", F.col("field_no").alias("seq"), "display", "dois", "keys", F.col("payload.properties.dontUpdate").alias("dont_update"))
    return audit.reconcile(groups, found, keys, ["para", "start"]).select("doc_id", "para", F.left("display", F.lit(80)).alias("display"), "why")


def cite_in_tables(docs: DataFrame, mapping: DataFrame, doi_column: int, number_column: int | None = None, prefix: str = "http://local/items/", style_id: str = T.STYLE_BASE + "apa") -> DataFrame:
    """docs whose first table cites, in number_column (else in doi_column itself), the item of each row's DOI.

    mapping: (ref_key, ord, item_key, uri, csl, doi). The header row, short rows, unknown DOIs and cells that hold a
    citation already are left alone.
    """
    target = doi_column if number_column is None else number_column
    parsed = parse_documents(docs)
    cells = parsed.select("doc_id", F.explode("d.cells").alias("c")).select("doc_id", "c.*").where("table_no = 0 and row > 0")
    wide = cells.groupBy("doc_id", "row").agg(F.max(F.when(F.col("col") == doi_column, F.col("text"))).alias("doi_text"), F.max(F.when(F.col("col") == target, F.col("text"))).alias("display"), F.max(F.when(F.col("col") == target, F.col("has_field"))).alias("taken"))
    wanted = wide.where("display is not null and not taken").withColumn("norm", T.normalize_doi("doi_text"))
    index = spans.doi_index(mapping).withColumnRenamed("doi", "norm")
    rows = wanted.join(index, "norm").join(mapping.select("ref_key", "item_key", "uri", "csl"), "ref_key")
    used = fields.with_payload(fields_of(parsed).where("closed")).select("doc_id", F.col("payload.citationID").alias("citation_id"))
    rows = rows.join(fields.next_id(used, ["doc_id"], "tcit"), "doc_id", "left").join(fields.first_use_id(rows, ["doc_id"], "ref_key", ["row"]), ["doc_id", "ref_key"])
    number = F.coalesce("next_id", F.lit(0)) + F.row_number().over(W.partitionBy("doc_id").orderBy("row")) - 1
    rows = rows.select(F.col("doc_id").alias("of_doc"), "row", T.strip("display").alias("display"), F.concat(F.lit("tcit"), number.cast("string")).alias("citation_id"), "item_id", T.item_uri("item_key", "uri", None, prefix).alias("uri"), "csl")
    prefs = preferences(style_id)

    def write(doc: pd.DataFrame, cites: pd.DataFrame) -> pd.DataFrame:
        from refloom.plans.convert import SCHEMA

        def one(content):
            root = main_part(content)
            instructions = "".join(f.text for f in parse_tree(root).fields if f.closed)
            table = next(root.iter(tag("tbl")), None)
            lines = table.findall(tag("tr")) if table is not None else []
            for r in cites.itertuples():
                para = lines[r.row].findall(tag("tc"))[target].find(tag("p"))
                runs = para.findall(tag("r"))
                payload = {
                    "citationID": r.citation_id, "properties": {"formattedCitation": r.display, "plainCitation": r.display, "dontUpdate": False, "noteIndex": 0},
                    "citationItems": [{"id": int(r.item_id), "uris": [r.uri], "itemData": {k: v for k, v in json.loads(r.csl).items() if k != "abstract"} | {"id": int(r.item_id)}}], "schema": SCHEMA,
                }
                made = _field(f"{fields.CITATION_MARK} {json.dumps(payload, ensure_ascii=False)}", r.display, runs[0].find(tag("rPr")) if runs else None)
                para[:] = [c for c in para if c.tag != tag("r")] + made
            if fields.PREFERENCES_MARK not in instructions:
                body, hidden = root.find(tag("body")), root.makeelement(tag("p"), {})
                hidden.extend(_field(f"{fields.PREFERENCES_MARK} {prefs}", "", None))
                body.insert(0, hidden)
            return with_main_part(content, root)

        return pd.DataFrame({"doc_id": doc["doc_id"], "path": doc["path"], "content": [one(c) for c in doc["content"]], "changed": [len(cites)] * len(doc)})

    return docs.select("doc_id", "path", "content").groupBy("doc_id").cogroup(rows.groupBy("of_doc")).applyInPandas(write, REWRITTEN)
