"""From text references to a mapping of reference keys to library items.

Planning and writing are apart: plan() is a DataFrame that a person can look at, and only a connector's import
writes to the library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import metadata as M
from refloom.functions import text as T
from refloom.operators import library, refs, resolve
from refloom.operators.fields import document_keys


@dataclass
class Ingest:
    """Frames of one run; each is lazy."""

    references: DataFrame  # (doc_id, para, ref_key, parsed)
    resolved: DataFrame  # (ref_key, provider, csl, confidence, level, candidates, resolve_error)
    duplicates: DataFrame  # (ref_key, status, item_key)
    plan: DataFrame  # (ref_key, action, outcome, target_key)
    statistics: DataFrame  # one row


def plan(paragraphs: DataFrame, stages: list[DataFrame], items: DataFrame, detect: bool = True) -> Ingest:
    """Parse, resolve, look for duplicates and plan the import of everything that was resolved.

    paragraphs: (doc_id, para, text); stages: candidates (ref_key, provider, csl, rank) of each provider, best first;
    items: (key, ord, title, doi). What is known already is reused by the plan itself, so a run after a broken one
    creates nothing twice.
    """
    found = refs.extract_references(paragraphs, ["doc_id"], detect=detect)
    resolved = resolve.resolve_staged(found.select("ref_key", "parsed"), stages)
    records = resolved.where("csl is not null").select("ref_key", F.col("csl.title").alias("title"), F.col("csl.DOI").alias("doi"))
    duplicates = library.dedup_check(records, items)
    wanted = records.select("ref_key", F.lit("import").alias("action"), "title", "doi", F.lit(None).cast("string").alias("item_key"))
    planned = library.plan_imports(wanted, items)
    return Ingest(found, resolved, duplicates, planned, resolve.statistics(resolved, duplicates, planned))


def creations(ingest: Ingest) -> DataFrame:
    """(ref_key, item_type, fields, creators) of what the plan creates, as the library takes it; creators are null where there are none."""
    new = ingest.plan.where("outcome = 'create'").select("ref_key").join(ingest.resolved.select("ref_key", "csl"), "ref_key")
    creators = M.library_creators("csl")
    return new.select("ref_key", M.library_type("csl.type").alias("item_type"), M.library_fields("csl").alias("fields"), F.when(F.size(creators) > 0, creators).alias("creators"))


def imported(ingest: Ingest, created: DataFrame, prefix: str) -> DataFrame:
    """The mapping after the connector has created items: (ref_key, itemKey, uri, csl, doi, first_author, year); created: (ref_key, item_key)."""
    reused = ingest.plan.where("target_key is not null").select("ref_key", F.col("target_key").alias("item_key"))
    both = reused.unionByName(created).join(ingest.resolved.select("ref_key", "csl"), "ref_key")
    return library.build_mapping(both.withColumn("uri", F.lit(None).cast("string")), prefix)


def create_items(rows: DataFrame, make_call: Callable[[], Callable]) -> DataFrame:
    """Write the rows of creations() through a connector, on one partition: (ref_key, item_key), null where the library gave no key.

    Right before a record with a DOI is written the library is asked for that DOI, so a task that runs again after
    a failure finds what it has created and creates nothing twice.
    """
    import json

    import pandas as pd

    from refloom.functions.text import plain_doi
    from refloom.sources.rpc import WRITE, items_with_doi, new_item_key

    def run(batches):
        call = make_call()
        for b in batches:
            keys = []
            for r in b.itertuples():
                fields = json.loads(r.fields)
                there = items_with_doi(call, fields["DOI"], lambda a, b: plain_doi(a) == plain_doi(b)) if fields.get("DOI") else []
                record = {"action": "create", "itemType": r.item_type, "fields": fields} | ({"creators": json.loads(r.creators)} if r.creators else {})
                keys.append(there[0]["key"] if there else new_item_key(call(WRITE, record)))
            yield pd.DataFrame({"ref_key": b["ref_key"], "item_key": keys})

    flat = rows.select("ref_key", "item_type", F.to_json("fields").alias("fields"), F.to_json("creators").alias("creators"))
    return flat.coalesce(1).mapInPandas(run, "ref_key string, item_key string")


def add_to_collection(created: DataFrame, collection: str, make_call: Callable[[], Callable]) -> DataFrame:
    """Put created items (item_key) into a collection, some hundred in a call, on one partition; (item_key) of those put there. Doing it again changes nothing."""
    import pandas as pd

    from refloom.sources.rpc import add_to_collection as add

    def run(batches):
        call = make_call()
        for b in batches:
            yield pd.DataFrame({"item_key": add(call, collection, b["item_key"])})

    return created.where("item_key is not null").select("item_key").distinct().coalesce(1).mapInPandas(run, "item_key string")


def collection_items(spark, collections: list[str], make_call: Callable[[], Callable]) -> DataFrame:
    """(key, ord, title, doi, error) of the items in collections, read through a connector on one partition; what cannot be read has an error."""
    import pandas as pd

    from refloom.sources.rpc import RpcError, collection_keys, item_details

    def run(batches):
        call = make_call()
        for b in batches:
            for collection in b["collection"]:
                rows = []
                for key in collection_keys(call, collection):
                    try:
                        found = item_details(call, key)
                        rows.append((key, found.get("title"), found.get("DOI"), None))
                    except RpcError as e:
                        rows.append((key, None, None, str(e)))
                yield pd.DataFrame({"key": [r[0] for r in rows], "ord": range(len(rows)), "title": [r[1] for r in rows], "doi": [r[2] for r in rows], "error": [r[3] for r in rows]})

    wanted = spark.createDataFrame([(c,) for c in collections], "collection string")
    return wanted.coalesce(1).mapInPandas(run, "key string, ord long, title string, doi string, error string")


def document_index(fields: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """library_index() of the items that a document's citations name; keys without an item are failures."""
    keys = document_keys(fields, ["doc_id"]).select(F.col("item_key").alias("key")).distinct()
    named = keys.join(items.withColumn("there", F.lit(True)), "key", "left").withColumn("error", F.coalesce("error", F.when(F.col("there").isNull(), "not in the library")))
    return library.library_index(named)


def summarised(ingest: Ingest) -> DataFrame:
    return resolve.summary(ingest.resolved)


def hits_after_import(mapping: DataFrame, items: DataFrame) -> DataFrame:
    """Library items with each mapping row's DOI, several of which are duplicates to merge by hand."""
    return library.doi_hits(mapping.select("ref_key", "doi"), items).withColumn("duplicated", F.col("hits") > 1)


def confidence_levels(ingest: Ingest) -> DataFrame:
    return ingest.resolved.groupBy(T.confidence_level("confidence").alias("level")).agg(F.count(F.lit(1)).alias("n"))
