"""Word fields, runs and citation ids as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions.text import item_key, payload_text

# The markers by which field instructions are told apart.
CITATION_MARK = "ZOTERO_ITEM CSL_CITATION"
BIBLIOGRAPHY_MARK = "ZOTERO_BIBL"
PREFERENCES_MARK = "ZOTERO_DOCUMENT_PREFERENCES"

PAYLOAD = (
    "struct<citationID:string,properties:struct<formattedCitation:string,plainCitation:string,dontUpdate:boolean,noteIndex:int>,"
    "citationItems:array<struct<id:int,uris:array<string>,itemData:struct<type:string,title:string,DOI:string,author:string,issued:string,abstract:string>>>,style:struct<styleID:string>>"
)


def field_depth(markers: DataFrame, partition: list[str], order: str, step: str) -> DataFrame:
    """markers with depth: the running sum of step (+1 begin, -1 end), where an end without a begin counts nothing."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = markers.withColumn("_sum", F.sum(step).over(w))
    return rows.withColumn("depth", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).cast("long")).drop("_sum")


def matched_fields(markers: DataFrame, partition: list[str], order: str, step: str) -> DataFrame:
    """(partition, start, end) of every begin with its end: the next end at the same depth; open fields have a null end."""
    deep = field_depth(markers, partition, order, step).withColumn("_level", F.when(F.col(step) > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    w = W.partitionBy(*partition, "_level").orderBy(order).rowsBetween(1, W.unboundedFollowing)
    ends = F.first(F.when(F.col(step) < 0, F.col(order)), ignorenulls=True).over(w)
    return deep.withColumn("end", ends).where(F.col(step) > 0).select(*partition, F.col(order).alias("start"), "end", F.col("depth").alias("level"))


def nested_count(fields: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, nested): fields that lie inside another field, by a running maximum of the ends before them."""
    w = W.partitionBy(*partition).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = F.col("start") < F.max("end").over(w)
    return fields.where("end is not null").withColumn("_in", inside).groupBy(*partition).agg(F.count_if("_in").alias("nested"))


def field_kind(instruction) -> Column:
    i = F.col(instruction) if isinstance(instruction, str) else instruction
    return F.when(i.contains(CITATION_MARK), "citation").when(i.contains(BIBLIOGRAPHY_MARK), "bibliography").when(i.contains(PREFERENCES_MARK), "preferences").otherwise("other")


def with_payload(fields: DataFrame, instruction: str = "instruction") -> DataFrame:
    """fields with payload, a struct or null, and kind."""
    return fields.withColumns({"payload": F.from_json(payload_text(instruction), PAYLOAD), "kind": field_kind(instruction)})


def run_offsets(runs: DataFrame, partition: list[str], order: str, text: str) -> DataFrame:
    """runs with start and end, half open, in the concatenation of their texts."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)).cast("long")
    return runs.withColumn("start", start).withColumn("end", (F.col("start") + F.length(text)).cast("long"))


def slice_runs(runs: DataFrame, low, high, text: str) -> DataFrame:
    """The part of each run inside low to high; runs outside are dropped, kept ones have the text between."""
    a, b = F.greatest("start", low), F.least("end", high)
    return runs.where((F.col("end") > low) & (F.col("start") < high) & (b > a)).withColumn("sliced", F.substring(F.col(text), (a - F.col("start") + 1).cast("int"), (b - a).cast("int")))


def id_number(citation_id, prefix: str) -> Column:
    """The number of an id that is the prefix and digits alone, else null."""
    return F.nullif(F.regexp_extract(citation_id, "^" + prefix + r"(\d+)$", 1), F.lit("")).cast("long")


def citation_id_stats(ids: DataFrame, partition: list[str], column: str = "citation_id") -> DataFrame:
    """(partition, n, n_unique, n_duplicated, max_numeric) of non-empty ids; max_numeric is -1 without any citN."""
    each = ids.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*partition, column).agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(*partition).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.expr("c > 1")).alias("n_duplicated"), F.coalesce(F.max(id_number(column, "cit")), F.lit(-1)).alias("max_numeric"))


def duplicate_ids(ids: DataFrame, partition: list[str], column: str = "citation_id") -> DataFrame:
    return ids.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*partition, column).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def next_id(ids: DataFrame, partition: list[str], prefix: str = "cit", column: str = "citation_id") -> DataFrame:
    return ids.groupBy(*partition).agg((F.coalesce(F.max(id_number(column, prefix)), F.lit(-1)) + 1).alias("next_id"))


def renumber(citations: DataFrame, selected: DataFrame, partition: list[str], order: list[str], prefix: str, column: str = "citation_id") -> DataFrame:
    """citations with new_id: those whose display is among selected (partition, display) get prefix and a number after the largest in use, in order; others keep theirs."""
    start = next_id(citations, partition, prefix, column)
    hit = selected.select(*partition, "display").distinct().withColumn("_hit", F.lit(1))
    rows = citations.join(hit, [*partition, "display"], "left").join(start, partition)
    n = F.sum(F.coalesce("_hit", F.lit(0))).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    new = F.when(F.col("_hit") == 1, F.concat(F.lit(prefix), (F.col("next_id") + n - 1).cast("string"))).otherwise(F.col(column))
    return rows.withColumn("new_id", new).drop("_hit", "next_id")


def first_use_id(uses: DataFrame, partition: list[str], key: str, order: list[str]) -> DataFrame:
    """(partition, key, item_id): keys numbered from 1 by where they are first used."""
    first = uses.groupBy(*partition, key).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("item_id", F.row_number().over(W.partitionBy(*partition).orderBy("_first", key))).drop("_first")


def relink(citations: DataFrame, replacements: DataFrame, key: list[str]) -> DataFrame:
    """citations (*key, uris) with new_uris and touched, by replacements (old, new); a replacement table of any size is joined."""
    each = citations.select(*key, F.posexplode("uris").alias("_no", "_uri"))
    joined = each.withColumn("old", item_key("_uri")).join(replacements, "old", "left")
    moved = F.when(F.col("new").isNotNull(), F.concat(F.left("_uri", F.length("_uri") - F.length("old")), F.col("new"))).otherwise(F.col("_uri"))
    new = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_no", moved.alias("uri")))).alias("u"), F.max(F.col("new").isNotNull()).alias("touched"))
    return new.select(*key, F.transform("u", lambda x: x["uri"]).alias("new_uris"), "touched")


def document_keys(citations: DataFrame, partition: list[str]) -> DataFrame:
    """Distinct (partition, item_key) over the payloads' URIs."""
    uris = citations.where("payload.citationItems is not null").select(*partition, F.explode(F.flatten(F.transform("payload.citationItems", lambda i: F.coalesce(i["uris"], F.array().cast("array<string>"))))).alias("uri"))
    return uris.select(*partition, item_key("uri").alias("item_key")).distinct()
