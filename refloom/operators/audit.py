"""Auditing documents: reconciliation, verification and column reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions import text as T


def multiset_difference(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Rows of expected that produced does not have as often."""
    return expected.exceptAll(produced)


def reconcile(groups: DataFrame, citations: DataFrame, mapping: DataFrame, order: list[str]) -> DataFrame:
    """groups (doc_id, *order, display, dois) with why: null if matched, else the first reason that holds.

    citations: (doc_id, seq, display, dois, keys, dont_update). Each citation is used up by one group with its
    display, in order. mapping: (doi, item_key) with normalised DOIs.
    """
    ours = groups.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "display").orderBy(*order)))
    theirs = citations.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "display").orderBy("seq")))
    theirs = theirs.select("doc_id", "display", "_n", F.col("dois").alias("_dois"), F.col("keys").alias("_keys"), "dont_update", F.lit(True).alias("_there"))
    # keys are looked up once for equal DOIs of a document, not for each group
    asked = groups.select("doc_id", "dois").distinct().select("doc_id", "dois", F.explode("dois").alias("doi"))
    wanted = asked.join(mapping.select("doi", "item_key"), "doi").groupBy("doc_id", "dois").agg(F.array_sort(F.collect_set("item_key")).alias("_wanted"))
    both = ours.join(theirs, ["doc_id", "display", "_n"], "left").join(wanted, ["doc_id", "dois"], "left")
    both = both.withColumn("_wanted", F.coalesce("_wanted", F.array().cast("array<string>")))
    why = (
        F.when(F.col("_there").isNull(), "no field").when(F.array_sort(F.array_distinct("dois")) != F.array_sort(F.array_distinct("_dois")), "dois differ")
        .when(F.array_sort(F.array_distinct("_keys")) != F.col("_wanted"), "uri differs").when(~(F.col("dont_update").eqNullSafe(F.lit(False))), "dontUpdate is not false")
    )
    return both.select("doc_id", *order, "display", why.alias("why"))


def reconciliation_totals(problems: DataFrame) -> DataFrame:
    return problems.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("why is null")).alias("matched"), F.count_if(F.expr("why is not null")).alias("problems"))


def verify_items(items: DataFrame, valid_keys: DataFrame) -> DataFrame:
    """items (…, uri, type, title, author, issued, abstract) with bad_uri, incomplete and with_abstract."""
    valid = valid_keys.select(F.col("item_key").alias("_key"), F.lit(True).alias("_valid")).distinct()
    rows = items.withColumn("_key", T.item_key("uri")).join(valid, "_key", "left")
    bad = F.col("uri").isNull() | ~F.col("uri").contains("/items/") | F.col("uri").contains("<") | F.col("_valid").isNull()
    incomplete = F.col("type").isNull() | F.col("title").isNull() | F.col("author").isNull() | F.col("issued").isNull()
    return rows.withColumns({"bad_uri": bad, "incomplete": incomplete, "with_abstract": ~incomplete & F.col("abstract").isNotNull()}).drop("_key", "_valid")


def verify_counters(checked: DataFrame, partition: list[str]) -> DataFrame:
    counts = checked.groupBy(*partition).agg(F.count(F.lit(1)).alias("items"), F.count_if("bad_uri").alias("bad_uri"), F.count_if("incomplete").alias("incomplete"), F.count_if("with_abstract").alias("with_abstract"))
    return counts.withColumn("ok", (F.col("bad_uri") == 0) & (F.col("incomplete") == 0))


def column_audit(cells: DataFrame, partition: list[str], samples: int = 0) -> DataFrame:
    """Counts of what the cells (partition, text, has_field) of each column hold; with samples, that many of each kind by row."""
    kinds = cells.withColumn("kind", T.cell_kind("text", "has_field"))
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("field", "with_field"), ("doi", "doi_cells"), ("number", "number_cells"), ("citation", "citation_cells"))]
    if samples:
        kept = {"doi": 60, "number": 30, "citation": 40}
        counts += [F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("row", F.left(T.strip("text"), F.lit(n)).alias("text"))))), 1, samples).alias(f"{k}_samples") for k, n in kept.items()]
    return kinds.groupBy(*partition).agg(F.count(F.lit(1)).alias("cells"), *counts)
