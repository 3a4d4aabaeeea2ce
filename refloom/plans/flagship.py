"""The flagship query: from raw references to reconciled citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import refs as R
from refloom.functions import text as T
from refloom.operators import audit, library, spans
from refloom.plans.corpus import bodies, references


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(why, citations): how the DOI citations of each body text fare; a null reason means that they match.

    References are parsed, the library is indexed by DOI, every DOI group in the texts is matched to it all or
    nothing, and the groups are reconciled with the fields that the matches make.
    """
    corpus = bodies(references(spark, sf_dir))
    parsed = corpus.withColumn("p", R.parse_reference("raw_text"))
    items = parsed.where(F.col("supp") % 5 != 0).select(F.col("raw_text").alias("key"), F.col("p.title").alias("title"), F.col("p.doi").alias("doi"), F.lit(None).cast("string").alias("error"))
    twos = parsed.select(F.col("doi2").alias("key"), F.lit("second").alias("title"), F.col("doi2").alias("doi"), F.lit(None).cast("string").alias("error")).distinct()
    index, _, _ = library.library_index(items.unionByName(twos))
    mapping = index.select(F.col("itemKey").alias("ref_key"), F.lit(0).alias("ord"), F.col("doi_norm").alias("doi"), F.lit("").alias("first_author"), F.lit("").alias("year"), F.lit(False).alias("is_nih"))
    texts = parsed.select(F.struct("ref_no", "ln", "part", "supp").alias("doc_id"), F.lit(0).alias("para"), F.col("body").alias("text")).distinct()
    groups = spans.extract_doi_groups(texts).select("doc_id", "para", "start", "display", "dois")
    found = spans.find_citations(texts, mapping)
    each = found.select("doc_id", "para", "start", "display", F.posexplode("keys").alias("no", "ref_key")).join(mapping.select("ref_key", "doi"), "ref_key")
    cites = each.groupBy("doc_id", "para", "start", "display").agg(F.collect_list("doi").alias("dois"), F.collect_list("ref_key").alias("keys"))
    cites = cites.select("doc_id", F.struct("para", "start").alias("seq"), "display", "dois", "keys", F.lit(False).alias("dont_update"))
    keys = mapping.select(T.normalize_doi("doi").alias("doi"), F.col("ref_key").alias("item_key"))
    return audit.reconcile(groups, cites, keys, ["para", "start"]).groupBy("why").agg(F.count(F.lit(1)).alias("citations"))
