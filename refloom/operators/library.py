"""The item library as DataFrames: indexes, duplicates, import plans, mappings."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import metadata as M
from refloom.functions import text as T
from refloom.functions.arrow import arrow

ACTIONS = ("import", "reuse", "skip")


def library_index(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, failures, duplicates) of items (key, title, doi, error, …).

    index has one row for each DOI, from the first key in order; items without a DOI are left out silently,
    unreadable ones (an error, or no title) are reported as failures, and DOIs with several keys as duplicates.
    """
    bad = F.col("error").isNotNull() | (F.coalesce("title", F.lit("")) == "")
    failures = items.where(bad).select("key", F.coalesce("error", F.lit("missing title")).alias("error"))
    good = items.where(~bad).withColumn("norm", T.normalize_doi("doi")).where("norm != ''")
    index = good.groupBy("norm").agg(F.min_by(F.struct("key", "doi", "title"), "key").alias("i"), F.array_sort(F.collect_set("key")).alias("keys"))
    return index.select(F.col("norm").alias("doi_norm"), F.col("i.key").alias("itemKey"), "i.doi", "i.title"), failures, index.where(F.size("keys") > 1).select(F.col("norm").alias("doi_norm"), "keys")


def verify_item_keys(keys: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, missing) of keys (item_key): those with a readable library item, and the others."""
    alive = items.where(F.col("error").isNull() & (F.coalesce("title", F.lit("")) != "")).select(F.col("key").alias("item_key")).distinct()
    wanted = keys.select("item_key").distinct()
    return wanted.join(alive, "item_key", "left_semi"), wanted.join(alive, "item_key", "left_anti")


# Containment is blocked by shared minimisers: of any LEAST normalised characters in a row, both sides keep the same gram.
GRAM, SPAN = 12, 20
LEAST = GRAM + SPAN - 1


@arrow("array<long>")
def minimizers(titles: pd.Series) -> pd.Series:
    """Hashes of the smallest of every SPAN consecutive grams of a text; none for texts shorter than LEAST."""
    import numpy as np

    def pick(t):
        if not t or len(t) < LEAST:
            return []
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
        h = np.zeros(len(codes) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = (h ^ codes[k : len(codes) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return np.unique(np.lib.stride_tricks.sliding_window_view(h, SPAN).min(axis=1)).view(np.int64).tolist()

    return titles.map(pick)


#: Lengths of the beginnings that titles shorter than LEAST are met by: each has the longest that fits.
BEGINNINGS = (1, 2, 4, 8, 16)


def _grams(titles: DataFrame) -> DataFrame:
    """(id, g), each once; what counts, asks and is asked reads the one exchange this ends in."""
    return titles.select("id", F.explode(minimizers("norm")).alias("g")).distinct()


def _may_hold(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) ids, by grams (id, g) of either: a text can hold only texts whose grams it has all, so each is met by its rarest one."""
    uses = outer.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = inner.join(uses, "g", "left").groupBy("id").agg(F.min_by("g", n).alias("g"), F.min(n).alias("n")).where("n > 0")
    return rarest.select(F.col("id").alias("inner"), "g").join(outer.withColumnRenamed("id", "outer"), "g").select("inner", "outer")


def _short_may_be_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) ids, by the beginnings of inner's titles shorter than LEAST; titles (id, norm)."""
    size = F.greatest(*(F.when(F.length("norm") >= n, n) for n in BEGINNINGS))
    short = inner.where(F.length("norm") < LEAST).select(F.col("id").alias("inner"), size.alias("n"), "norm").withColumn("part", F.expr("left(norm, n)")).drop("norm")
    sizes = F.broadcast(short.agg(F.collect_set("n").alias("sizes")))  # one row of at most len(BEGINNINGS) numbers
    letters = outer.crossJoin(sizes).where(F.size("sizes") > 0).select(F.col("id").alias("outer"), F.split("norm", "").alias("c"), F.explode("sizes").alias("n")).where(F.size("c") >= F.col("n"))
    places = F.sequence(F.lit(1), F.size("c") - F.col("n") + 1)
    parts = letters.select("outer", "n", F.explode(F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("c", i, F.col("n")), "")))).alias("part"))
    return short.join(parts, ["n", "part"]).select("inner", "outer")


def contained_pairs(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """(ref, item) ids where one normalised title contains the other; (id, norm) on either side, an id always with the same norm.

    Titles of LEAST characters and more are met through their rarest minimiser, shorter ones through their
    beginning. Ids alone are shuffled for that; each text follows once, to the pairs left.
    """
    a, b = (x.select("id", "norm").where("length(norm) > 0") for x in (refs, titles))
    grams_a, grams_b = _grams(a), _grams(b)
    in_item = [x.select(F.col("inner").alias("ref"), F.col("outer").alias("item")) for x in (_may_hold(grams_a, grams_b), _short_may_be_in(a, b))]
    in_ref = [x.select(F.col("outer").alias("ref"), F.col("inner").alias("item")) for x in (_may_hold(grams_b, grams_a), _short_may_be_in(b, a))]
    met = reduce(DataFrame.unionByName, in_item + in_ref).distinct()
    for texts, name in ((a, "ref"), (b, "item")):
        texts = texts.withColumnsRenamed({"id": name, "norm": f"{name}_norm"})
        met = met.join(texts.dropDuplicates([name]), name)  # parted by id for both
    return met.where(F.col("ref_norm").contains(F.col("item_norm")) | F.col("item_norm").contains(F.col("ref_norm"))).select("ref", "item")


def dedup_check(records: DataFrame, items: DataFrame) -> DataFrame:
    """(ref_key, status, item_key): exact by title or else by DOI, probable if one title contains the other, else none.

    records: (ref_key, title, doi); items: (key, ord, title, doi). The first exact match wins; of probable ones the last.
    Equal titles are one, named by 128 bits of their digest, before anything is paired.
    """

    def named(df, *columns):
        once = F.inline(F.array(F.struct(T.normalize_title("title").alias("norm"))))  # filters on a generated column do not normalise again
        rows = df.select(*columns, T.normalize_doi("doi").alias("doi_norm"), once)
        return rows.withColumn("id", F.when(F.col("norm") != "", F.substring(F.unhex(F.sha2("norm", 256)), 1, 16)))

    refs, lib = named(records, "ref_key"), named(items, "key", "ord")
    titles = lib.where("norm != ''").groupBy("id").agg(F.min_by("key", "ord").alias("first"), F.min("ord").alias("first_ord"), F.max_by("key", "ord").alias("last"), F.max("ord").alias("last_ord"))
    dois = lib.where("doi_norm != ''").groupBy("doi_norm").agg(F.min_by("key", "ord").alias("key"), F.min("ord").alias("ord"))
    asked = refs.where("norm != ''").select("ref_key", "id")
    by_title = asked.join(titles, "id").groupBy("ref_key").agg(F.min_by("first", "first_ord").alias("by_title"))
    by_doi = refs.where("doi_norm != ''").select("ref_key", "doi_norm").join(dois, "doi_norm").groupBy("ref_key").agg(F.min_by("key", "ord").alias("by_doi"))
    pairs = contained_pairs(refs.where("norm != ''").select("id", "norm"), lib.where("norm != ''").select("id", "norm")).where("ref != item")
    last = pairs.join(titles, F.col("item") == F.col("id")).groupBy("ref").agg(F.max_by("last", "last_ord").alias("last"), F.max("last_ord").alias("ord"))
    probable = asked.join(last, F.col("id") == F.col("ref")).groupBy("ref_key").agg(F.max_by("last", "ord").alias("probable"))
    out = refs.select("ref_key").join(by_title, "ref_key", "left").join(by_doi, "ref_key", "left").join(probable, "ref_key", "left")
    exact = F.coalesce("by_title", "by_doi")
    return out.select("ref_key", F.when(exact.isNotNull(), "exact").when(F.col("probable").isNotNull(), "probable").otherwise("none").alias("status"), F.coalesce(exact, "probable").alias("item_key"))


def doi_hits(records: DataFrame, items: DataFrame) -> DataFrame:
    """(ref_key, hits, keys) of records with a DOI: library items that have it too. More than one is a duplicate."""
    refs = records.withColumn("norm", T.normalize_doi("doi")).where("norm != ''")
    lib = items.withColumn("norm", T.normalize_doi("doi")).where("norm != ''").groupBy("norm").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return refs.join(lib, "norm", "left").select("ref_key", F.coalesce(F.size("keys"), F.lit(0)).cast("long").alias("hits"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def plan_imports(plan: DataFrame, items: DataFrame) -> DataFrame:
    """plan (ref_key, action, title, doi, item_key) with outcome and target_key.

    skip; reuse of item_key (warning without one); import turns into reuse where the library has the DOI or
    else the title. An unknown action fails the query before anything is written.
    """
    known = F.col("action").isin(*ACTIONS)
    checked = plan.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown import action "), F.coalesce("action", F.lit("null"))))))
    refs = checked.withColumns({"norm_doi": T.normalize_doi("doi"), "norm_title": T.normalize_title("title")})
    by_doi = items.withColumn("norm_doi", T.normalize_doi("doi")).where("norm_doi != ''").groupBy("norm_doi").agg(F.min("key").alias("key_by_doi"))
    by_title = items.withColumn("norm_title", T.normalize_title("title")).where("norm_title != ''").groupBy("norm_title").agg(F.min("key").alias("key_by_title"))
    found = refs.join(by_doi, "norm_doi", "left").join(by_title, "norm_title", "left").withColumn("found", F.coalesce("key_by_doi", "key_by_title"))
    reuse = F.col("action") == "reuse"
    outcome = (
        F.when(F.col("action") == "skip", "skipped").when(reuse & (F.coalesce("item_key", F.lit("")) != ""), "reused").when(reuse, "warning")
        .when(F.col("found").isNotNull(), "precheck_reused").otherwise("create")
    )
    target = F.when(F.col("action") == "skip", None).when(reuse, F.nullif("item_key", F.lit(""))).otherwise(F.col("found"))
    return found.select("ref_key", "action", outcome.alias("outcome"), target.alias("target_key"))


def apply_library(mapping: DataFrame, items: DataFrame, update_doi: bool = False) -> DataFrame:
    """mapping (ref_key, item_key, doi, first_author, year) with the library's values over its own, and doi_mismatch.

    A mapping row whose item is missing or has no title fails the whole query, so nothing is half updated.
    """
    lib = items.select(F.col("key").alias("item_key"), F.col("doi").alias("lib_doi"), F.col("first_author").alias("lib_author"), F.col("year").alias("lib_year"), F.col("title").alias("lib_title"))
    joined = mapping.join(lib, "item_key", "left")
    there = F.coalesce("lib_title", F.lit("")) != ""
    key = F.when(there, F.col("ref_key")).otherwise(F.raise_error(F.concat(F.lit("unable to read library item "), F.coalesce("item_key", F.lit("null")))))
    ours, theirs = T.normalize_doi("doi"), T.normalize_doi("lib_doi")
    doi = F.coalesce(F.nullif("lib_doi", F.lit("")), "doi") if update_doi else F.col("doi")
    return joined.select(
        key.alias("ref_key"), "item_key", doi.alias("doi"), F.coalesce(F.nullif("lib_author", F.lit("")), "first_author").alias("first_author"),
        F.coalesce(F.nullif("lib_year", F.lit("")), "year").alias("year"), ((ours != "") & (theirs != "") & (ours != theirs)).alias("doi_mismatch"),
    )


def union_mappings(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key the second's is kept."""
    both = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(2)))
    rest = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_side").alias("r")).select(key, "r.*")


def build_mapping(imported: DataFrame, prefix: str) -> DataFrame:
    """(ref_key, itemKey, uri, csl, doi, first_author, year) of imported (ref_key, item_key, uri, csl)."""
    return imported.select("ref_key", M.mapping_entry("item_key", "uri", "csl", prefix).alias("m")).select("ref_key", "m.*")
