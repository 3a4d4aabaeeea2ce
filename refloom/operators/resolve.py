"""Resolving references against providers' candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions import metadata as M
from refloom.functions import text as T

KEPT_CANDIDATES = 5


def _score() -> Column:
    """A struct of score and matched of a candidate (provider, csl) beside its reference (parsed); one with the reference's own DOI scores 1."""
    same = (F.coalesce("parsed.doi", F.lit("")) != "") & (T.normalize_doi("parsed.doi") == T.normalize_doi("csl.DOI"))
    by_doi = F.coalesce(same & (F.col("provider") == "doi"), F.lit(False))
    return T.let(M.confidence("parsed", "csl"), lambda c: F.when(by_doi, F.struct(F.lit(1.0).alias("score"), F.array_append(c["matched"], F.lit("doi")).alias("matched"))).otherwise(c))


def scored(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (ref_key, ord, provider, csl) of refs (ref_key, parsed) with score and matched."""
    return candidates.join(refs, "ref_key").withColumn("s", _score()).select("ref_key", "ord", "provider", "csl", "s.score", "s.matched")


def best_of(candidates: DataFrame) -> DataFrame:
    """(ref_key, best, candidates): the candidate with the highest score above 0, the earliest of equals; and the first KEPT_CANDIDATES that came."""
    first = candidates.withColumn("_n", F.row_number().over(W.partitionBy("ref_key").orderBy("ord")))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= KEPT_CANDIDATES, F.struct("ord", "provider", "score"))))
    best = F.min_by(F.when(F.col("score") > 0, F.struct("provider", "csl", "score", "matched", "ord")), F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), "ord")))
    return first.groupBy("ref_key").agg(best.alias("best"), kept.alias("candidates"))


def resolve_staged(refs: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """(ref_key, provider, csl, confidence, level, candidates, resolve_error).

    stages: candidates (ref_key, provider, csl, rank) of one provider each; a stage is asked only for references
    whose best so far is below the threshold for high confidence. Candidates meet their references once, and the
    stages follow one another over that partitioning; none is scored for a reference that a stage before has settled.
    """
    of = W.partitionBy("ref_key")
    every = reduce(DataFrame.unionByName, (s.select("ref_key", "provider", "csl", F.lit(k).alias("stage"), (F.col("rank") + k * 1000).alias("ord")) for k, s in enumerate(stages)))
    rows = every.join(refs.select("ref_key", "parsed"), "ref_key").withColumn("s", F.when(F.col("stage") == 0, _score()))
    for k in range(1, len(stages)):
        rows = rows.withColumn("_top", F.max("s.score").over(of))
        asked = (F.col("stage") == k) & (F.coalesce("_top", F.lit(0.0)) < T.HIGH_CONFIDENCE)
        rows = rows.withColumn("s", F.coalesce("s", F.when(asked, _score())))
    found = rows.where("s is not null").select("ref_key", "ord", "provider", "csl", "s.score", "s.matched")
    out = refs.select("ref_key").join(best_of(found), "ref_key", "left")
    score = F.coalesce("best.score", F.lit(0.0))
    return out.select("ref_key", "best.provider", "best.csl", score.alias("confidence"), T.confidence_level(score).alias("level"), "candidates", F.col("best").isNull().alias("resolve_error"))


def summary(resolved: DataFrame) -> DataFrame:
    return resolved.select("ref_key", F.coalesce("csl.title", F.lit("")).alias("title"), M.first_author("csl").alias("first_author"), M.record_year("csl").alias("year"), "provider", "confidence", "level", "resolve_error")


def statistics(resolved: DataFrame, dedup: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: total, resolved, low_confidence, dups, imported, skipped, warnings."""
    a = resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("not resolve_error")).alias("resolved"), F.count_if(F.col("confidence") < T.HIGH_CONFIDENCE).alias("low_confidence"))
    b = dedup.agg(F.count_if(F.expr("status != 'none'")).alias("dups"))
    c = imported.agg(F.count_if(F.expr("outcome not in ('skipped', 'warning')")).alias("imported"), F.count_if(F.expr("outcome = 'warning'")).alias("warnings"))
    return reduce(lambda x, y: x.join(F.broadcast(y)), (a, b, c)).withColumn("skipped", F.col("total") - F.col("imported"))  # one row each
