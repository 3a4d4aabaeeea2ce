"""Reference lists: which paragraphs are references, and their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions.refs import is_numbered, parse_reference
from refloom.functions.text import strip


def numbered_block(paragraphs: DataFrame, partition: list[str], order: str = "para", text: str = "text") -> DataFrame:
    """The first run of numbered paragraphs of each document; blank ones between them do not end it."""
    w = W.partitionBy(*partition).orderBy(order)
    marked = paragraphs.withColumns({"_num": is_numbered(text), "_blank": strip(F.coalesce(F.col(text), F.lit(""))) == ""})
    first = F.min(F.when(F.col("_num"), F.col(order))).over(W.partitionBy(*partition))
    marked = marked.withColumn("_first", first)
    stops = F.count_if(~F.col("_num") & ~F.col("_blank") & (F.col(order) > F.col("_first"))).over(w)
    return marked.withColumn("_stops", stops).where("_num and _stops = 0").drop("_num", "_blank", "_first", "_stops")


def occurrence_key(base: str, partition: list[str], order: list[str | Column]) -> Column:
    """base, base_2, base_3 … in order."""
    n = F.row_number().over(W.partitionBy(*partition, base).orderBy(*order))
    return F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string")))


def extract_references(paragraphs: DataFrame, partition: list[str], order: str = "para", text: str = "text", detect: bool = True) -> DataFrame:
    """(partition, order, ref_key, parsed) of reference paragraphs; blank and unparsable ones are skipped."""
    rows = numbered_block(paragraphs, partition, order, text) if detect else paragraphs
    parsed = rows.withColumn("parsed", parse_reference(text)).where("parsed is not null").withColumn("base_key", F.col("parsed.base_key"))
    return parsed.withColumn("ref_key", occurrence_key("base_key", partition, [order])).select(*partition, order, "ref_key", "parsed")
