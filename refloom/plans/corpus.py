"""Citation corpora derived from relational tables: the same rows in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference for each line item: (ref_no, ln, part, supp, fam, giv, title, jr, yr, doi, raw_text)."""
    lines, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    orders = orders.select("o_orderkey", F.year("o_orderdate").alias("_year"))  # a year is shuffled, not a time
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    name, year = F.col("p_name"), F.col("_year").cast("string")
    out = rows.select(
        F.col("o_orderkey").alias("ref_no"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substr(p_name, 2, instr(p_name, ' ') - 2)")).alias("fam"),
        F.expr("chr(65 + cast(p_size as int) % 26)").alias("giv"), F.concat("p_type", F.lit(" "), "p_name").alias("title"),
        F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("jr"), year.alias("yr"),
        F.concat(F.lit("10."), (F.col("l_suppkey") + 1000).cast("string"), F.lit("/S"), F.col("l_partkey").cast("string"), F.lit("("), F.substring(year, 3, 2), F.lit(")"), F.col("l_linenumber").cast("string")).alias("doi"),
    )
    raw = F.concat(F.lit("["), F.col("ref_no").cast("string"), F.lit("] "), "fam", F.lit(" "), "giv", F.lit(". "), "title", F.lit(". "), "jr", F.lit(". "), "yr", F.lit(". doi:"), "doi", F.lit("."))
    return out.withColumn("raw_text", raw)


def bodies(refs: DataFrame) -> DataFrame:
    """A sentence that cites each reference twice: (…, doi2, body)."""
    doi2 = F.concat(F.lit("10.9999/T"), F.col("supp").cast("string"))
    body = F.concat(F.lit("Claim ("), "fam", F.lit(", "), "yr", F.lit(") and (doi:"), "doi", F.lit("; "), doi2, F.lit(")."))
    return refs.withColumns({"doi2": doi2, "body": body})


CORPUS_SQL = """
corpus as (
  select o_orderkey as ref_no, l_linenumber as ln, l_partkey as part, l_suppkey as supp, fam, giv, title, jr, yr, doi,
    concat('[', cast(o_orderkey as varchar), '] ', fam, ' ', giv, '. ', title, '. ', jr, '. ', yr, '. doi:', doi, '.') as raw_text,
    concat('10.9999/T', cast(l_suppkey as varchar)) as doi2,
    concat('Claim (', fam, ', ', yr, ') and (doi:', doi, '; ', concat('10.9999/T', cast(l_suppkey as varchar)), ').') as body
  from (select o_orderkey, l_linenumber, l_partkey, l_suppkey,
      concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, instr(p_name, ' ') - 2)) as fam,
      chr(65 + cast(p_size as int) % 26) as giv, concat(p_type, ' ', p_name) as title,
      replace(p_brand, '#', ' ') as jr, cast(year(o_orderdate) as varchar) as yr,
      concat('10.', cast(1000 + l_suppkey as varchar), '/S', cast(l_partkey as varchar), '(',
             substr(cast(year(o_orderdate) as varchar), 3, 2), ')', cast(l_linenumber as varchar)) as doi
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey) q)
"""
