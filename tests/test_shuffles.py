import re

from refloom.operators import spans
from refloom.plans import catalogue


def test_texts_are_shuffled_once(spark):
    """Of the line items there is one text each, dealt out once by its document; what groups by more columns stays on that."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.author_year_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    by_document = [d for d in dealt if "ref_no" in d]
    assert len(by_document) == 1 and not any("doi" in d or "text" in d for d in dealt)


def test_audit_deals_out_no_references(spark):
    """Windows over displays stay on the corpus' partitioning by part; keys are looked up by DOIs, not for each reference."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.audit_multiset(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert not any("ref_no" in d or "raw_text" in d for d in dealt)
    assert sum("display" in d for d in dealt) == 2  # the join of both sides, with the number in the display


def test_groups_are_dealt_out_by_document_once_more(spark, monkeypatch):
    """With a mapping too large to broadcast rows are dealt out by DOI and then by document, not for each grouping again."""
    monkeypatch.setattr(spans, "MOST_BROADCAST", 100)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue.doi_match_all_or_nothing(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    dealt = [d for d in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan) if "para" in d]
    assert len(dealt) == 2 and not any("kind" in d for d in dealt)
    assert found.count() == found.select("ref_no", "ln", "part", "supp").distinct().count() > 1000
