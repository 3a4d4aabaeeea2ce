import pytest
from pyspark.sql import functions as F

from refloom.functions import metadata as M
from refloom.functions import refs as R
from refloom.functions import text as T


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, t string").select("i", column.alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_normalize_doi(spark):
    same = ["10.1000/abc", "https://doi.org/10.1000/ABC", "DOI: 10.1000/abc", "doi:10.1000/abc", "10.1000/abc.", "(10.1000/abc)", "（10.1000/abc）。"]
    assert values(spark, T.normalize_doi("t"), same) == ["10.1000/abc"] * len(same)
    assert values(spark, T.normalize_doi("t"), ["(doi:10.1016/S0306-4530(98)00014-6)", None, "", "10.1/a)))."]) == ["10.1016/s0306-4530(98)00014-6", "", "", "10.1/a"]


def test_parse_reference(spark):
    p = values(spark, R.parse_reference("t"), ["[1] Smith J. Human emotion. Cognition. 2007.", "[5] Lee M. A study. J Sci. 2020. doi:10.1000/xyz123. PMID: 31337", "[8] Smith J and Johnson K. A title. J. 2010.", "[10] Smith J, et al. Another title. J. 2015.", "[1] A study of treatment outcomes. J Med. 2020.", "[1] 张三. 中文标题研究. 中华医学杂志. 2020.", "[1] Smith J. Title. 2007.", " ", None])
    assert (p[0].year, p[0].authors[0].family, p[0].title, p[0].journal, p[0].base_key) == ("2007", "Smith", "Human emotion", "Cognition", "smith2007")
    assert (p[1].doi, p[1].pmid) == ("10.1000/xyz123", "31337")
    assert [a.family for a in p[2].authors] == ["Smith", "Johnson"] and len(p[3].authors) == 1
    assert p[4].authors == [] and p[4].title == "A study of treatment outcomes" and p[4].base_key == "a2020"
    assert (p[5].authors[0].family, p[5].journal) == ("张三", "中华医学杂志")
    assert p[6].journal == "Title" and p[7] is None and p[8] is None


def test_titles_styles_cells(spark):
    assert values(spark, T.normalize_title("t"), ["Café—Über  X1", "儿童 A", None]) == ["cafeuberx1", "儿童a", ""]
    assert values(spark, T.normalize_title_exact(F.col("t")), ["ﬁne Å"]) == ["finea"]
    assert sorted(values(spark, T.title_words("t"), ["儿童自 Bio"])[0]) == sorted(["bio", "儿童自", "儿童", "童自"])
    assert values(spark, T.style_id("t"), ["Nature", "IEEE", "GB/T 7714", "unheard of", ""])[3] is None
    assert values(spark, T.clean_markup("t"), ["Late <i>N</i>&#8209;acetylcysteine  treatment"]) == ["Late N‑acetylcysteine treatment"]
    assert values(spark, T.canonical(F.col("t")), ["[14,21\\uc0\\u8211{}25]", None]) == ["[14,21–25]", ""]
    assert values(spark, T.cell_kind("t", F.lit(False)), ["8", "12–16", "(doi:10.1000/aa)", "see [3, 4]", "", "word"]) == ["number", "number", "doi", "citation", None, "text"]
    assert values(spark, T.item_key("t"), ["http://x/items/AB", "AB"]) == ["AB", "AB"]


def test_dates_types_levels(spark):
    assert values(spark, M.date_parts("t"), ["2008", "2023-01", "2026-5-13", "May 2020", None]) == [[2008], [2023, 1], [2026, 5, 13], None, None]
    assert values(spark, M.date_text(M.date_parts("t")), ["2008", "2023-1", "2026-5-13"]) == ["2008", "2023-01", "2026-05-13"]
    assert values(spark, M.record_type("t"), ["book-chapter", "posted-content", "x", None]) == ["chapter", "article-journal", "article-journal", "article-journal"]
    assert values(spark, M.library_type("t"), ["chapter", "thesis", None]) == ["bookSection", "thesis", "journalArticle"]
    assert values(spark, T.confidence_level(F.col("t").cast("double")), ["0.6", "0.1", "0"]) == ["HIGH", "LOW", "UNKNOWN"]


@pytest.mark.parametrize("year,title,low,high", [(2007, "Human emotion", 0.9, 1.0), (1990, "Other words", 0.4, 0.4), (2007, "Human behaviour", 0.75, 0.9)])
def test_confidence(spark, year, title, low, high):
    ref = R.parse_reference(F.lit("[1] Smith J. Human emotion. Cognition. 2007."))
    none = F.lit(None).cast("string")
    csl = M.from_provider(F.lit("book"), F.lit(title), F.array(F.struct(F.lit("Smith").alias("family"), none.alias("given"), none.alias("name"))), F.array(F.array(F.lit(year))), none, none, none, none, none, none)
    score = spark.range(1).select(ref.alias("r"), csl.alias("c")).select(M.confidence("r", "c").alias("s")).first().s.score
    assert low <= score <= high


def test_library_record(spark):
    creators = F.array(*(F.struct(F.lit(a).cast("string").alias("lastName"), F.lit(b).cast("string").alias("firstName")) for a, b in (("Smith", "John"), ("WHO", ""), ("", "Solo"))))
    row = spark.range(1).select(M.from_library(F.lit("journalArticle"), F.lit("T"), creators, F.lit("2020-05"), F.lit("J"), F.lit("1"), F.lit(""), F.lit("2-3"), F.lit("10.1/x"), F.lit(None), F.lit("article-journal")).alias("c")).first().c
    assert [(a.family, a.literal) for a in row.author] == [("Smith", None), (None, "WHO"), (None, "Solo")]
    assert row.issued == [[2020, 5]] and row.issue is None and row.container_title == "J"
