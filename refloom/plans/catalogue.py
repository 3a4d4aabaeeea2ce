"""Registered queries of the citation engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import metadata as M
from refloom.functions import refs as R
from refloom.functions import text as T
from refloom.operators import audit, fields, library, refs, resolve, spans
from refloom.plans.corpus import CORPUS_SQL, bodies, references, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL after the corpus of references if SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {CORPUS_SQL.strip()}{sql}" if sql.startswith(", ") else f"with {CORPUS_SQL}\n{sql}" if "corpus" in sql else sql
        return f

    return wrap


_DOC = ("ref_no", "part", "supp")


def _flat(df: DataFrame, text: str = "body") -> DataFrame:
    """Texts with a document's id in three columns and its line as paragraph; rows that are equal in all are one text. They stay where the corpus' last join has put them."""
    return df.select(*_DOC, F.col("ln").alias("para"), F.col(text).alias("text")).distinct()


def _texts(df: DataFrame, text: str = "body") -> DataFrame:
    """Texts as the span operators take them, each a document; rows that are equal in all are one text."""
    return _flat(df, text).select(F.struct("ref_no", F.col("para").alias("ln"), "part", "supp").alias("doc_id"), F.lit(0).alias("para"), "text")


_LINE = ("ref_no", "ln", "part", "supp")
_PLACE = ["doc_id.ref_no", "doc_id.ln", "doc_id.part", "doc_id.supp"]


# ------------------------------------------------------------------ scalar functions


@query("select ref_no, ln, part, supp, doi as doi_raw, lower(doi) as doi_norm from corpus")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir)
    return c.select("ref_no", "ln", "part", "supp", F.regexp_replace(F.get(T.doi_tokens("raw_text"), F.lit(0)), r"\.$", "").alias("doi_raw"), T.first_doi("raw_text").alias("doi_norm"))


_VARIANTS = ("{}", "https://doi.org/{}", "DOI: {}", "({})", "{}.", "http://dx.doi.org/{};")


@query("""select ref_no, ln, part, supp, ln % 6 as variant,
  rtrim(regexp_replace(regexp_replace(lower(case ln % 6 when 0 then doi when 1 then 'https://doi.org/' || doi when 2 then 'DOI: ' || doi
    when 3 then '(' || doi || ')' when 4 then doi || '.' else 'http://dx.doi.org/' || doi || ';' end), '^\\(?((https?://(dx\\.)?doi\\.org/)|(doi: ))?', ''),
    '(\\)[^)]*)\\)$', '\\1'), '.;') as doi_norm from corpus""")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir)
    variant = F.coalesce(*(F.when(F.col("ln") % 6 == k, F.concat(F.lit(v.split("{}")[0]), "doi", F.lit(v.split("{}")[1]))) for k, v in enumerate(_VARIANTS)))
    return c.select("ref_no", "ln", "part", "supp", (F.col("ln") % 6).alias("variant"), T.normalize_doi(variant).alias("doi_norm"))


@query("""select ref_no, ln, part, supp, yr as year, title, fam as family, giv as given, jr as journal, lower(doi) as doi,
  lower(fam) || yr as base_key from corpus""")
def parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = references(spark, sf_dir).select("ref_no", "ln", "part", "supp", R.parse_reference("raw_text").alias("p"))
    author = F.get(F.col("p.authors"), F.lit(0))
    return p.select("ref_no", "ln", "part", "supp", "p.year", "p.title", author["family"].alias("family"), author["given"].alias("given"), "p.journal", "p.doi", "p.base_key")


@query("""select raw_text, lower(fam) || yr || case when n = 1 then '' else '_' || cast(n as varchar) end as ref_key
  from (select *, row_number() over (partition by lower(fam) || yr order by ref_no, ln, raw_text) as n from corpus) q""")
def ref_key_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir).withColumn("base_key", T.base_ref_key("fam", "yr"))
    return c.select("raw_text", refs.occurrence_key("base_key", [], ["ref_no", "ln", "raw_text"]).alias("ref_key"))


@query("""select ref_no, para, text from (
  select *, sum(case when kind = 2 and para > first then 1 else 0 end) over (partition by ref_no order by para) as stops from (
    select *, min(case when kind = 0 then para end) over (partition by ref_no) as first from (
      select ref_no, para, text, case when regexp_matches(text, '^\\s*\\[[0-9]+\\]') then 0 when trim(text) = '' then 1 else 2 end as kind from (
        select ref_no, row_number() over (partition by ref_no order by ln, raw_text) as para,
          case when ln % 3 = 1 then '  ' when ln % 7 = 5 then 'Heading' else raw_text end as text from corpus) a) b) c) d
  where kind = 0 and stops = 0""")
def numbered_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("ln") % 3 == 1, "  ").when(F.col("ln") % 7 == 5, "Heading").otherwise(F.col("raw_text"))
    c = references(spark, sf_dir).select("ref_no", F.expr("row_number() over (partition by ref_no order by ln, raw_text)").alias("para"), text.alias("text"))
    return refs.numbered_block(c, ["ref_no"]).select("ref_no", "para", "text")


@query("""select norm, count(*) as copies, min(doc_id) as first_doc from (
  select doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9一-鿿]', '', 'g') as norm from documents) q
  where norm <> '' group by norm having count(*) > 1""")
def title_norm_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_title("text").alias("norm")).where("norm <> ''")
    return d.groupBy("norm").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""select p_partkey, case when p_partkey % 4 = 3 then '' when p_partkey % 4 = 0 then 'GB/T 7714' when p_partkey % 4 = 1 then p_brand else 'Nature ' || p_brand end as name,
  case when p_partkey % 4 = 3 then 'http://www.zotero.org/styles/apa' when p_partkey % 4 = 0 then 'http://www.zotero.org/styles/gb7714-2015-numeric'
    when p_partkey % 4 = 2 then 'http://www.zotero.org/styles/nature' end as style from part""")
def style_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 3, "").when(k == 0, "GB/T 7714").when(k == 1, F.col("p_brand")).otherwise(F.concat(F.lit("Nature "), "p_brand")).alias("name"))
    return p.select("p_partkey", "name", T.style_id("name").alias("style"))


@query("""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&#8209;', '‑'), '&amp;', '&'), '\\s+', ' ', 'g')) as clean from pages""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_markup("html").alias("clean"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when event_id % 3 = 0 then 'citation' when event_id % 3 = 1 then 'bibliography' else 'other' end as kind from events""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    mark = F.when(n == 0, fields.CITATION_MARK).when(n == 1, fields.BIBLIOGRAPHY_MARK).otherwise("TOC")
    e = table(spark, sf_dir, "events").withColumn("instruction", F.concat(F.lit(" ADDIN "), mark, F.lit(" "), "props", F.lit(" end ")))
    return e.select("event_id", F.from_json(T.payload_text("instruction"), "k long")["k"].alias("k"), fields.field_kind("instruction").alias("kind"))


@query("""select o_orderkey, year(o_orderdate) as y, case when o_orderkey % 3 > 0 then month(o_orderdate) end as m, case when o_orderkey % 3 > 1 then day(o_orderdate) end as d,
  case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as date_text from orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10)
    o = table(spark, sf_dir, "orders").select("o_orderkey", M.date_parts(F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), length)).alias("p"))
    return o.select("o_orderkey", *(F.get("p", F.lit(k)).cast("long").alias(n) for k, n in enumerate("ymd")), M.date_text("p").alias("date_text"))


_KINDS = ("journal-article", "book-chapter", "book", "proceedings-article", "posted-content", "unheard-of")


@query("""select ref_no, ln, part, supp, case ln % 6 when 1 then 'chapter' when 2 then 'book' when 3 then 'paper-conference' else 'article-journal' end as type,
  case ln % 6 when 1 then 'bookSection' when 2 then 'book' when 3 then 'conferencePaper' else 'journalArticle' end as item_type,
  case when ln % 2 = 0 then fam else title end as first_author, yr as year, title,
  case when ln % 6 = 1 then jr end as book_title, case when ln % 6 <> 1 then jr end as publication, yr as date from corpus""")
def csl_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("ln") % 6 == k, v) for k, v in enumerate(_KINDS)))
    even, none = F.col("ln") % 2 == 0, F.lit(None).cast("string")
    author = F.array(F.struct(F.when(even, F.col("fam")).alias("family"), F.col("giv").alias("given"), F.when(~even, F.col("title")).alias("name")))
    csl = M.from_provider(kind, F.concat(F.lit("<i>"), "title", F.lit("</i>")), author, F.array(F.array(F.col("yr").cast("int"))), F.col("jr"), none, none, none, none, F.col("doi"))
    c = references(spark, sf_dir).withColumn("csl", csl).withColumn("f", M.library_fields("csl"))
    return c.select("ref_no", "ln", "part", "supp", "csl.type", M.library_type("csl.type").alias("item_type"), M.first_author("csl").alias("first_author"), M.record_year("csl").alias("year"), "csl.title",
                    F.try_element_at("f", F.lit("bookTitle")).alias("book_title"), F.try_element_at("f", F.lit("publicationTitle")).alias("publication"), F.try_element_at("f", F.lit("date")).alias("date"))


# ------------------------------------------------------------------ spans


@query("""select distinct ref_no, ln, part, supp, instr(body, ' (doi:') as "start", instr(body, ' (doi:') + length(body) - instr(body, ' (doi:') - 1 as "end",
  substr(body, instr(body, ' (doi:') + 1, length(body) - instr(body, ' (doi:') - 1) as display, lower(doi) || ' ' || lower(doi2) as dois from corpus""")
def doi_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spans.extract_doi_groups(_texts(bodies(references(spark, sf_dir))))
    return g.select(*_PLACE, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "display", F.array_join("dois", " ").alias("dois"))


@query("""select distinct ref_no, ln, part, supp, lower(doi2) as doi, substr('See ' || doi2 || ' then . End of it.', 1, 4 + length(doi2) + 20) as context from corpus""")
def loose_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bodies(references(spark, sf_dir)).withColumn("text", F.concat(F.lit("See "), "doi2", F.lit(" then (doi:"), "doi", F.lit("). End of it.")))
    return spans.extract_loose_dois(_texts(c, "text")).select(*_PLACE, "doi", "context")


@query("""select distinct ref_no, ln, part, supp, case ln % 3 when 0 then 'doi' else 'bare' end as kind, case ln % 3 when 1 then lower(doi) end as doi
  from corpus where ln % 3 <> 2""")
def residual_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ln") % 3
    text = F.when(k == 0, F.concat(F.lit("as in doi: "), "doi", F.lit(" here"))).when(k == 1, F.concat(F.lit("as in "), "doi", F.lit(" here"))).otherwise("worth 10. or so")
    return spans.residual_placeholders(_texts(references(spark, sf_dir).withColumn("text", text), "text")).select(*_PLACE, "kind", "doi")


def _mapping(c: DataFrame) -> DataFrame:
    """Library references: of every fifth supplier's lines, with the author and year of the text."""
    rows = c.where(F.col("supp") % 5 != 0).groupBy("fam", "yr", "doi").agg(F.min("raw_text").alias("ref_key"))
    return rows.select("ref_key", F.xxhash64("ref_key").alias("ord"), "doi", F.col("fam").alias("first_author"), F.col("yr").alias("year"), F.lit(False).alias("is_nih"))


@query("""select distinct ref_no, ln, part, supp, 6 as "start", length(fam) + length(yr) + 10 as "end", concat('(', fam, ', ', yr, ')') as display, k as keys
  from corpus join (select fam, yr, min(raw_text) as k from corpus where supp % 5 <> 0 group by fam, yr) m using (fam, yr)""")
def author_year_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bodies(references(spark, sf_dir))
    # one row for each surname and year; chosen in the aggregate, not before it, so that the corpus is shuffled once for both sides
    m = c.groupBy(F.col("fam").alias("first_author"), F.col("yr").alias("year")).agg(F.min(F.when(F.col("supp") % 5 != 0, F.col("raw_text"))).alias("ref_key")).where("ref_key is not null")
    m = m.select("ref_key", F.lit(0).alias("ord"), F.lit("").alias("doi"), "first_author", "year", F.lit(False).alias("is_nih"))
    surnames = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1)).distinct().count()
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate")).distinct().count()
    found = spans.find_citations(_flat(c), m, doc=_DOC, small=True if surnames * years <= spans.MOST_BROADCAST else None)
    return found.withColumnRenamed("para", "ln").select(*_LINE, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "display", F.array_join("keys", " ").alias("keys"))


@query("""select distinct ref_no, ln, part, supp, concat('(doi:', doi, '; ', doi2, ')') as display, k || '|' || doi2 as keys
  from corpus join (select doi, min(raw_text) as k from corpus where supp % 5 <> 0 group by doi) m using (doi)""")
def doi_match_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bodies(references(spark, sf_dir))
    one = c.where(F.col("supp") % 5 != 0).groupBy("doi").agg(F.min("raw_text").alias("ref_key"))
    two = c.select(F.col("doi2").alias("doi"), F.col("doi2").alias("ref_key")).distinct()
    m = one.unionByName(two).select("ref_key", F.lit(0).alias("ord"), "doi", F.lit("").alias("first_author"), F.lit("").alias("year"), F.lit(False).alias("is_nih"))
    return spans.find_citations(_flat(c), m, doc=_DOC).withColumnRenamed("para", "ln").select(*_LINE, "display", F.array_join("keys", "|").alias("keys"))


@query("""select distinct ref_no, ln, part, supp, 7 as "start", concat('(', jr, ' label)') as display, replace(jr, ' ', '') as keys from corpus where part % 2 = 0""")
def text_map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir).withColumn("text", F.concat(F.lit("Warned ("), "jr", F.when(F.col("part") % 2 == 0, " label").otherwise(" note"), F.lit(") there.")))
    literals = c.select(F.concat("jr", F.lit(" label")).alias("text"), F.array(F.replace("jr", F.lit(" "), F.lit(""))).alias("keys")).distinct()
    none = _mapping(c).limit(0)
    return spans.find_citations(_flat(c, "text"), none, literals, doc=_DOC).withColumnRenamed("para", "ln").select(*_LINE, F.col("start").cast("long").alias("start"), "display", F.array_join("keys", "|").alias("keys"))


@query("""select distinct ref_no, ln, part, supp, case ln % 3 when 0 then doi when 1 then '(doi:' || doi || ').' else ' ' || doi || '; ' end as display, k as keys
  from corpus join (select doi, min(raw_text) as k from corpus where supp % 5 <> 0 group by doi) m using (doi)""")
def standalone_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ln") % 3
    c = references(spark, sf_dir)
    text = F.when(k == 0, F.col("doi")).when(k == 1, F.concat(F.lit("(doi:"), "doi", F.lit(").")))
    c = c.withColumn("text", text.otherwise(F.concat(F.lit(" "), "doi", F.lit("; "))))
    m = _mapping(c).groupBy("doi").agg(F.min("ref_key").alias("ref_key")).select("ref_key", F.lit(0).alias("ord"), "doi", F.lit("").alias("first_author"), F.lit("").alias("year"), F.lit(False).alias("is_nih"))
    return spans.find_citations(_flat(c, "text"), m, doc=_DOC).withColumnRenamed("para", "ln").select(*_LINE, "display", F.array_join("keys", "|").alias("keys"))


@query("""select conv_id, turn, s as "start", e as "end", src from (
  select conv_id, turn, turn % 7 as s, turn % 7 + 5 as e, 'a' as src from conversations union all
  select conv_id, turn, length(text) % 16, length(text) % 16 + 4, 'b' from conversations where not (length(text) % 16 + 4 > turn % 7 and length(text) % 16 < turn % 7 + 5)) q""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(start, width, name):
        return F.array(F.struct(start.cast("int").alias("start"), (start + width).cast("int").alias("end"), F.lit(name).alias("display"), F.array().cast("array<string>").alias("keys")))

    c = table(spark, sf_dir, "conversations").withColumns({"a": span(F.col("turn") % 7, 5, "a"), "b": span(F.length("text") % 16, 4, "b")})
    s = c.select("conv_id", "turn", F.explode(spans.merge_spans("a", "b")).alias("s"))
    return s.select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.display").alias("src"))


# ------------------------------------------------------------------ fields, runs, ids


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as markers of fields: a signup begins one, a purchase ends one."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", step.alias("step"))


_DEPTH_SQL = """with m as (select user_id, event_id, case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end as step from events),
s as (select *, sum(step) over (partition by user_id order by event_id) as total from m),
d as (select user_id, event_id, step, cast(total - least(0, min(total) over (partition by user_id order by event_id)) as bigint) as depth from s)
"""


@query(_DEPTH_SQL + "select user_id, event_id, depth from d")
def field_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_depth(_markers(spark, sf_dir), ["user_id"], "event_id", "step").select("user_id", "event_id", "depth")


@query(_DEPTH_SQL + """, f as (select b.user_id, b.event_id as "start", (select min(e.event_id) from d e where e.user_id = b.user_id and e.event_id > b.event_id and e.step = -1 and e.depth = b.depth - 1) as "end"
  from d b where b.step = 1)
select user_id, count(*) as closed, count(*) filter (exists (select 1 from f p where p.user_id = f.user_id and p."start" < f."start" and f."start" < p."end")) as nested from f where "end" is not null group by user_id""")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields.matched_fields(_markers(spark, sf_dir).where("step <> 0"), ["user_id"], "event_id", "step").where("end is not null")
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("closed")).join(fields.nested_count(f, ["user_id"]), "user_id")


@query("""select user_id, count(*) filter (event_type = 'click') as citations, count(*) filter (event_type = 'view') as bibliographies,
  count(*) filter (event_type = 'signup') as preferences, count(*) as total from events group by user_id""")
def field_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    mark = F.when(t == "click", fields.CITATION_MARK).when(t == "view", fields.BIBLIOGRAPHY_MARK).when(t == "signup", fields.PREFERENCES_MARK).otherwise("PAGE")
    e = table(spark, sf_dir, "events").withColumn("kind", fields.field_kind(F.concat(F.lit(" ADDIN "), mark, F.lit(" {}"))))
    return e.groupBy("user_id").agg(F.count_if(F.expr("kind = 'citation'")).alias("citations"), F.count_if(F.expr("kind = 'bibliography'")).alias("bibliographies"), F.count_if(F.expr("kind = 'preferences'")).alias("preferences"), F.count(F.lit(1)).alias("total"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("part") % 11 == 0, F.concat(F.lit("x"), F.col("part").cast("string"))).otherwise(F.concat(F.lit("cit"), (F.col("part") % 37).cast("string")))
    return references(spark, sf_dir).withColumn("citation_id", new)


_IDS_SQL = "ids as (select *, case when part % 11 = 0 then 'x' || cast(part as varchar) else 'cit' || cast(part % 37 as varchar) end as citation_id from corpus)"


@query(", " + _IDS_SQL + " select ref_no, citation_id, count(*) as copies from ids group by ref_no, citation_id having count(*) > 1")
def citation_id_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.duplicate_ids(_ids(spark, sf_dir), ["ref_no"])


@query(", " + _IDS_SQL + """ select ref_no, count(*) as n, count(distinct citation_id) as n_unique,
  coalesce(max(case when citation_id like 'cit%' then cast(substr(citation_id, 4) as bigint) end), -1) + 1 as next_id from ids group by ref_no""")
def citation_id_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fields.citation_id_stats(_ids(spark, sf_dir), ["ref_no"])
    return stats.join(fields.next_id(_ids(spark, sf_dir), ["ref_no"]), "ref_no").select("ref_no", "n", "n_unique", "next_id")


@query(", " + _IDS_SQL + """ select raw_text, case when part % 2 = 0 then 'x' || cast(s + row_number() over (partition by ref_no, part % 2 order by ln, raw_text) as varchar) else citation_id end as new_id
  from (select *, coalesce(max(case when citation_id like 'x%' then cast(substr(citation_id, 2) as bigint) end) over (partition by ref_no), -1) as s from ids) q""")
def renumber_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir).withColumn("display", F.concat("title", F.col("part").cast("string")))
    return fields.renumber(ids, ids.where("part % 2 = 0"), ["ref_no"], ["ln", "raw_text"], "x").select("raw_text", "new_id")


@query("""select ref_no, jr, row_number() over (partition by ref_no order by ln, raw_text, jr) as item_id from (
  select ref_no, jr, ln, raw_text, row_number() over (partition by ref_no, jr order by ln, raw_text) as n from corpus) q where n = 1""")
def item_first_use_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.first_use_id(references(spark, sf_dir), ["ref_no"], "jr", ["ln", "raw_text"]).withColumn("item_id", F.col("item_id").cast("long"))


@query("""select conv_id, turn, s as "start", e as "end", substr(text, cast(greatest(s, 100) - s + 1 as int), cast(least(e, 400) - greatest(s, 100) as int)) as sliced from (
  select conv_id, turn, text, cast(coalesce(sum(length(text)) over w, 0) as bigint) as s, cast(coalesce(sum(length(text)) over w, 0) + length(text) as bigint) as e
  from (select conv_id, turn, max(text) as text from conversations group by conv_id, turn) c
  window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) q where e > 100 and s < 400 and least(e, 400) > greatest(s, 100)""")
def run_offsets_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    runs = fields.run_offsets(turns, ["conv_id"], "turn", "text")
    return fields.slice_runs(runs, F.lit(100), F.lit(400), "text").select("conv_id", "turn", "start", "end", "sliced")


# ------------------------------------------------------------------ library


@query("""select 'K' || cast(o_custkey as varchar) as item_key from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0) group by 1""")
def dead_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("item_key"))
    items = table(spark, sf_dir, "customer").select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") <= 0, "deleted").alias("error"))
    return library.verify_item_keys(keys, items)[1]


@query("""select ref_no, ln, part, supp, 'http://x/items/' || case when part % 3 = 0 then 'N' || cast(part as varchar) else 'P' || cast(part as varchar) end as new_uri, part % 3 = 0 as touched from corpus group by all""")
def relink_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["ref_no", "ln", "part", "supp"]
    c = references(spark, sf_dir).select(*key, F.array(F.concat(F.lit("http://x/items/P"), F.col("part").cast("string"))).alias("uris")).distinct()
    moved = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("new"))
    return fields.relink(c, moved, key).select(*key, F.get("new_uris", F.lit(0)).alias("new_uri"), "touched")


def _items(c: DataFrame) -> DataFrame:
    """Library items: one for each supplier and part, with a DOI by part and year, some without title or DOI."""
    key = F.concat(F.lit("K"), F.col("supp").cast("string"), F.lit("-"), F.col("part").cast("string"))
    rows = c.select(key.alias("key"), "part", "supp", F.when(F.col("part") % 13 != 0, F.col("title")).alias("title")).distinct()
    doi = F.when(F.col("supp") % 7 != 0, F.concat(F.lit("https://doi.org/10.5555/P"), F.col("part").cast("string"), F.lit(".")))
    return rows.withColumns({"doi": doi, "error": F.lit(None).cast("string")})


_ITEMS_SQL = """items as (select distinct 'K' || cast(supp as varchar) || '-' || cast(part as varchar) as key, part, supp, case when part % 13 <> 0 then title end as title,
  case when supp % 7 <> 0 then '10.5555/p' || cast(part as varchar) end as norm from corpus)"""


@query(", " + _ITEMS_SQL + """ select 'index' as list, norm as doi_norm, min(key) as item_key, count(distinct key) as n from items where title is not null and norm is not null group by norm
  union all select 'failure', null, key, 1 from items where title is null""")
def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, failures, duplicates = library.library_index(_items(references(spark, sf_dir)))
    n = duplicates.select("doi_norm", F.size("keys").cast("long").alias("n"))
    out = index.join(n, "doi_norm", "left").select(F.lit("index").alias("list"), "doi_norm", F.col("itemKey").alias("item_key"), F.coalesce("n", F.lit(1)).alias("n"))
    return out.unionByName(failures.select(F.lit("failure").alias("list"), F.lit(None).cast("string").alias("doi_norm"), F.col("key").alias("item_key"), F.lit(1).cast("long").alias("n")))


@query(", " + _ITEMS_SQL + """ select 'R' || cast(p_partkey as varchar) as ref_key, count(distinct key) as hits from part left join items on norm = '10.5555/p' || cast(p_partkey as varchar) group by 1""")
def dedup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("string")
    records = table(spark, sf_dir, "part").select(F.concat(F.lit("R"), p).alias("ref_key"), F.concat(F.lit("doi:10.5555/P"), p).alias("doi"))
    return library.doi_hits(records, _items(references(spark, sf_dir))).select("ref_key", "hits")


@query(", " + _ITEMS_SQL + """, d as (select norm, min(key) as k from items where norm is not null group by norm),
  t as (select regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as nt, min(key) as k from items where title is not null group by 1),
  p as (select p_partkey, case p_partkey % 4 when 0 then 'skip' when 1 then 'reuse' else 'import' end as action,
    case when p_partkey % 8 = 1 then 'OLD' || cast(p_partkey as varchar) end as own, coalesce(d.k, t.k) as found
    from part left join d on d.norm = '10.5555/p' || cast(p_partkey as varchar)
    left join t on t.nt = case when p_partkey % 3 = 0 then regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]', '', 'g') else 'nothing' end)
  select 'R' || cast(p_partkey as varchar) as ref_key, case when action = 'skip' then 'skipped' when action = 'reuse' then case when own is null then 'warning' else 'reused' end
    when found is null then 'create' else 'precheck_reused' end as outcome, case when action = 'reuse' then own when action = 'import' then found end as target_key from p""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    plan = table(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), p).alias("ref_key"), F.when(k % 4 == 0, "skip").when(k % 4 == 1, "reuse").otherwise("import").alias("action"),
        F.when(k % 3 == 0, F.concat("p_type", F.lit(" "), "p_name")).otherwise("nothing").alias("title"), F.concat(F.lit("10.5555/P"), p).alias("doi"),
        F.when(k % 8 == 1, F.concat(F.lit("OLD"), p)).alias("item_key"),
    )
    return library.plan_imports(plan, _items(references(spark, sf_dir))).select("ref_key", "outcome", "target_key")


@query("""select 'R' || cast(c_custkey as varchar) as ref_key, case when c_custkey % 2 = 0 then 'Lib' || cast(c_nationkey as varchar) else c_name end as first_author,
  '2001' as year, c_custkey % 5 = 0 as doi_mismatch from customer""")
def apply_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer")
    doi = F.concat(F.lit("10.7777/C"), n)
    mapping = c.select(F.concat(F.lit("R"), n).alias("ref_key"), F.concat(F.lit("K"), n).alias("item_key"), doi.alias("doi"), F.col("c_name").alias("first_author"), F.lit("2001").alias("year"))
    items = c.select(F.concat(F.lit("K"), n).alias("key"), F.when(k % 5 == 0, F.concat(doi, F.lit("x"))).otherwise(F.concat(F.lit("https://doi.org/"), F.upper(doi))).alias("doi"), F.when(k % 2 == 0, F.concat(F.lit("Lib"), F.col("c_nationkey").cast("string"))).otherwise("").alias("first_author"), F.lit("").alias("year"), F.col("c_name").alias("title"))
    return library.apply_library(mapping, items).select("ref_key", "first_author", "year", "doi_mismatch")


@query("""select coalesce(b.k, a.k) as ref_key, coalesce(b.v, a.v) as item_key from (select 'C' || cast(c_nationkey as varchar) as k, max(c_name) as v from customer group by 1) a
  full join (select 'C' || cast(s_nationkey + 5 as varchar) as k, max(s_name) as v from supplier group by 1) b on a.k = b.k""")
def mapping_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("ref_key")).agg(F.max("c_name").alias("item_key"))
    b = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("C"), (F.col("s_nationkey") + 5).cast("string")).alias("ref_key")).agg(F.max("s_name").alias("item_key"))
    return library.union_mappings(a, b, "ref_key")


@query("""with b as (select item_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9一-鿿]', '', 'g') as nb from benchmark),
  d as (select doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9一-鿿]', '', 'g') as nd from documents),
  h as (select item_id, min(case when nb = nd then doc_id end) as e, max(case when nb <> nd then doc_id end) as p from b join d on contains(nd, nb) or contains(nb, nd) where nd <> '' and nb <> '' group by item_id)
  select b.item_id as ref_key, case when e is not null then 'exact' when p is not null then 'probable' else 'none' end as status, coalesce(e, p) as item_key from b left join h using (item_id)""")
def probable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_key"), F.col("text").alias("title"), F.lit("").alias("doi"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.lit("").alias("doi"))
    return library.dedup_check(records, items)


# ------------------------------------------------------------------ resolution


def _candidates(c: DataFrame, provider: str, ranks: int) -> DataFrame:
    """Each part's record, and one of another year by another author, in this order by part."""
    ours = F.col("rank") == F.col("part") % 2
    fam = F.when(ours, F.col("fam")).otherwise("Nobody")
    issued = F.array(F.array(F.when(ours & (F.col("part") % 3 != 0), F.col("yr").cast("int")).otherwise(F.lit(1900))))
    none = F.lit(None).cast("string")
    csl = M.from_provider(F.lit("journal-article"), F.concat("title", F.lit(" annex")), F.array(F.struct(fam.alias("family"), F.lit("A").alias("given"), none.alias("name"))), issued, none, none, none, none, none, F.when(F.lit(provider == "doi"), F.col("doi")))
    return c.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)))).select("ref_key", F.lit(provider).alias("provider"), csl.alias("csl"), "rank")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir).withColumn("ref_key", F.col("raw_text")).dropDuplicates(["ref_key"])
    return c.withColumn("parsed", R.parse_reference("raw_text"))


_WORDS_SQL = "list_distinct(regexp_extract_all(lower(title), '[a-z]+'))"


@query(f"""select raw_text as ref_key, cast(part % 2 as int) as ord, round(cast(cast(0.4::double + case when part % 3 <> 0 then 0.3::double else 0.0::double end + 0.3::double * (cast(len({_WORDS_SQL}) as double) / (len({_WORDS_SQL}) + 1)) as varchar) as decimal(20, 17)), 2)::double as score
  from (select distinct raw_text, part, title from corpus) q""")
def confidence_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _refs(spark, sf_dir)
    scored = resolve.scored(c.select("ref_key", "parsed"), _candidates(c, "search", 2).withColumnRenamed("rank", "ord"))
    return resolve.best_of(scored).select("ref_key", "best.ord", "best.score")


@query(f"""select raw_text as ref_key, case when supp % 2 = 0 then 'doi' else 'search' end as provider,
  case when supp % 2 = 0 then 1.0 else round(cast(cast(0.4::double + case when part % 3 <> 0 then 0.3::double else 0.0::double end + 0.3::double * (cast(len({_WORDS_SQL}) as double) / (len({_WORDS_SQL}) + 1)) as varchar) as decimal(20, 17)), 2)::double end as confidence
  from (select distinct raw_text, part, supp, title from corpus) q""")
def resolve_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _refs(spark, sf_dir)
    stages = [_candidates(c.where("supp % 2 = 0"), "doi", 1), _candidates(c, "search", 2)]
    return resolve.resolve_staged(c.select("ref_key", "parsed"), stages).select("ref_key", "provider", "confidence")


@query("""with w as (select item_id, unnest(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z]+'))) as word from benchmark),
  v as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(strip_accents(text)), '[a-z]+'))) as word from documents),
  rare as (select word from w group by word having count(*) <= 3),
  c as (select distinct item_id, doc_id from w join v using (word) join rare using (word))
  select item_id, doc_id, round(cast(cast(cast(count(*) as double) / (select count(*) from w x where x.item_id = c.item_id) as varchar) as decimal(20, 17)), 2)::double as overlap
  from c join w using (item_id) join v using (doc_id, word) group by item_id, doc_id""")
def title_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a benchmark text's words in each document that has any of them. The SQL keeps pairs with a word of at most 3 items only."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.title_words("text")).alias("word"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.explode(T.title_words("text")).alias("word"))
    shared = docs.join(items, "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    return shared.join(sizes, "item_id").select("item_id", "doc_id", F.round(F.col("shared") / F.col("size"), 2).alias("overlap"))


# ------------------------------------------------------------------ audit


@query("""select why, count(*) as n from (select case when n > produced then 'no field' when part % 17 = 0 then 'dois differ' when part % 19 = 0 then 'uri differs' when part % 23 = 0 then 'dontUpdate is not false' end as why from (
  select part, supp, row_number() over (partition by doi, doi2 order by ref_no, ln, raw_text) as n, sum(case when supp % 9 <> 0 then 1 else 0 end) over (partition by doi, doi2) as produced from corpus) q) r group by why""")
def audit_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a document: a display names its part, so none is in two. It also names line, supplier and DOIs, so the number of the order ranks rows as their texts do."""
    c = bodies(references(spark, sf_dir)).withColumns({"doc_id": F.col("part"), "display": F.concat(F.lit("(doi:"), "doi", F.lit("; "), "doi2", F.lit(")"))})
    groups = c.select("doc_id", "ref_no", "ln", "display", F.array(F.lower("doi"), F.lower("doi2")).alias("dois"))
    key = F.when(F.col("part") % 19 == 0, "WRONG").otherwise(F.lower("doi"))
    dois = F.when(F.col("part") % 17 == 0, F.array(F.lower("doi"))).otherwise(F.array(F.lower("doi2"), F.lower("doi")))
    cites = c.where(F.pmod("supp", F.lit(9)) != 0).select("doc_id", F.struct("ref_no", "ln").alias("seq"), "display", dois.alias("dois"), F.array(key, F.lower("doi2")).alias("keys"), (F.col("part") % 23 == 0).alias("dont_update"))
    every = c.select(F.explode(F.array(F.lower("doi"), F.lower("doi2"))).alias("doi")).distinct().withColumn("item_key", F.col("doi"))
    return audit.reconcile(groups, cites, every, ["ref_no", "ln"]).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc, sum(n) as missed from (select part % 10 as doc, doi2, greatest(0, count(*) - count(*) filter (ln % 4 <> 0)) as n from corpus group by 1, 2) q where n > 0 group by doc""")
def missed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bodies(references(spark, sf_dir)).select((F.col("part") % 10).alias("doc"), "doi2", "ln")
    return audit.multiset_difference(c.select("doc", "doi2"), c.where("ln % 4 <> 0").select("doc", "doi2")).groupBy("doc").agg(F.count(F.lit(1)).alias("missed"))


@query("""select ref_no, count(*) as items, count(*) filter (part % 7 = 0 or supp % 6 = 0) as bad_uri, count(*) filter (ln = 2) as incomplete,
  count(*) filter (ln <> 2 and ln % 5 = 0) as with_abstract, count(*) filter (part % 7 = 0 or supp % 6 = 0) = 0 and count(*) filter (ln = 2) = 0 as ok from corpus group by ref_no""")
def verify_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir)
    key = F.concat(F.lit("S"), F.col("supp").cast("string"))
    items = c.select("ref_no", F.concat(F.lit("http://x/"), F.when(F.col("part") % 7 == 0, "item/").otherwise("items/"), key).alias("uri"), F.lit("book").alias("type"), "title", F.when(F.col("ln") != 2, F.col("fam")).alias("author"), F.col("yr").alias("issued"), F.when(F.col("ln") % 5 == 0, "text").alias("abstract"))
    valid = c.where("supp % 6 <> 0").select(key.alias("item_key"))
    return audit.verify_counters(audit.verify_items(items, valid), ["ref_no"])


@query("""select col, count(*) as cells, count(*) filter (k = 'field') as with_field, count(*) filter (k = 'doi') as doi_cells, count(*) filter (k = 'number') as number_cells, count(*) filter (k = 'citation') as citation_cells from (
  select 0 as col, case when p_partkey % 5 = 0 then 'field' else 'text' end as k from part union all select 1, 'number' from part where p_size < 1000 union all
  select 2, case when p_partkey % 2 = 0 then 'doi' else 'citation' end from part) q group by col""")
def column_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    one = p.select(F.lit(0).alias("col"), F.col("p_name").alias("text"), (F.col("p_partkey") % 5 == 0).alias("has_field"))
    two = p.where("p_size < 1000").select(F.lit(1).alias("col"), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("text"), F.lit(False).alias("has_field"))
    doi = F.concat(F.lit("doi:10.1000/"), F.col("p_partkey").cast("string"))
    three = p.select(F.lit(2).alias("col"), F.when(F.col("p_partkey") % 2 == 0, doi).otherwise("see [3, 4] there").alias("text"), F.lit(False).alias("has_field"))
    return audit.column_audit(one.unionByName(two).unionByName(three), ["col"])


@query("""select doi_norm, count(*) as uses from (select lower(doi) as doi_norm from corpus union all select lower(doi2) from corpus) q group by doi_norm""")
def doi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bodies(references(spark, sf_dir))
    return c.select(F.explode(T.doi_tokens("body")).alias("d")).groupBy(T.normalize_doi("d").alias("doi_norm")).agg(F.count(F.lit(1)).alias("uses"))


@query("""select count(*) as total, count(*) as resolved, count(*) filter (supp % 2 <> 0 and low) as low_confidence from (select distinct raw_text, supp, part,
  round(cast(cast(0.4::double + case when part % 3 <> 0 then 0.3::double else 0.0::double end + 0.3::double * (cast(len(list_distinct(regexp_extract_all(lower(title), '[a-z]+'))) as double) / (len(list_distinct(regexp_extract_all(lower(title), '[a-z]+'))) + 1)) as varchar) as decimal(20, 17)), 2) < 0.6 as low from corpus) q""")
def resolve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _refs(spark, sf_dir)
    stages = [_candidates(c.where("supp % 2 = 0"), "doi", 1), _candidates(c, "search", 2)]
    done = resolve.summary(resolve.resolve_staged(c.select("ref_key", "parsed"), stages))
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("not resolve_error")).alias("resolved"), F.count_if(F.expr("level <> 'HIGH'")).alias("low_confidence"))


@query()
def rtf_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = references(spark, sf_dir).select("raw_text", F.concat(F.lit("["), "yr", F.lit("\\uc0\\u8211{}"), "yr", F.lit("]")).alias("escaped"))
    return c.select("raw_text", T.canonical("escaped").alias("display"))
