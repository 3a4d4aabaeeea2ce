"""Records of works: from provider and library rows to citation records and back, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.refs import year_in
from refloom.functions.text import clean_markup, col, let, normalize_title, or_null, title_words

AUTHORS = "array<struct<family:string,given:string,literal:string>>"

# Type names of providers, citation records and library items.
PROVIDER_TYPES = {
    "journal-article": "article-journal", "journal-issue": "article-journal", "book-chapter": "chapter", "book": "book",
    "proceedings-article": "paper-conference", "report": "report", "dissertation": "thesis", "posted-content": "article-journal",
    "webpage": "webpage", "dataset": "dataset",
}
LIBRARY_TYPES = {
    "article-journal": "journalArticle", "chapter": "bookSection", "book": "book", "paper-conference": "conferencePaper",
    "report": "report", "thesis": "thesis", "webpage": "webpage", "dataset": "dataset", "posted-content": "preprint",
}


def _looked_up(c, names: dict[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(table, col(c)), F.lit(default))


def _filled(c) -> Column:
    return or_null(col(c).cast("string"))


def record_type(provider_type) -> Column:
    return _looked_up(provider_type, PROVIDER_TYPES, "article-journal")


def library_type(record_type_) -> Column:
    return _looked_up(record_type_, LIBRARY_TYPES, "journalArticle")


def date_parts(text) -> Column:
    """[year, month, day] of a date that starts with a year, as far as given; null for anything else."""
    found = [F.regexp_extract(F.trim(col(text)), r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k) for k in (1, 2, 3)]
    return F.when(found[0] != "", F.transform(F.filter(F.array(*found), lambda x: x != ""), lambda x: x.cast("int")))


def date_text(parts) -> Column:
    """year[-mm[-dd]]; null without a year."""
    p = col(parts)
    return F.when(F.get(p, F.lit(0)).isNotNull(), F.array_join(F.transform(p, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-"))


def first_author(csl) -> Column:
    """The first author's family, else the literal name, else the empty string."""
    a = F.get(col(csl)["author"], F.lit(0))
    return F.coalesce(_filled(a["family"]), _filled(a["literal"]), F.lit(""))


def record_year(csl) -> Column:
    """The issue year as text, or the empty string."""
    y = F.get(F.get(col(csl)["issued"], F.lit(0)), F.lit(0))
    return F.coalesce(F.nullif(y, F.lit(0)).cast("string"), F.lit(""))


def _record(kind, title, author, issued, container, volume, issue, page, publisher, doi, url) -> Column:
    return F.struct(
        kind.alias("type"), title.alias("title"), author.cast(AUTHORS).alias("author"), issued.cast("array<array<int>>").alias("issued"), container.alias("container_title"),
        volume.alias("volume"), issue.alias("issue"), page.alias("page"), publisher.alias("publisher"), doi.alias("DOI"), url.alias("URL"),
    )


def from_provider(type_, title, author, issued, container, volume, issue, page, publisher, doi) -> Column:
    """A record from a provider's row: markup cleaned, empty fields null; authors are structs of family, given and name."""
    people = F.filter(
        F.transform(col(author), lambda a: F.when(_filled(a["family"]).isNotNull(), F.struct(a["family"].alias("family"), F.coalesce(a["given"], F.lit("")).alias("given"), F.lit(None).cast("string").alias("literal")))
                    .when(_filled(a["name"]).isNotNull(), F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), a["name"].alias("literal")))),
        lambda a: a.isNotNull(),
    )
    return _record(record_type(type_), clean_markup(_filled(title)), F.when(F.size(people) > 0, people), col(issued), clean_markup(_filled(container)), _filled(volume), _filled(issue), _filled(page), _filled(publisher), _filled(doi), F.lit(None).cast("string"))


def from_medline(title, authors, source, pubdate, doi) -> Column:
    """A record from a medical provider's row; the year is the first one in its free-text date."""
    none, year = F.lit(None).cast("string"), year_in(pubdate).cast("int")
    return _record(F.lit("article-journal"), _filled(title), F.when(F.size(col(authors)) > 0, col(authors)), F.when(year.isNotNull(), F.array(F.array(year))), _filled(source), none, none, none, none, _filled(doi), none)


def from_library(item_type, title, creators, date, publication, volume, issue, pages, doi, url, fallback_type) -> Column:
    """A record from a library row. Single names are literal; reports have no journal fields; an unknown date is [[]]."""
    none = F.lit(None).cast("string")

    def person(c: Column) -> Column:
        last, first = _filled(c["lastName"]), _filled(c["firstName"])
        both = last.isNotNull() & first.isNotNull()
        alone = F.coalesce(last, first)
        return F.when(alone.isNotNull(), F.struct(F.when(both, last).alias("family"), F.when(both, first).alias("given"), F.when(~both, alone).alias("literal")))

    report = F.trim(F.coalesce(col(item_type), F.lit(""))) == "report"
    kind = F.when(report, "report").otherwise(F.coalesce(col(fallback_type), F.lit("article-journal")))
    people = F.filter(F.transform(col(creators), person), lambda p: p.isNotNull())
    article = kind != "report"
    return _record(kind, _filled(title), F.when(F.size(people) > 0, people), F.array(F.coalesce(date_parts(date), F.array().cast("array<int>"))), *(F.when(article, _filled(x)) for x in (publication, volume, issue, pages)), none, _filled(doi), _filled(url))


def library_fields(csl) -> Column:
    """The library's fields of a record as a map, only those that have a value. A chapter's container is its book."""
    c = col(csl)
    container = F.when(library_type(c["type"]) == "bookSection", "bookTitle").otherwise("publicationTitle")
    pairs = [("title", c["title"]), (container, c["container_title"]), ("volume", c["volume"]), ("issue", c["issue"]), ("pages", c["page"]), ("publisher", c["publisher"]), ("DOI", c["DOI"]), ("date", date_text(F.get(c["issued"], F.lit(0))))]
    entries = F.array(*(F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), _filled(v).alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def library_creators(csl) -> Column:
    """The library's creators of a record; a literal author has a name alone."""
    return F.transform(
        F.coalesce(col(csl)["author"], F.array().cast(AUTHORS)),
        lambda a: F.struct(
            F.lit("author").alias("creatorType"), _filled(a["literal"]).alias("name"),
            F.when(_filled(a["literal"]).isNull(), F.coalesce(a["given"], F.lit(""))).alias("firstName"), F.when(_filled(a["literal"]).isNull(), F.coalesce(a["family"], F.lit(""))).alias("lastName"),
        ),
    )


def confidence(ref, csl) -> Column:
    """A struct of score (0 to 1, two decimals) and matched: first author 0.4, year 0.3, share of the record's title words 0.3."""
    r, c = col(ref), col(csl)
    theirs = F.get(c["author"], F.lit(0))
    facts = F.struct(
        normalize_title(F.get(r["authors"], F.lit(0))["family"]).alias("ours"), normalize_title(F.coalesce(_filled(theirs["family"]), _filled(theirs["literal"]), F.lit(""))).alias("name"),
        title_words(r["title"]).alias("asked"), title_words(c["title"]).alias("words"), ((F.coalesce(r["year"], F.lit("")) != "") & (r["year"] == record_year(csl))).alias("year"),
    )
    return let(facts, lambda f: let(F.size(F.array_intersect(f["asked"], f["words"])), lambda shared: _scored(f, shared)))


def _scored(f: Column, shared: Column) -> Column:
    author = (f["ours"] != "") & (f["name"] != "") & (f["name"].contains(f["ours"]) | f["ours"].contains(f["name"]))
    score = F.when(author, 0.4).otherwise(0.0) + F.when(f["year"], 0.3).otherwise(0.0) + F.when(shared > 0, 0.3 * (shared / F.size(f["words"]))).otherwise(0.0)
    matched = F.filter(F.array(F.when(author, "author"), F.when(f["year"], "year"), F.when(shared > 0, "title")), lambda x: x.isNotNull())
    return F.struct(F.round(F.least(score, F.lit(1.0)), 2).alias("score"), matched.alias("matched"))


def mapping_entry(item_key_, uri, csl, prefix: str) -> Column:
    """A row of the mapping from reference keys to library items."""
    c = col(csl)
    return F.struct(
        col(item_key_).alias("itemKey"), F.coalesce(_filled(uri), F.concat(F.lit(prefix), col(item_key_))).alias("uri"), c.alias("csl"),
        F.coalesce(c["DOI"], F.lit("")).alias("doi"), first_author(csl).alias("first_author"), record_year(csl).alias("year"),
    )
