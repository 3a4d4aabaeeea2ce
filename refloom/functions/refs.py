"""Parsing numbered references into records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.text import base_ref_key, col, first_doi, is_cjk, let, or_null, strip

# How references are numbered and how their parts look.
NUMBERED = r"^\s*(?:\[[0-9]+\]|\([0-9]+\)|[0-9]+[\.\)]\s?)"
LEADING_NUMBER = r"^[\(\[\{]?\s*\d+\s*[\)\.\}\]]?\s*"
YEAR = r"\b((?:19|20)\d{2})\b"
SURNAME_INITIALS = r"^(.+?)\s+([A-ZÀ-Ý][A-ZÀ-Ý.]*(?:\s+[A-ZÀ-Ý][A-ZÀ-Ý.]*)*)$"

_U = "(?U)"


def is_numbered(text) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike(_U + NUMBERED)


def year_in(c) -> Column:
    """The first year from 1900 to 2099 that stands alone, or null."""
    return or_null(F.regexp_extract(col(c), _U + YEAR, 1))


def parse_reference(text) -> Column:
    """A struct of base_key, raw_text, year, title, authors, journal, doi and pmid; null for blank text.

    The first clause names authors if it has separators, a conjunction, initials at its end or is a short
    Chinese name, and holds no year. The title follows, and the journal is the last clause that is neither a
    DOI or PMID nor starts with a year.
    """
    return let(strip(text), lambda raw: F.when(F.coalesce(raw, F.lit("")) != "", let(F.regexp_replace(raw, _U + LEADING_NUMBER, ""), lambda rest: _parsed(raw, rest))))


def _names_authors(first: Column) -> Column:
    separators = first.contains(",") | first.contains(";")
    conjunction = first.rlike(_U + r"\s+(?:and|&)\s+")
    initials = (F.size(F.split(strip(first), _U + r"\s+")) <= 3) & first.rlike(_U + r"\s+[A-Z][A-Z.]{0,2}[.,]?$")
    chinese = first.rlike("^[一-鿿]{2,4}$")
    return F.coalesce((separators | conjunction | initials | chinese) & ~first.rlike(_U + YEAR), F.lit(False))


def _author(part: Column) -> Column:
    given = F.regexp_extract(part, _U + SURNAME_INITIALS, 2)
    family = F.when(given != "", strip(F.regexp_extract(part, _U + SURNAME_INITIALS, 1))).otherwise(part)
    return F.struct(family.alias("family"), F.regexp_replace(strip(given), "[.,]+$", "").alias("given"))


def _told(clauses: Column) -> Column:
    """Clauses after the first that are neither a DOI or PMID nor start with a year."""
    return F.filter(F.slice(clauses, 2, F.greatest(F.size(clauses) - 1, F.lit(0))), lambda x: ~x.rlike(r"(?i)^(?:doi[:/]|pmid[:#]?\s*\d)") & ~x.rlike(_U + r"^\s*(?:19|20)\d{2}\b"))


def _split_up(clauses: Column) -> Column:
    """(authors, title, journal) of a reference's clauses."""
    first = F.get(clauses, F.lit(0))
    parts = F.filter(F.transform(F.split(first, _U + r"\s*[;,]\s*|\s+and\s+"), strip), lambda p: (p != "") & ~p.rlike(_U + r"(?i)^et\s*al\.?$"))
    none = F.array().cast("array<struct<family:string,given:string>>")

    def build(named: Column) -> Column:
        last = let(_told(clauses), lambda t: F.get(t, F.size(t) - 1))
        return F.struct(
            F.when(named, F.transform(parts, _author)).otherwise(none).alias("authors"), F.when(named, F.get(clauses, F.lit(1))).otherwise(first).alias("title"),
            F.when(F.size(clauses) >= F.when(named, 3).otherwise(2), last).alias("journal"),
        )

    return let(_names_authors(first), build)


def _parsed(raw: Column, rest: Column) -> Column:
    clauses = F.filter(F.split(rest, _U + r"\.\s+"), lambda x: strip(x) != "")

    def record(s: Column) -> Column:
        return let(year_in(rest), lambda year: dated(s, year))

    def dated(s: Column, year: Column) -> Column:
        word = or_null(F.get(F.split(strip(F.coalesce(s["title"], F.lit(""))), _U + r"\s+"), F.lit(0)))
        surname = F.when(F.size(s["authors"]) > 0, F.get(s["authors"], F.lit(0))["family"]).otherwise(F.coalesce(word, F.lit("anon")))
        return F.struct(
            base_ref_key(surname, year).alias("base_key"), raw.alias("raw_text"), year.alias("year"), s["title"].alias("title"), s["authors"].alias("authors"),
            s["journal"].alias("journal"), first_doi(rest).alias("doi"), or_null(F.regexp_extract(rest, _U + r"(?i)PMID[:#]?\s*(\d+)", 1)).alias("pmid"),
        )

    return let(let(clauses, _split_up), record)


def bibliographic_query(ref) -> Column:
    """First family, title, journal and year of a parsed reference, for a search."""
    r = col(ref)
    return F.concat_ws(" ", *(or_null(x) for x in (F.get(r["authors"], F.lit(0))["family"], r["title"], r["journal"], r["year"])))


def has_cjk_author(ref) -> Column:
    return F.exists(col(ref)["authors"], lambda a: is_cjk(a["family"]))
