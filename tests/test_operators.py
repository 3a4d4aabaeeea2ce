import pytest
from pyspark.errors import PySparkException

from refloom.operators import audit, fields, library, refs


def test_field_depth_and_nesting(spark):
    steps = [(1, i, s) for i, s in enumerate([-1, 1, 1, -1, -1, -1, 1])]
    rows = spark.createDataFrame(steps, "doc int, seq int, step int")
    assert [r.depth for r in fields.field_depth(rows, ["doc"], "seq", "step").orderBy("seq").collect()] == [0, 1, 2, 1, 0, 0, 1]
    matched = fields.matched_fields(rows, ["doc"], "seq", "step")
    assert [(r.start, r.end) for r in matched.orderBy("start").collect()] == [(1, 4), (2, 3), (6, None)]
    assert fields.nested_count(matched, ["doc"]).first().nested == 1


def test_ids(spark):
    ids = spark.createDataFrame([(1, x) for x in ["IjW2SbGH", "cit3", "cit3", None, ""]] + [(2, "cit0"), (2, "cit146"), (3, "x")], "doc int, citation_id string")
    assert {r.doc: r.next_id for r in fields.next_id(ids, ["doc"]).collect()} == {1: 4, 2: 147, 3: 0}
    stats = {r.doc: (r.n, r.n_unique, r.n_duplicated, r.max_numeric) for r in fields.citation_id_stats(ids, ["doc"]).collect()}
    assert stats == {1: (3, 2, 1, 3), 2: (2, 2, 0, 146), 3: (1, 1, 0, -1)}


def test_renumber_and_relink(spark):
    cites = spark.createDataFrame([(1, 0, "cit0", "a"), (1, 1, "cit1", "b"), (1, 2, "cit0", "a")], "doc int, seq int, citation_id string, display string")
    chosen = spark.createDataFrame([(1, "a")], "doc int, display string")
    assert [r.new_id for r in fields.renumber(cites, chosen, ["doc"], ["seq"], "s").orderBy("seq").collect()] == ["s0", "cit1", "s1"]
    assert [r.new_id for r in fields.renumber(cites, chosen.limit(0), ["doc"], ["seq"], "s").orderBy("seq").collect()] == ["cit0", "cit1", "cit0"]
    uris = spark.createDataFrame([(1, ["http://x/items/OLD", "http://x/items/B"]), (2, ["http://x/items/B"])], "no int, uris array<string>")
    new = spark.createDataFrame([("OLD", "NEW")], "old string, new string")
    assert {r.no: (r.new_uris, r.touched) for r in fields.relink(uris, new, ["no"]).collect()} == {1: (["http://x/items/NEW", "http://x/items/B"], True), 2: (["http://x/items/B"], False)}


def test_numbered_block_and_keys(spark):
    texts = ["Intro", "[1] Smith J. A. B. 2007.", " ", "[2] Smith J. C. D. 2007.", "Notes", "[3] Late L. E. F. 2001."]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, para int, text string")
    assert [r.para for r in refs.numbered_block(rows, ["doc"]).orderBy("para").collect()] == [1, 3]
    assert [(r.para, r.ref_key) for r in refs.extract_references(rows, ["doc"]).orderBy("para").collect()] == [(1, "smith2007"), (3, "smith2007_2")]


def test_library(spark):
    items = spark.createDataFrame([("K2", 1, "A long enough title about emotion", "10.1/a", None), ("K1", 0, "Other", "doi:10.1/A", None), ("K3", 2, None, "10.1/c", None), ("K4", 3, "No doi", None, None), ("K5", 4, "x", "10.1/e", "gone")], "key string, ord int, title string, doi string, error string")
    index, failures, duplicates = library.library_index(items)
    assert [(r.doi_norm, r.itemKey) for r in index.collect()] == [("10.1/a", "K1")]
    assert {r.key for r in failures.collect()} == {"K3", "K5"} and duplicates.first()["keys"] == ["K1", "K2"]
    records = spark.createDataFrame([("r1", "a LONG enough title about emotion", None), ("r2", "On: a long enough title about emotion, revisited", ""), ("r3", "nothing alike", "10.1/a"), ("r4", "zzz", None), ("r5", None, None)], "ref_key string, title string, doi string")
    got = {r.ref_key: (r.status, r.item_key) for r in library.dedup_check(records, items.where("title is not null")).collect()}
    assert got["r1"] == ("exact", "K2") and got["r2"][0] == "probable" and got["r3"] == ("exact", "K1") and got["r4"][0] == "none" and got["r5"][0] == "none"


def test_import_plan_rejects_unknown_actions(spark):
    items = spark.createDataFrame([("K1", "T", "10.1/a")], "key string, title string, doi string")
    plan = "ref_key string, action string, title string, doi string, item_key string"
    good = spark.createDataFrame([("a", "import", "t", None, None), ("b", "reuse", None, None, None), ("c", "skip", None, None, None), ("d", "import", "q", "10.9/q", None)], plan)
    assert {r.ref_key: (r.outcome, r.target_key) for r in library.plan_imports(good, items).collect()} == {"a": ("precheck_reused", "K1"), "b": ("warning", None), "c": ("skipped", None), "d": ("create", None)}
    with pytest.raises(PySparkException, match="unknown import action"):
        library.plan_imports(spark.createDataFrame([("a", "delete", None, None, None)], plan), items).collect()


def test_apply_library_is_all_or_nothing(spark):
    mapping = spark.createDataFrame([("a", "K1", "10.1/a", "X", "2000")], "ref_key string, item_key string, doi string, first_author string, year string")
    items = "key string, title string, doi string, first_author string, year string"
    row = library.apply_library(mapping, spark.createDataFrame([("K1", "T", "10.1/b", "", "2001")], items)).first()
    assert (row.first_author, row.year, row.doi, row.doi_mismatch) == ("X", "2001", "10.1/a", True)
    with pytest.raises(PySparkException, match="unable to read library item"):
        library.apply_library(mapping, spark.createDataFrame([("K9", "T", "", "", "")], items)).collect()


def test_column_audit(spark):
    cells = [(0, 0, "Age (W)", False), (0, 1, "8", False), (0, 2, "12–16", False), (1, 0, "References", False), (1, 1, "(doi:10.1000/aa)", False), (1, 2, "10–14", False), (1, 3, "", True)]
    rows = spark.createDataFrame(cells, "col int, row int, text string, has_field boolean")
    got = {r.col: (r.doi_cells, r.number_cells, r.with_field, len(r.doi_samples)) for r in audit.column_audit(rows, ["col"], samples=2).collect()}
    assert got == {0: (0, 2, 0, 0), 1: (1, 1, 1, 1)}
