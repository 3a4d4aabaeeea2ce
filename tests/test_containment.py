import random

from refloom.operators import library, resolve


def _titles(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc中文") for _ in range(rng.choice([40, 90, 200]))) for _ in range(12)]
    cut = [t[i : i + rng.choice([1, 2, 3, 7, 15, 16, 30, 31, 32, 60])] for t in base for i in (0, 5, rng.randrange(len(t)))]
    return base + cut + ["a" * n for n in (30, 31, 80)] + ["", *base[:3]]


def test_contained_pairs_meet_all(spark):
    a, b = sorted(set(_titles(1)) | set(_titles(2)[:8])), sorted(set(_titles(1)[6:30]) | set(_titles(3)) | {"a" * 50})
    refs, items = (spark.createDataFrame(list(enumerate(x)), "id int, norm string") for x in (a, b))
    every = {(i, k) for i, x in enumerate(a) for k, y in enumerate(b) if x and y and (x in y or y in x)}
    found = [(r.ref, r.item) for r in library.contained_pairs(refs, items).collect()]
    assert len(every) > 50 and len(found) == len(set(found)) and set(found) == every
    long = items.where("length(norm) > 30")
    assert library.contained_pairs(refs.where("length(norm) > 30"), long).count() == sum(len(a[i]) > 30 and len(b[k]) > 30 for i, k in every)
    assert library.contained_pairs(refs.limit(0), items).count() == 0 and library.contained_pairs(refs, items.limit(0)).count() == 0


def test_dedup_check_with_copies(spark):
    titles, own = [t or None for t in _titles(4)], _titles(5) + _titles(4)[::3]
    items = [(f"K{k}", k, t, None if k % 3 else f"10.1/{k}") for k, t in enumerate(titles + titles[:9])]
    records = [(f"r{k}", t, "" if k % 7 else f"doi:10.1/{k}") for k, t in enumerate(own)]

    def expected(title, doi):
        doi = doi.removeprefix("doi:")
        same = [k for k, _, t, _ in items if t and t == title] or [k for k, _, _, d in items if doi and d == doi]
        near = [k for k, _, t, _ in items if t and title and t != title and (t in title or title in t)]
        return ("exact", same[0]) if same else ("probable", near[-1]) if near else ("none", None)

    found = library.dedup_check(spark.createDataFrame(records, "ref_key string, title string, doi string"), spark.createDataFrame(items, "key string, ord int, title string, doi string"))
    got = {r.ref_key: (r.status, r.item_key) for r in found.collect()}
    assert got == {r: expected(t, d) for r, t, d in records}
    assert {s for s, _ in got.values()} == {"exact", "probable", "none"}


CSL = "struct<type:string,title:string,author:array<struct<family:string,given:string,literal:string>>,container_title:string,volume:string,issue:string,page:string,publisher:string,DOI:string,issued:array<array<int>>>"


def test_later_stages_are_asked_for_what_is_open(spark):
    from refloom.functions import refs as R

    def csl(family, year, title, doi=None):
        return ("article-journal", title, [(family, "J", None)], None, None, None, None, None, doi, [[year]])

    raw = [("done", "[1] Smith J. Human emotion. Nature. 2007. doi:10.1000/a."), ("open", "[2] Brown K. Cell growth rates. Nature. 2009."), ("none", "[3] Green L. Plant roots. Nature. 2011."), ("late", "[4] White M. River beds. Nature. 2012.")]
    refs = spark.createDataFrame(raw, "ref_key string, raw string").select("ref_key", R.parse_reference("raw").alias("parsed"))

    def stage(*rows):
        return spark.createDataFrame(list(rows), f"ref_key string, provider string, csl {CSL}, rank int")

    stages = [
        stage(("done", "doi", csl("X", 1900, "Other", "10.1000/A"), 0), ("open", "doi", csl("Nobody", 2009, "Other"), 0)),
        stage(("done", "search", csl("Smith", 2007, "Human emotion"), 0), ("open", "search", csl("Brown", 2009, "Cell growth rates"), 1), ("open", "search", csl("Brown", 1900, "Cell growth rates"), 0)),
        stage(("open", "last", csl("Brown", 2009, "Cell growth rates"), 0), ("late", "last", csl("White", 2012, "River beds"), 0)),
    ]
    got = {r.ref_key: (r.provider, r.confidence, [c.ord for c in r.candidates or []], r.resolve_error) for r in resolve.resolve_staged(refs, stages).collect()}
    assert got == {"done": ("doi", 1.0, [0], False), "open": ("search", 1.0, [0, 1000, 1001], False), "late": ("last", 1.0, [2000], False), "none": (None, 0.0, [], True)}
