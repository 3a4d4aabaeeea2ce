"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Shingles are put in one global order, rare ones first; two
sets that are similar enough share a shingle in their prefixes under it. Documents with the same set size and
the same prefix form a group, and only groups are matched by the shingles of their prefixes. Pairs of groups are
filtered by size and by the places of the shingle they share; those left are expanded to pairs of their classes
(members with equal sets), which are verified on whole sets.

As components are asked for, not pairs, classes that are already connected need no further check: each list
of groups that share a shingle is first verified against its best group alone, and only pairs across what is
still unconnected are verified one by one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.common import lean, shuffle_partitions, small_batches, spread_join, whole_text, written
from refloom.llm.components import free_shuffles, merged
from refloom.llm.textkernel import mix, words

SHINGLE = 5
THRESHOLD = Fraction(3, 4)
#: Cells of the table of shingle counts that orders them: 2^16 to 2^22, four bytes each, whatever the corpus holds.
LEAST_CELLS_LOG2, MOST_CELLS_LOG2 = 16, 22
FLUSH = 1 << 19
#: In each round groups meet so many groups at most of a list's largest component, if that has CROWD; what they leave apart is compared exactly after them.
ASKED, CROWD = (16, 64), 4
#: Groups of a list that are paired as one block.
BLOCK = 256

_U = np.uint64


def shingle_sets(column: pa.Array):
    """(first row, number of rows, bounds, hashes): the sorted set of each row between its bounds.

    Words are compared with A-Z in lower case. A text of fewer words than SHINGLE is one shingle of them all;
    one without words has the empty set.
    """
    for at, n, w in words(column, lower=True):
        bounds = w.bounds(n)
        first, h = w.phrases(SHINGLE)
        doc = w.doc[first]
        short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
        if len(short):
            whole = []
            for i in short:
                x = _U(np.diff(bounds)[i])
                for k in w.hashes[bounds[i] : bounds[i + 1]]:
                    x = mix(np.asarray([x ^ k], _U))[0]
                whole.append(x)
            doc, h = np.concatenate([doc, short]), np.concatenate([h, np.asarray(whole, _U)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(h):
            each = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
            doc, h = doc[each], h[each]
        yield at, n, np.searchsorted(doc, np.arange(n + 1)), h


def prefix_length(n: int | np.ndarray, threshold: Fraction = THRESHOLD):
    """Shingles of a set of n of which one at least is shared with any similar set."""
    return n - (-(-n * threshold.numerator // threshold.denominator)) + 1


def index_length(n, threshold: Fraction = THRESHOLD):
    """The same with sets of at least n shingles alone."""
    up, down = 2 * threshold.numerator, threshold.numerator + threshold.denominator
    return n - (-(-n * up // down)) + 1


def similar(a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> bool:
    """Do two sorted sets have a Jaccard similarity of at least threshold."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * threshold.denominator >= (len(a) + len(b) - both) * threshold.numerator


def _counts(cells_log2: int, slices_log2: int):
    """How many sets of the task hold a shingle of each cell, as slices of the table."""

    @lean
    def run(batches):
        table = np.zeros(1 << cells_log2, np.int64)
        kept, n = [], 0
        for b in batches:
            for _, _, _, h in shingle_sets(b.column("content")):
                kept.append((h >> _U(64 - cells_log2)).astype(np.int64))
                n += len(h)
                if n > FLUSH:
                    table += np.bincount(np.concatenate(kept), minlength=len(table))
                    kept, n = [], 0
        if kept:
            table += np.bincount(np.concatenate(kept), minlength=len(table))
        size = len(table) >> slices_log2
        parts = [table[k * size : (k + 1) * size].astype("<u4").tobytes() for k in range(1 << slices_log2)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "counts": pa.array(parts, pa.binary())})

    return run


def _summed(group):
    import pandas as pd

    total = np.zeros(len(group["counts"].iloc[0]) // 4, np.uint64)
    for x in group["counts"]:
        total += np.frombuffer(x, "<u4")
    return pd.DataFrame({"slice": [group["slice"].iloc[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})


def count_table(rows: DataFrame, cells_log2: int) -> np.ndarray:
    """Counts of all shingles of the corpus by the cell of their hash. A fixed number of cells, so it may go to the driver."""
    slices_log2 = min(6, cells_log2)
    parts = rows.select("content").mapInArrow(_counts(cells_log2, slices_log2), "slice int, counts binary")
    whole = parts.groupBy("slice").applyInPandas(_summed, "slice int, counts binary").orderBy("slice").toArrow()
    table = np.zeros(1 << cells_log2, "<u4")
    size = len(table) >> slices_log2
    for k, x in zip(whole.column("slice").to_pylist(), whole.column("counts"), strict=True):
        table[k * size : (k + 1) * size] = np.frombuffer(x.as_buffer(), "<u4")
    return table


_POSTED = "bucket int, tokens binary, groups binary, sizes binary, places binary, ids binary, sets binary"
_BLOBS = ("tokens", "groups", "sizes", "places", "ids", "sets")


def _posted(shared, cells_log2: int, buckets: int):
    """Postings and members as blobs by bucket.

    A posting is (32 bits of the shingle beyond the bucket, group, size, place in the prefix); a group posts once in a task. A member is (group, size, row id, hash of the whole set).
    """

    def flush(post, members):
        token, group, size, place = (np.concatenate(x) for x in zip(*post, strict=True))
        g2, s2, ids, sets = (np.concatenate(x) for x in zip(*members, strict=True))
        bucket, home = (token % _U(buckets)).astype(np.int64), (g2 % _U(buckets)).astype(np.int64)
        token = (token // _U(buckets)).astype("<u4")
        order, order2 = np.argsort(bucket, kind="stable"), np.argsort(home, kind="stable")
        out = {k: [] for k in ("bucket", *_BLOBS)}
        for key, rows, columns in ((bucket, order, {"tokens": token, "groups": group, "sizes": size, "places": place}), (home, order2, {"groups": g2, "sizes": s2, "ids": ids, "sets": sets})):
            key = key[rows]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
                out["bucket"].append(int(key[a]))
                for name in _BLOBS:
                    out[name].append(columns[name][rows[a:b]].tobytes() if name in columns else None)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})

    @lean
    def run(batches):
        table = np.frombuffer(shared.value, "<u4")
        seen: set[int] = set()
        post, members, n = [], [], 0
        for b in batches:
            row_ids = b.column("row_id").to_numpy()
            for at, rows, bounds, h in shingle_sets(b.column("content")):
                size = np.diff(bounds)
                doc = np.repeat(np.arange(rows), size)
                count = table[(h >> _U(64 - cells_log2)).astype(np.int64)]
                order = np.lexsort((h, count, doc))
                ordered = h[order]
                place = np.arange(len(h)) - bounds[:-1][doc]
                taken = place < prefix_length(size)[doc]
                tokens, of, place = ordered[taken], doc[taken], place[taken]
                weighted = mix(tokens ^ (place.astype(_U) * _U(0x9E3779B97F4A7C15)))
                group, whole = np.zeros(rows, _U), np.zeros(rows, _U)
                np.add.at(group, of, weighted)
                np.add.at(whole, doc, mix(h))
                group, whole = mix(group + size.astype(_U)), mix(whole + size.astype(_U))
                some = size > 0
                members.append((group[some], size[some].astype("<u4"), row_ids[at : at + rows][some], whole[some]))
                new = np.zeros(rows, bool)
                for i in np.flatnonzero(some):
                    if int(group[i]) not in seen:
                        new[i] = True
                        seen.add(int(group[i]))
                if len(seen) > FLUSH:
                    seen.clear()
                keep = new[of]
                tokens, of, place = tokens[keep], of[keep], place[keep]
                post.append((tokens, group[of], size[of].astype("<u4"), place.astype("<u4")))
                n += len(tokens)
                if n > FLUSH:
                    yield flush(post, members)
                    post, members, n = [], [], 0
        if members:
            yield flush(post, members)

    return run


_MATCHED = "list long, grp long, size int, place int, score float, row_id long, whole long"


@lean
def _matched(batches):
    """Per bucket: lists of groups that share a shingle, and the bucket's members. Rows with a list are list entries."""
    key, post, members = None, [], []
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("bucket", *_BLOBS)]
        for bucket, tokens, groups, sizes, places, ids, sets in zip(*columns, strict=True):
            if bucket != key:
                yield from _match(post, members)
                key, post, members = bucket, [], []
            g, s = np.frombuffer(groups, "<u8"), np.frombuffer(sizes, "<u4")
            if tokens is None:
                members.append((g, s, np.frombuffer(ids, "<i8"), np.frombuffer(sets, "<u8")))
            else:
                post.append((np.frombuffer(tokens, "<u4"), g, s, np.frombuffer(places, "<u4")))
    yield from _match(post, members)


def _match(post, members):
    if members:
        g, s, ids, sets = (np.concatenate(x) for x in zip(*members, strict=True))
        for at in range(0, len(g), 20_000):
            k = slice(at, at + 20_000)
            n = len(g[k])
            yield pa.RecordBatch.from_pydict({"list": pa.nulls(n, pa.int64()), "grp": pa.array(g[k].view("<i8")), "size": pa.array(s[k].astype("<i4")), "place": pa.nulls(n, pa.int32()), "score": pa.nulls(n, pa.float32()), "row_id": pa.array(ids[k]), "whole": pa.array(sets[k].view("<i8"))})
    if not post:
        return
    token, group, size, place = (np.concatenate(x) for x in zip(*post, strict=True))
    order = np.lexsort((group, token))
    token, group, size, place = token[order], group[order], size[order], place[order]
    each = np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1]))
    token, group, size, place = token[each], group[each], size[each], place[each]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(start, len(token)))
    early = place < index_length(size.astype(np.int64))
    shared = (length > 1) & (np.add.reduceat(early.astype(np.int64), start) > 0)
    # a group's score is the share of its postings here that others have too
    names, of = np.unique(group, return_inverse=True)
    score = np.bincount(of, weights=np.repeat(shared, length)) / np.bincount(of)
    keep = np.repeat(shared, length)
    group, size, place, score, length = group[keep], size[keep], place[keep], score[of[keep]].astype(np.float32), length[shared]
    if not len(group):
        return
    start = np.cumsum(length) - length
    # of shingles that the same groups share one list is enough: the first in the order, which stands first in all of them
    name = mix(np.add.reduceat(mix(group), start) + length.astype(_U))
    order = np.lexsort((np.add.reduceat(place.astype(np.int64), start), name))
    chosen = np.zeros(len(start), bool)
    chosen[order[np.append(True, name[order][1:] != name[order][:-1])]] = True
    keep = np.repeat(chosen, length)
    # the place tells lists of the same groups from different buckets apart
    name = np.repeat(mix(name + place[start].astype(_U)), length)[keep].view("<i8")
    group, size, place, score = group[keep].view("<i8"), size[keep].astype("<i4"), place[keep].astype("<i4"), score[keep]
    for at in range(0, len(name), 20_000):
        k = slice(at, at + 20_000)
        n = len(name[k])
        yield pa.RecordBatch.from_pydict({"list": pa.array(name[k]), "grp": pa.array(group[k]), "size": pa.array(size[k]), "place": pa.array(place[k]), "score": pa.array(score[k]), "row_id": pa.nulls(n, pa.int64()), "whole": pa.nulls(n, pa.int64())})


def _verified(threshold: Fraction):
    @lean
    def run(batches):
        for b in batches:
            sets = {}
            for side in ("text_a", "text_b"):
                sets[side] = [h[bounds[i] : bounds[i + 1]] for _, n, bounds, h in shingle_sets(b.column(side)) for i in range(n)]
            good = [similar(x, y, threshold) for x, y in zip(sets["text_a"], sets["text_b"], strict=True)]
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "linked": pa.array(good, pa.bool_())})

    return run


def _fits(a: str, b: str, threshold: Fraction) -> F.Column:
    """Can two sets be similar whose first common shingle stands at these places of sets of these sizes."""
    up, down = threshold.numerator, threshold.numerator + threshold.denominator
    left = F.least(F.col(f"size{a}") - F.col(f"place{a}"), F.col(f"size{b}") - F.col(f"place{b}"))
    return left * down >= (F.col(f"size{a}") + F.col(f"size{b}")) * up


class _Linker:
    """Expands pairs of groups to pairs of classes, verifies those, and keeps what was looked at and what hangs together."""

    def __init__(self, classes: DataFrame, texts: DataFrame, threshold: Fraction):
        self.classes, self.texts, self.threshold = classes.select("grp", "node"), texts, threshold
        self.done: DataFrame | None = None
        self.components: DataFrame | None = None

    def rooted(self, nodes: DataFrame) -> DataFrame:
        """nodes with the component of each."""
        if self.components is None:
            return nodes.withColumn("component", F.col("node"))
        return nodes.join(self.components, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def expanded(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes that are not connected, from distinct pairs (grp, other) of groups."""
        members = self.rooted(self.classes)
        one = members.select("grp", F.col("node").alias("x"), F.col("component").alias("root_x"))
        two = members.select(F.col("grp").alias("other"), F.col("node").alias("y"), F.col("component").alias("root_y"))
        apart = pairs.join(one, "grp").join(two, "other").where((F.col("x") != F.col("y")) & (F.col("root_x") != F.col("root_y")))
        return apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def met_by(self, pivots: DataFrame, *of: str) -> DataFrame:
        """Pairs (a, b) of the classes of a group, or of a component in it, with one class (pivot) of another group: (grp, component, pivot)."""
        pairs = pivots.join(self.rooted(self.classes), list(of)).where(F.col("node") != F.col("pivot"))
        return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))

    def verify(self, pairs: DataFrame) -> None:
        pairs = pairs.select("a", "b").distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        one = self.texts.select(F.col("node").alias("b"), F.col("content").alias("text_b"))
        two = self.texts.select(F.col("node").alias("a"), F.col("content").alias("text_a"))
        checked = written(pairs.join(one, "b").join(two, "a").mapInArrow(_verified(self.threshold), "a long, b long, linked boolean"), "verified")
        self.done = checked.select("a", "b") if self.done is None else self.done.unionByName(checked.select("a", "b"))
        self.components = merged(self.components, checked.where("linked").select("a", "b"))
        free_shuffles(self.done)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Rows with a Jaccard similarity of at least threshold are linked; component_id is the smallest id that links
    reach, itself included. Null and wordless texts have no shingles and are linked with nothing; rows with a null
    id are linked with nothing either and get a null component. Repeated rows share their component; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), whole_text(text_col).alias("content"))
    named = rows.where(F.col("row_id").isNotNull())

    cells_log2 = max(LEAST_CELLS_LOG2, min(MOST_CELLS_LOG2, max(1, parts - 1).bit_length() + 14))
    shared = spark.sparkContext.broadcast(count_table(named, cells_log2).tobytes())
    posted = named.mapInArrow(_posted(shared, cells_log2, parts), _POSTED)
    matched = written(posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_matched, _MATCHED), "matched")
    free_shuffles(matched)

    # classes: members with equal sets; a class is named by its smallest row id
    members = matched.where(F.col("list").isNull())
    classes = written(members.groupBy("grp", "size", "whole").agg(F.min("row_id").alias("node")), "classes")
    groups = classes.groupBy("grp").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    inside = groups.where("n > 1").select(F.xxhash64(F.col("grp"), F.lit("group")).alias("list"), "grp", "size", F.lit(0).alias("place"), F.lit(1.0).cast("float").alias("score"))
    entries = written(matched.where(F.col("list").isNotNull()).select("list", "grp", "size", "place", "score").unionByName(inside), "entries")
    needed = classes.join(entries.select("grp").distinct(), "grp", "left_semi").select("node")
    texts = written(named.join(needed, F.col("row_id") == F.col("node"), "left_semi").groupBy(F.col("row_id").alias("node")).agg(F.first("content").alias("content")), "texts")
    free_shuffles(texts)
    linker = _Linker(classes, texts, threshold)

    def labelled(turn: int) -> DataFrame:
        """Entries of lists once for each component of their groups' classes, with their number and one of them; connected lists are left out. At turn 0 nothing is connected and groups are whole."""
        roots = linker.rooted(linker.classes).groupBy("grp", *(["component"] if turn else [])).agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("one"))
        found = entries.join(roots, "grp")
        if not turn:
            return found
        apart = found.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list")
        return written(found.join(apart, "list"), "labelled")

    def as_pivot(struct: str) -> list:
        return [F.col(f"{struct}.{c}").alias(f"{c}_p") for c in ("size", "place")] + [F.col(f"{struct}.one").alias("pivot")]

    # a class of each list's best group meets the classes of all its groups that fit
    found = labelled(0)
    best = found.groupBy("list").agg(F.max(F.struct("score", "grp", "size", "place", "one")).alias("best")).select("list", *as_pivot("best"))
    met = found.join(best, "list").where(_fits("", "_p", threshold)).select("grp", "pivot").distinct()
    linker.verify(linker.met_by(met, "grp"))

    # what is still apart from the largest component of its lists meets some of that component's classes, others in each list and round
    for turn, most in enumerate(ASKED, 1):
        found = labelled(turn)
        sizes = found.groupBy("list", "component").agg(F.sum("n").alias("n"))
        main = sizes.groupBy("list").agg(F.max(F.struct("n", "component")).alias("m")).where(F.col("m.n") >= CROWD).select("list", F.col("m.component").alias("component"))
        crowd = found.join(main, ["list", "component"]).withColumn("no", F.row_number().over(W.partitionBy("list").orderBy(F.xxhash64("list", "grp", F.lit(turn)), "grp")))
        pivots = crowd.where(F.col("no") <= most).select("list", F.col("component").alias("main"), F.col("size").alias("size_p"), F.col("place").alias("place_p"), F.col("one").alias("pivot"))
        asked = found.join(pivots, "list").where((F.col("component") != F.col("main")) & _fits("", "_p", threshold)).select("grp", "component", "pivot").distinct()
        asked = asked.withColumn("n", F.row_number().over(W.partitionBy("grp", "component").orderBy(F.xxhash64("grp", "pivot")))).where(F.col("n") <= most)
        linker.verify(linker.met_by(asked.select("grp", "component", "pivot"), "grp", "component"))

    # the rest, exactly: every pair of groups that may be similar and has classes that are not connected; a long list is cut into blocks, each pair of which is a key of its own
    found = labelled(len(ASKED) + 1)
    long = found.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = found.join(long, "list").withColumn("block", F.pmod(F.xxhash64("grp", "component"), F.col("blocks")).cast("int"))
    columns = ("grp", "size", "place", "component")
    left = cut.select("list", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = cut.select("list", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"), F.col("block").alias("high"), *(F.col(c).alias(f"{c}_b") for c in columns))
    across = left.join(right, ["list", "low", "high"]).where((F.col("component_a") != F.col("component_b")) & _fits("_a", "_b", threshold))
    rest = across.select(F.least("grp_a", "grp_b").alias("grp"), F.greatest("grp_a", "grp_b").alias("other")).distinct()
    linker.verify(linker.expanded(rest))

    by_class = linker.rooted(classes).select(F.struct("grp", "size", "whole").alias("class"), F.col("component").alias("component_id"))
    linked = spread_join(members.select("row_id", "size", F.struct("grp", "size", "whole").alias("class")), by_class, "class").select("row_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    bare = rows.where(F.col("row_id").isNull() | ~F.col("content").rlike("[^\\x20\\x09-\\x0D]"))
    alone = bare.mapInArrow(_sizes, "row_id long, n_shingles long").withColumn("component_id", F.col("row_id"))
    return linked.unionByName(alone).withColumnRenamed("row_id", id_col)


@lean
def _sizes(batches):
    for b in batches:
        n = [int(x) for _, _, bounds, _ in shingle_sets(b.column("content")) for x in np.diff(bounds)]
        yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "n_shingles": pa.array(n, pa.int64())})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of docs whose id is their component's, all columns as they are; rows with a null id stay. An id names one document."""
    found = similar_components(docs, id_col, text_col, threshold)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("id")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"))
    return whole.join(gone, "id", "left_anti").select("row.*")
