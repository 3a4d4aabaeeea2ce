"""Exact duplicates by Patricia-trie owners.

Full byte strings are inserted into compressed radix tries whose terminal nodes hold the owner so far and
the number of rows. Each map task first runs a small trie over its own rows, so copies collapse before they
are shuffled. Texts are then partitioned by byte length and content hash, and each partition has one trie.
Its rows arrive in byte order, so every subtree left of the newest key is closed: when the trie outgrows its
budget, the closed subtrees are spilled downstream as results and freed.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.common import lean, shuffle_partitions, small_batches, spread_join

#: Bytes of strings that a trie may hold before closed subtrees are spilled.
TRIE_BYTES = 16 << 20

#: Deletes what the comparison ignores: space and 0x09 to 0x0D.
_SPACE = " \t\n\x0b\x0c\r"


class Trie:
    """A compressed radix tree over bytes. A node is [label, children by first byte, value or None]."""

    def __init__(self):
        self.root, self.held = [b"", {}, None], 0

    def insert(self, key: bytes, value, merge) -> None:
        """Give the terminal node of key the value, merged with the one it has."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = value if node[2] is None else merge(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.held += len(key) - at
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = len(os.path.commonprefix([label, key[at : at + len(label)]]))
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same

    def _walk(self, prefix: bytes, node):
        """Take apart a subtree: pairs of key and value in byte order."""
        todo = [(prefix, node)]
        while todo:
            prefix, (label, children, value) = todo.pop()
            self.held -= len(label)
            key = prefix + label
            if value is not None:
                yield key, value
            todo += [(key, children[k]) for k in sorted(children, reverse=True)]

    def pop_all(self):
        root, self.root = self.root, [b"", {}, None]
        yield from self._walk(b"", root)

    def pop_before(self, key: bytes):
        """Take out what lies before key in byte order, in that order."""
        node, at, prefix = self.root, 0, b""
        while True:
            if node[2] is not None and at < len(key):
                yield prefix, node[2]
                node[2] = None
            for first in sorted(k for k in node[1] if at < len(key) and k < key[at]):
                yield from self._walk(prefix, node[1].pop(first))
            child = node[1].get(key[at]) if at < len(key) else None
            if child is None:
                return
            if not key.startswith(child[0], at):
                if child[0] < key[at : at + len(child[0])]:
                    yield from self._walk(prefix, node[1].pop(key[at]))
                return
            node, at, prefix = child, at + len(child[0]), prefix + child[0]


def better(a, b):
    """Of two owners (code points, id, rows, digest) the one that stays: most code points, then the smallest id; a null id comes last."""
    best = min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    return best[0], best[1], a[2] + b[2], best[3]


_FIELDS = ("content", "n_chars", "owner", "n", "digest")
_OWNERS = "content binary, n_chars long, owner long, n long, digest binary"


def _owners(budget: int, ordered: bool):
    """Rows of _OWNERS to those of the tries' terminal nodes. Without order the whole trie is spilled at the budget."""

    @lean
    def run(batches):
        trie = Trie()

        def spill(pairs):
            todo = list(pairs)
            for at in range(0, len(todo), 1000):
                part = todo[at : at + 1000]
                values = list(zip(*(v for _, v in part), strict=True))
                yield pa.RecordBatch.from_pydict(dict(zip(_FIELDS, (pa.array([k for k, _ in part], pa.binary()), *(pa.array(x, pa.int64()) for x in values[:3]), pa.array(values[3], pa.binary())), strict=True)))

        for b in batches:
            for content, *value in zip(*(b.column(n).to_pylist() for n in _FIELDS), strict=True):
                if trie.held > budget:
                    yield from spill(trie.pop_before(content) if ordered else trie.pop_all())
                trie.insert(content, tuple(value), better)
        yield from spill(trie.pop_all())

    return run


def normalised(column):
    return F.translate(F.coalesce(column, F.lit("")), _SPACE, "")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_digest) of every row.

    Texts are equal when equal without white space. The row of a group with the most code points in its own
    text stays, then that with the smallest id; null ids lose to all others. A null text counts as empty, and
    all empty texts are one group. Rows repeated with the same id and text are one group whose kept flag all of
    them share. Other columns are ignored, an empty table gives an empty result. Equal texts meet in the map
    tasks first, so a text that fills a third of the table reaches its trie once for each task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("owner"), F.length(text).cast("long").alias("n_chars"), normalised(F.col(text_col)).cast("binary").alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    local = rows.withColumn("n", F.lit(1).cast("long")).select(*_FIELDS).mapInArrow(_owners(trie_bytes, ordered=False), _OWNERS)
    dealt = local.withColumn("n_bytes", F.length("content")).repartition(shuffle_partitions(spark), "n_bytes", "digest")
    owners = dealt.sortWithinPartitions("content").select(*_FIELDS).mapInArrow(_owners(trie_bytes, ordered=True), _OWNERS)
    owners = owners.select("digest", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    out = spread_join(rows.select(F.col("owner").alias("row_id"), "digest"), owners, "digest")
    return out.select(F.col("row_id").alias(id_col), "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_digest"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are; of rows with equal id and equal text one stays."""
    groups = duplicate_groups(docs, id_col, text_col)
    kept = groups.where("kept").select(F.col(id_col).alias("kept_id"), F.col("text_digest").alias("digest")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("kept_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))
    stay = whole.alias("w").join(kept.alias("k"), F.col("w.kept_id").eqNullSafe(F.col("k.kept_id")) & (F.col("w.digest") == F.col("k.digest")), "left_semi")
    # the longest text of an id's copies, as the groups' owners are chosen
    longest = W.partitionBy("kept_id", "digest").orderBy(F.length(F.col("row").getField(text_col)).desc_nulls_last())
    return stay.withColumn("copy", F.row_number().over(longest)).where("copy = 1").select("row.*")
