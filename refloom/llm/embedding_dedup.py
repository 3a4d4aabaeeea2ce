"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random directions; the quantised projections of a table make a bucket.
Vectors that share a bucket in some table are compared exactly, in double precision, once: in the first
table in which they meet. A bucket's task returns counts and a spanning forest, never its pairs; a large
bucket is cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import shuffle_partitions, small_batches, written
from refloom.llm.components import components

COSINE = 0.95
#: Tables, projections in a table and width of a cell: pairs at the threshold meet in some table with probability 0.994.
TABLES, PROJECTIONS, WIDTH, SEED = 44, 16, 2.0, 20240229
#: Rows of a bucket that are compared as one block.
BLOCK = 1024


def projections(dimensions: int, tables: int = TABLES, per_table: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dimensions, tables * per_table)), rng.uniform(0, width, tables * per_table)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, per_table: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """One 64-bit key for each vector and table."""
    directions, shifts = projections(unit.shape[1], tables, per_table, width)
    cells = np.floor((unit @ directions + shifts) / width).astype(np.int64).reshape(len(unit), tables, per_table).astype(np.uint64)
    key = np.zeros((len(unit), tables), np.uint64)
    for k in range(per_table):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: str) -> F.Column:
    """Is a vector neither null nor empty nor zero, and all its components finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _packed(batches):
    """Vectors as bytes of their own floating-point type."""
    for b in batches:
        raw = []
        for x in b.column("vector"):
            v = x.values.to_numpy(zero_copy_only=False)
            raw.append((v + v.dtype.type(0)).tobytes())  # + 0: no negative zero
        yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "raw": pa.array(raw, pa.binary())})


def unit_vectors(raw: list[bytes], dtype: str) -> np.ndarray:
    """In double precision; scaled by the largest component first, so that squares stay finite."""
    x = np.frombuffer(b"".join(raw), dtype).astype(np.float64).reshape(len(raw), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(dtype: str):
    def run(batches):
        for b in batches:
            raws, nodes = b.column("raw").to_pylist(), b.column("node").to_numpy()
            sizes = np.asarray([len(r) for r in raws])
            for size in np.unique(sizes):  # vectors of different lengths never meet
                at = np.flatnonzero(sizes == size)
                keys = bucket_keys(unit_vectors([raws[i] for i in at], dtype))
                yield pa.RecordBatch.from_pydict({"tab": pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), "bucket": pa.array(keys.reshape(-1) ^ np.int64(size)), "node": pa.array(np.repeat(nodes[at], TABLES))})

    return run


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one fewer than nodes in each component."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def near_pairs(unit: np.ndarray, groups: list[tuple[int, int, int]], threshold: float):
    """Index pairs of rows with a cosine of at least threshold, in chunks. A group (start, middle, end) has rows start
    to end: all its pairs count if middle is end, else those of a row before middle with one from it on."""
    small = [g for g in groups if g[2] - g[0] <= 16 and g[1] == g[2]]
    starts, sizes = np.asarray([g[0] for g in small], np.int64), np.asarray([g[2] - g[0] for g in small], np.int64)
    for size in np.unique(sizes) if len(small) else ():
        one, two = np.triu_indices(int(size), 1)
        of = starts[sizes == size]
        for at in range(0, len(of), max(1, 32768 // len(one))) if len(one) else ():
            part = of[at : at + max(1, 32768 // len(one)), None]
            i, j = (part + one).ravel(), (part + two).ravel()
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            yield i[near], j[near]
    for start, middle, end in groups:
        if end - start <= 16 and middle == end:
            continue
        second = start if middle == end else middle
        for at in range(start, middle, 256):
            i, j = np.nonzero(unit[at : min(at + 256, middle)] @ unit[second:end].T >= threshold)
            i, j = i + at, j + second
            if middle == end:
                i, j = i[j > i], j[j > i]
            for part in range(0, len(i), 65536):
                yield i[part : part + 65536], j[part : part + 65536]


def _links(rows: pd.DataFrame, dtype: str, threshold: float) -> pd.DataFrame:
    """What whole groups of rows, sorted by group, give: weights gained by node, and a forest."""
    key = rows[["tab", "bucket", "low", "high"]].to_numpy()
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    end = np.append(start[1:], len(rows))
    raw, node, weight, table, block = rows["raw"].tolist(), rows["node"].to_numpy(), rows["weight"].to_numpy(), rows["tab"].to_numpy(), rows["block"].to_numpy()
    middle = [b if low == high else a + int((block[a:b] == low).sum()) for a, b, low, high in zip(start, end, rows["low"].to_numpy()[start], rows["high"].to_numpy()[start], strict=True)]
    gained: list[np.ndarray] = []
    forest: list[np.ndarray] = []
    widths = np.asarray([len(r) for r in raw])[start]
    for width in np.unique(widths):
        mine = widths == width
        groups, at = [], 0
        picked = np.concatenate([np.arange(a, b) for a, b in zip(start[mine], end[mine], strict=True)])
        for a, m, b in zip(start[mine], np.asarray(middle)[mine], end[mine], strict=True):
            groups.append((at, at + int(m - a), at + int(b - a)))
            at += int(b - a)
        unit = unit_vectors([raw[i] for i in picked], dtype)
        for i, j in near_pairs(unit, groups, threshold):
            if not len(i):
                continue
            # a pair is counted in the first table in which it meets
            used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys, tab = bucket_keys(unit[used]), table[picked[i]]
            same = keys[where[: len(i)]] == keys[where[len(i) :]]
            first = same.argmax(axis=1) >= tab
            a, b = picked[i[first]], picked[j[first]]
            gained += [np.stack([node[a], weight[b]]), np.stack([node[b], weight[a]])]
            forest.append(np.stack(_roots(node[a], node[b])))
    if not gained:
        return pd.DataFrame({"a": [], "b": [], "gain": []})
    nodes, where = np.unique(np.concatenate([g[0] for g in gained]), return_inverse=True)
    gain = np.bincount(where, weights=np.concatenate([g[1] for g in gained])).astype(np.int64)
    a, b = _roots(*np.concatenate(forest, axis=1))
    return pd.DataFrame({"a": np.concatenate([nodes, a]), "b": np.concatenate([np.full(len(nodes), -1), b]), "gain": np.concatenate([gain, np.zeros(len(a), np.int64)]), "edge": np.append(np.zeros(len(nodes), bool), np.ones(len(a), bool))})


def _linked(dtype: str, threshold: float):
    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.to_pandas() if rest is None else pd.concat([rest, b.to_pandas()], ignore_index=True)
            last = rows.iloc[-1]
            open_at = int(np.argmax(((rows["tab"] == last["tab"]) & (rows["bucket"] == last["bucket"]) & (rows["low"] == last["low"]) & (rows["high"] == last["high"])).to_numpy()))
            rest = rows.iloc[open_at:]
            if open_at:
                yield _rows(_links(rows.iloc[:open_at], dtype, threshold))
        if rest is not None and len(rest):
            yield _rows(_links(rest.reset_index(drop=True), dtype, threshold))

    return run


def _rows(links: pd.DataFrame) -> pa.RecordBatch:
    if not len(links):
        links = pd.DataFrame({"a": [], "b": [], "gain": [], "edge": []})
    return pa.RecordBatch.from_pydict({"a": pa.array(links["a"], pa.int64()), "b": pa.array(links["b"], pa.int64()), "gain": pa.array(links["gain"], pa.int64()), "edge": pa.array(links["edge"], pa.bool_())})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors with a cosine of at least threshold are linked; n_links counts the other rows linked to a row
    directly, component_id is the smallest id that links reach. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; so do vectors of different lengths with each other, and rows
    with a null id, which get their own null component. Equal vectors are one node with a weight. Rows repeated
    with the same id and vector count as separate rows. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark, mb=2)
    parts = shuffle_partitions(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    good = rows.where(usable("vector") & F.col("vec_id").isNotNull())
    packed = good.mapInArrow(_packed, "vec_id long, raw binary").withColumn("digest", F.unhex(F.sha2("raw", 256)))
    nodes = written(packed.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("raw").alias("raw")), "vectors")
    hashed = written(nodes.repartition(parts, "node").mapInArrow(_hashed(dtype), "tab int, bucket long, node long"), "buckets")
    # buckets with the same members in several tables are compared in the first of them: what meets in one meets there
    marks = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in range(2)]
    counts = hashed.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") > 1)
    counts = counts.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("tab", "bucket")).alias("at")).select("at.tab", "at.bucket", "n")
    met = hashed.join(counts, ["tab", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # one for all but large buckets
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = met.join(nodes.select("node", "weight", "raw"), "node").select("tab", "bucket", "low", "high", "block", "node", "weight", "raw")
    dealt = met.repartition(parts, "tab", "bucket", "low", "high").sortWithinPartitions("tab", "bucket", "low", "high", "block")
    links = written(dealt.mapInArrow(_linked(dtype, threshold), "a long, b long, gain long, edge boolean"), "links")
    comps = components(links.where("edge").select("a", "b"))
    gains = links.where("not edge").groupBy("a").agg(F.sum("gain").alias("gain"))
    by_node = nodes.select("digest", "node", "weight").join(gains, F.col("node") == F.col("a"), "left").join(comps, "node", "left")
    by_node = by_node.select("digest", (F.col("weight") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = packed.select("vec_id", "digest").join(by_node, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable("vector") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
