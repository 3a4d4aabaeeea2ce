"""Resharding by minimum-cost flow.

Rows lie in old shards, each in blocks by the size of its rows. From the blocks' row and byte counts and the
new shards' capacities a minimum-cost flow decides how many rows of each block go where, so that the fewest
bytes move; of a block the smallest rows go first. Only files that lose or gain rows are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.common import scratch_path, shuffle_partitions, written
from refloom.llm.flow import Network

#: A block holds the rows of a shard whose sizes have one binary logarithm, in SUBS equal ranges of sizes; a range of more than CELL_ROWS rows is dealt over cells.
SUBS = 64
CELL_ROWS = 1_000_000


@dataclass(frozen=True)
class Transfer:
    """Rows low to high (exclusive) of a block of an old shard go to a new shard, where slots from slot on are theirs."""

    old: int
    block: int
    low: int
    high: int
    shard: int
    slot: int


def plan_transfers(blocks: list[tuple[int, int, int, int]], shards: int) -> list[Transfer]:
    """Transfers that move the fewest bytes, from (old shard, block, rows, bytes) of every block.

    Every new shard has the same number of rows, at most one apart; the flow decides which have one more. A row
    costs its block's mean bytes to move and nothing to leave; what moves goes over one node between old and new
    shards, as all moves of a row cost alike. As counts fix what each old shard gives, but for one row, and a
    block's smallest rows move first, the choice is the best for the rows' own sizes too, but for that one row.
    """
    total = sum(n for _, _, n, _ in blocks)
    low, more = divmod(total, shards)
    source, sink, between, extra = 0, 1, 2, 3
    net = Network(4 + shards + len(blocks))
    net.add(extra, sink, more, 0)
    for j in range(shards):
        net.add(4 + j, sink, low, 0)
        net.add(4 + j, extra, 1, 0)
    into = [net.add(between, 4 + j, low + 1, 0) for j in range(shards)]
    stays, moves = [], []
    for k, (old, _, n, size) in enumerate(blocks):
        node = 4 + shards + k
        net.add(source, node, n, 0)
        stays.append(net.add(node, 4 + old, n, 0) if old < shards else None)
        moves.append(net.add(node, between, n, size // max(1, n)))
    if net.solve(source, sink) != total:
        raise RuntimeError("the capacities do not hold all rows")
    taken, out = [0] * shards, []

    def give(k: int, low: int, n: int, shard: int) -> None:
        out.append(Transfer(blocks[k][0], blocks[k][1], low, low + n, shard, taken[shard]))
        taken[shard] += n

    for k, arc in enumerate(stays):
        if arc is not None and net.flow(arc):
            give(k, net.flow(moves[k]), net.flow(arc), blocks[k][0])
    left, shard = [net.flow(arc) for arc in into], 0
    for k, arc in enumerate(moves):
        low, n = 0, net.flow(arc)
        while n:
            while not left[shard]:
                shard += 1
            part = min(n, left[shard])
            give(k, low, part, shard)
            low, n, left[shard] = low + part, n - part, left[shard] - part
    return out


def row_sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("row_id"), text.alias("content"), (F.octet_length(text).cast("long") + 8).alias("size"))


def lay_out(docs: DataFrame, old_shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as old_shards shards by a hash of the id, null ids anywhere: (row_id, content, size, sub, cell, rank) in folders old=/block=.

    rank counts the rows of a cell by size. Ranges of folders are dealt over tasks, so a folder of many bytes has several files.
    """
    seq = F.monotonically_increasing_id()  # tells rows apart that have nothing else to
    rows = row_sizes(docs, id_col, text_col).withColumn("seq", seq).withColumns({"old": F.pmod(F.xxhash64(F.coalesce("row_id", "seq")), F.lit(old_shards)).cast("int"), "block": F.floor(F.log2("size")).cast("int")})
    rows = rows.withColumn("sub", F.expr(f"int((size - shiftleft(1L, block)) * {SUBS} div shiftleft(1L, block))"))
    crowded = rows.groupBy("old", "block", "sub").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("n_cells")).where("n_cells > 1")  # at most one row for CELL_ROWS rows
    rows = rows.join(F.broadcast(crowded), ["old", "block", "sub"], "left").withColumn("cell", F.pmod(F.xxhash64("seq"), F.coalesce("n_cells", F.lit(1))).cast("int"))
    place = ["old", "block", "sub", "cell"]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *place)
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*place).orderBy("size", "seq")) - 1)
    ranked.select("row_id", "content", "size", "sub", "cell", F.col("rank").cast("long"), "old", "block").write.partitionBy("old", "block").parquet(path)


_LAID = "row_id long, content string, size long, sub int, cell int, rank long, old int, block int"
_RESHARDED = "row_id long, content string, size long, slot long, shard int"


def reshard(spark: SparkSession, old_path: str, new_path: str, shards: int) -> DataFrame:
    """Rows (row_id, content, size, shard, slot) over shards whose counts differ by one at most.

    Blocks that stay whole are read from the old files; the rows of all others are rewritten below new_path, by
    shard. Repeated rows and null ids are placed each; an empty table gives no rows. Texts are neither shuffled
    nor sorted for it: a row's rank in its block is its rank in its cell, which lies in the file, after the rows of
    the cells before, of which there are some thousands and one for CELL_ROWS rows.
    """
    laid = spark.read.schema(_LAID).parquet(old_path)
    cells = written(laid.groupBy("old", "block", "sub", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "cells")
    blocks = [tuple(r) for r in cells.groupBy("old", "block").agg(F.sum("n"), F.sum("bytes")).orderBy("old", "block").collect()]  # some 20 a shard
    transfers = plan_transfers(blocks, shards)
    counts = {(old, block): n for old, block, n, _ in blocks}
    columns = "old int, block int, low long, high long, shard int, slot long, whole boolean"
    plan_rows = [(t.old, t.block, t.low, t.high, t.shard, t.slot, t.shard == t.old and t.high - t.low == counts[t.old, t.block]) for t in transfers]
    plan = F.broadcast(spark.createDataFrame(plan_rows, columns))  # blocks and shards rows at most
    order = W.partitionBy("old", "block").orderBy("sub", "cell").rowsBetween(W.unboundedPreceding, -1)
    bases = F.broadcast(cells.select("old", "block", "sub", "cell", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")))
    affected = sorted({(t[0], t[1]) for t in plan_rows if not t[6]})
    touched = F.concat_ws("/", "old", "block").isin([f"{a}/{b}" for a, b in affected]) if affected else F.lit(False)

    def placed(rows: DataFrame) -> DataFrame:
        ranked = rows.join(bases, ["old", "block", "sub", "cell"]).withColumn("rank", F.col("base") + F.col("rank"))
        to = plan.withColumnRenamed("slot", "first")
        hit = (ranked["old"] == to["old"]) & (ranked["block"] == to["block"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
        return ranked.join(to, hit).select("row_id", "content", "size", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"), "shard")

    placed(laid.where(touched)).write.partitionBy("shard").parquet(new_path)
    moved = spark.read.schema(_RESHARDED).parquet(new_path)
    return moved.unionByName(placed(laid.where(~touched)))


def initial_and_new(docs: DataFrame, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay docs out over old_shards, then reshard; paths are scratch tables in the shared folder."""
    spark = docs.sparkSession
    old, new = scratch_path(spark, "old-shards"), scratch_path(spark, "new-shards")
    lay_out(docs, old_shards, old, id_col, text_col)
    return reshard(spark, old, new, shards).withColumnRenamed("row_id", id_col)
