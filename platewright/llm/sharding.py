"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay in one shard. Groups, largest first, go to the
least-loaded shard, taken from a heap; ties go to the lower number. That schedule is exact at every size of the
input: the driver gets one row per different group size, with the number of groups of that size, and deals a
class of equal sizes at once. Loads that are below a level take as many as bring them to it, by
arithmetic; what is left, fewer than there are shards, goes through the heap. D different sizes need at least
D (D + 1) / 2 bytes of text, so D is bounded by the square root of twice the input: 14 million at 100 TB, and about
the length of the longest text in practice.

Which groups of a class go to which shard is settled by their number in it. Groups are numbered in cells of about
``cell_rows`` groups, told by a hash, so no task holds a whole class; a hot group's rows meet their shard in a join whose
hot keys Spark splits.

Slots are gapless without a global sort: rows are counted by (shard, cell), a running sum over the
at most ``n_shards * cells`` counts gives each cell its first slot, and rows are numbered in cells.

Edge cases: a null text counts as the empty text, size 1, and groups with it. Repeated rows (even
with one id) each get their own slot. An empty table gives an empty result. Other columns of the
input are ignored, so their names can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.llm.common import named, table, text_of, written


def _below(loads: list[int], size: int, count: int) -> list[int]:
    """How many of the first ``count`` items of one size each load takes before any load is above the highest level that they all reach."""
    taken = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  items that begin below the level
    low, high = min(loads), min(loads) + (count + 1) * size
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(taken(mid)) <= count else (low, mid)
    return taken(low)


def longest_first(classes: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """For (size, how many items of it), largest first: how many of them go to each shard, each item to the least-loaded one."""
    loads, out = [0] * n_shards, []
    for size, count in sorted(classes, reverse=True):
        given = _below(loads, size, count) if count > 2 * n_shards else [0] * n_shards
        heap = [(load + n * size, shard) for shard, (load, n) in enumerate(zip(loads, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            given[shard] += 1
        loads = [load + n * size for load, n in zip(loads, given, strict=True)]
        out.append((size, given))
    return out


def shard_by_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, cells: int = 1024, cell_rows: int = 100_000, broadcast_classes: int = 100_000) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = written(
        docs.select(
            named(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    classes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]  # a row per different size
    plan, count = [], dict(classes)
    for size, given in longest_first(classes, n_shards):
        ends, total = [], 0
        for n in given:
            total += n
            ends.append(total)
        plan.append((size, 1 + count[size] // cell_rows, ends))
    plan = spark.createDataFrame(plan, "bytes long, n_cells int, ends array<long>")
    plan = F.broadcast(plan) if len(classes) <= broadcast_classes else plan  # some 100 bytes each
    celled = groups.join(plan, "bytes").withColumn("cell", F.pmod(F.xxhash64("digest"), F.col("n_cells")))
    firsts = celled.groupBy("bytes", "cell").agg(F.count("*").alias("n"))
    firsts = firsts.select("bytes", "cell", (F.sum("n").over(Window.partitionBy("bytes").orderBy("cell")) - F.col("n")).alias("first"))
    numbered = celled.withColumn("number", F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("digest"))).join(firsts, ["bytes", "cell"])
    # shard k has the numbers from ends[k - 1] to ends[k] of its class
    shards = numbered.select("digest", F.size(F.filter("ends", lambda end: end < F.col("first") + F.col("number"))).alias("shard"))
    put = rows.join(written(shards, "shard-of"), "digest").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "digest"), F.lit(cells)).cast("int").alias("cell"))
    put = written(put, "shard-put")
    counts = put.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32"))
    return put.withColumn("number", number).join(firsts, ["shard", "cell"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard"), (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_by_size(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
