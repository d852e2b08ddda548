"""Sharding by longest-processing-time scheduling of groups that stay together.

Rows with equal texts form a group; a group's size is the sum of its rows'. Groups, largest
first, go to the least loaded shard through a heap. The driver sees only a histogram: sizes
below 4,096 are their own class, larger ones are cut to eleven bits after the leading one, so
there are at most some 60,000 classes for any input and a class's groups differ by less than
1 in 2,048. A class's groups are scheduled with their mean size; where a class holds many,
all but the last round is dealt by levelling, which is what the heap would do one by one.
Each class's share of a shard is a range of ranks, joined back to the ranked groups.

Results for odd input: a null text counts as empty for grouping and checksums and adds no
bytes; a null id stays null and ranks first; repeated rows get a slot each; an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, gapless_rank, sized, written

SHARDS, ROW_BYTES, EXACT_BELOW, BITS = 24, 8, 4096, 11


def size_class(size: Column) -> Column:
    """The size with all but its leading twelve bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - (BITS + 1), F.lit(0))
    return F.when(size < EXACT_BELOW, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop))


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """From ``class, groups, bytes`` to ``class, lo, hi, shard``: ranges of ranks within a class."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for klass, groups, total in sorted(classes, reverse=True):
        mean = total / groups
        share = [0] * shards
        rest = groups
        if groups > 4 * shards:
            loads = sorted(heap)
            level, among = 0.0, 0
            for among in range(1, shards + 1):
                level = (sum(load for load, _ in loads[:among]) + total) / among
                if among == shards or level <= loads[among][0]:
                    break
            heap = []
            for load, s in loads:
                n = min(rest, max(0, int((level - load) / mean))) if load < level else 0
                share[s], rest = n, rest - n
                heap.append((load + n * mean, s))
        heapq.heapify(heap)
        for _ in range(rest):
            load, s = heapq.heappop(heap)
            share[s] += 1
            heapq.heappush(heap, (load + mean, s))
        lo = 0
        for s, n in enumerate(share):
            if n:
                out.append((klass, lo, lo + n, s))
                lo += n
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: sizes nearly equal (``bytes``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        # two texts with one key would only be kept together needlessly
        F.xxhash64(text).alias("key"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("class", size_class(F.col("bytes")).cast("long")), "shard-groups")
    classes = [(r["class"], r["g"], r["b"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("g"), F.sum("bytes").alias("b")).collect()]
    ranges = schedule(classes, shards)
    names = ("_class", "_lo", "_hi", "shard")
    table = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in ranges], pa.int64()) for i, n in enumerate(names)}))
    table = F.broadcast(table) if len(ranges) <= 500_000 else table
    ranked = gapless_rank(groups, ["class"], [F.col("bytes").desc(), F.col("key")], F.col("key"), "_rank")
    placed = ranked.join(table, (F.col("class") == F.col("_class")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = written(placed.select(F.col("key").alias("_key"), F.col("shard").cast("int").alias("shard")), "shard-placed")
    rows = written(rows.join(sized(placed), F.col("key") == F.col("_key")).drop("_key"), "shard-dealt")
    slotted = gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("key")], F.xxhash64("doc_id", "key"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
