import heapq
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import sharding

from .data import TEXTS, empty_documents, odd_documents


def loads(classes, ranges, shards):
    mean = {k: total / n for k, n, total in classes}
    out = [0.0] * shards
    for klass, lo, hi, shard in ranges:
        out[shard] += (hi - lo) * mean[klass]
    return out


def test_levelling_equals_the_heap_one_by_one():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted({rng.randrange(8, 5000) for _ in range(rng.randrange(1, 40))})
        classes = [(s, n := rng.choice([1, 2, 5, 30, 400]), s * n) for s in sizes]
        ranges = sharding.schedule(classes, 6)
        heap = [0.0] * 6
        for s, n, _ in sorted(classes, reverse=True):
            for _ in range(n):
                heapq.heapreplace(heap, heap[0] + s)
        got = sorted(loads(classes, ranges, 6))
        assert max(abs(a - b) for a, b in zip(got, sorted(heap))) <= 1e-6 * sum(heap) + max(sizes) * 1e-9 + 1e-6
        cover = defaultdict(list)
        for klass, lo, hi, _ in ranges:
            cover[klass] += range(lo, hi)
        assert all(sorted(cover[k]) == list(range(n)) for k, n, _ in classes)


def test_size_classes(spark):
    sizes = [8, 4095, 4096, 4097, 8191, 8192, 8195, 8196, 123_456_789, 2**40 + 5]
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(F.col("s")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[:8] == [8, 4095, 4096, 4096, 8190, 8192, 8192, 8196]
    assert all(0 <= (s - c) / s < 1 / 2048 for s, c in zip(sizes, got)) and got[-1] == 2**40


def test_odd_rows(spark):
    rows = sharding.sharded(odd_documents(spark), 3).collect()
    assert len(rows) == len(TEXTS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    shard_of = defaultdict(set)
    texts = defaultdict(set)
    for d, t in TEXTS:
        texts[d].add(t or "")
    for r in rows:
        if r["doc_id"] is not None:
            shard_of[next(iter(texts[r["doc_id"]]))].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_nearly_equal(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 97 * F.col("id") % 53 + 1).cast("int")).alias("text"))
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    sums = [r["s"] for r in sharding.sharded(docs, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 200


def test_empty_table(spark):
    assert sharding.sharded(empty_documents(spark)).count() == 0
