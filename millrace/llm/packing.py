"""Packing by shortest-pack-first over the length histogram.

Documents are cut into full sequences and a rest. Only the histogram of piece lengths, at
most ``capacity`` numbers, reaches the driver. There lengths are placed longest first, each
into the shortest pack it fits, on counts of packing patterns: all packs of a pattern move
at once. A pattern's packs get a range of sequence numbers; each of its lengths gets a range
of ranks within that length's pieces. The ranges, a few for each length, are joined back to
the ranked pieces.

Results for odd input: a null text counts as empty; every document has at least the end id;
repeated rows are packed each; a null id stays null; an empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import BATCH_BYTES, map_texts
from .bpe import CACHE, vocabulary, word_bpe
from .common import documents, gapless_rank, written

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 1


#: What a pack holds, in the order it was placed: lengths and how often each follows.
Runs = tuple[tuple[int, int], ...]


def pack_runs(histogram: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Patterns and how many packs have each."""
    room: dict[int, list[tuple[Runs, int]]] = defaultdict(list)
    spaces: list[int] = []  # heap of negated spaces, the shortest pack first

    def put(space: int, pattern: Runs, count: int) -> None:
        if not room[space]:
            heapq.heappush(spaces, -space)
        room[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not room[-spaces[0]]:
                heapq.heappop(spaces)
            if not spaces or -spaces[0] < length:
                # one at a time, a new pack is the shortest until it is full of this length
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            space = -spaces[0]
            pattern, count = room[space].pop()
            moved = min(count, left)
            if count > moved:
                room[space].append((pattern, count - moved))
            *before, (last, times) = pattern
            longer = (*before, (last, times + 1)) if last == length else (*pattern, (length, 1))
            put(space - length, longer, moved)
            left -= moved
    return [p for patterns in room.values() for p in patterns]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The same with every length written out."""
    return [(tuple(n for n, times in runs for _ in range(times)), count) for runs, count in pack_runs(histogram, capacity)]


def slots_of_runs(patterns: list[tuple[Runs, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, lo, hi, count, first sequence, first offset``: pieces with a rank from lo to hi - 1
    of that length go to sequence first + (rank - lo) % count, as its (rank - lo) // count-th."""
    out, used, sequence = [], defaultdict(int), 0
    for runs, count in sorted(patterns, reverse=True):
        offset = 0
        for length, times in runs:
            lo = used[length]
            used[length] = hi = lo + count * times
            out.append((length, lo, hi, count, sequence, offset))
            offset += length * times
        sequence += count
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The same for patterns with every length written out."""
    return slots_of_runs([(tuple((n, len(list(run))) for n, run in groupby(p)), count) for p, count in patterns])


def pieces(docs: DataFrame, path: str, capacity: int, cache: int = CACHE, most: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document cut at multiples of the
    capacity. ``cache`` (words) and ``most`` (bytes of text at once) bound a worker's memory."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def setup():
        bpe = word_bpe(path, cache)
        last = np.array([END_ID], "<u4")

        def cut(ids: np.ndarray) -> list[tuple]:
            ids = np.concatenate([ids, last])
            n = len(ids)
            return [(s, min(capacity, n - s), zlib.crc32(ids[s : s + capacity]), n) for s in range(0, n, capacity)]

        return lambda texts: list(map(cut, bpe.encode_batch(texts)))

    return map_texts(texts, None, "start long, length long, ids_crc32 long, doc_tokens long", many=True, setup=setup, most=most)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, cache: int = CACHE, most: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, cache, most), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slots_of_runs(pack_runs(histogram, capacity))
    names = ("_length", "_lo", "_hi", "_count", "_first", "_offset")
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    ranked = gapless_rank(cut, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.xxhash64("doc_id", "start"), "_rank")
    # the patterns number a few times the capacity whatever the input, so the table is small
    found = ranked.join(F.broadcast(spark.createDataFrame(table)), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + nth % F.col("_count")).alias("sequence_id"),
        (F.col("_offset") + F.floor(nth / F.col("_count")) * F.col("length")).cast("long").alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), vocabulary(VOCABULARY))
