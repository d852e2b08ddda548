import random
import struct
import zlib
from collections import defaultdict

import pytest

from millrace.llm import packing
from millrace.llm.bpe import vocabulary

from .data import TEXTS, empty_documents, needs_vocabularies, odd_documents

tokenizers = pytest.importorskip("tokenizers")


def unpacked(patterns):
    out = defaultdict(int)
    for pattern, count in patterns:
        for n in pattern:
            out[n] += count
    return dict(out)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_length_once_and_fit(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 2049) if k % 2 else rng.randrange(1, 200): rng.randrange(1, 200) for k in range(600)}
    patterns = packing.pack_histogram(histogram, 2048)
    assert unpacked(patterns) == histogram and all(sum(p) <= 2048 for p, _ in patterns)
    used = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in patterns) * 2048 <= 1.02 * used + 2048


def test_shortest_pack_first():
    assert sorted(packing.pack_histogram({7: 1, 5: 1, 3: 1, 2: 1}, 10)) == [((5, 3), 1), ((7, 2), 1)]
    assert packing.pack_histogram({}, 10) == []


def one_at_a_time(histogram, capacity):
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(packs, key=sum, default=None)
            if shortest is None or sum(shortest) + length > capacity:
                packs.append(shortest := [])
            shortest.append(length)
    return sorted(map(sum, packs))


def test_pieces_of_one_length_share_the_packs_they_open():
    assert packing.pack_histogram({100: 1000}, 2048) == [((100,) * 20, 50)]
    assert sorted(packing.pack_histogram({3: 7}, 10)) == [((3,), 1), ((3, 3, 3), 2)]
    rng = random.Random(4)
    for _ in range(40):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))}
        patterns = packing.pack_histogram(histogram, 64)
        assert unpacked(patterns) == histogram
        assert sorted(sum(p) for p, n in patterns for _ in range(n)) == one_at_a_time(histogram, 64)


@pytest.mark.parametrize("hot", [1, 40, 150, 400])
def test_little_padding_with_a_third_of_all_pieces_of_one_length(hot):
    rng = random.Random(hot)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, int(rng.lognormvariate(5.5, 0.8)) + 1)] += 1
    histogram[hot] += 10_000
    patterns = packing.pack_histogram(histogram, 2048)
    assert unpacked(patterns) == histogram
    used = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in patterns) * 2048 <= 1.02 * used + 2048


@pytest.mark.parametrize("histogram", [{100: 1_000_000}, {1: 1_000_000}, {20: 500_000, 50: 300_000}, {2: 1000, 1: 3000}, {2048: 7, 1: 50_000, 1999: 40}, {n: 2000 for n in range(1, 60)}])
def test_short_and_equal_lengths_waste_no_more_than_a_sequence_a_length(histogram):
    patterns = packing.pack_runs(histogram, 2048)
    alone = sum(-(-c // (2048 // n)) for n, c in histogram.items())  # the best for each length by itself
    assert sum(c for _, c in patterns) <= alone
    held = defaultdict(int)
    for runs, c in patterns:
        assert sum(n * t for n, t in runs) <= 2048
        for n, t in runs:
            held[n] += t * c
    assert held == histogram


def test_slots_cover_ranks_and_offsets_without_gaps():
    rows = packing.slots([((6, 2, 2), 3), ((6, 4), 2), ((10,), 5)])
    seen, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, count, first, offset in rows:
        for rank in range(lo, hi):
            ranks[length].append(rank)
            seen[first + (rank - lo) % count].append((offset + (rank - lo) // count * length, length))
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    assert sorted(seen) == list(range(10))
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length


@needs_vocabularies
def test_odd_rows(spark):
    path = vocabulary(packing.VOCABULARY)
    library = tokenizers.Tokenizer.from_file(path)
    rows = packing.packed(odd_documents(spark), path, capacity=256).collect()
    ids = {}
    for d, t in TEXTS:
        ids.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]][0]
        cut = own[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    assert pieces[4][0]["length"] == 1 and {d for d, _ in TEXTS} == set(pieces)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256


@needs_vocabularies
def test_empty_table(spark):
    assert packing.packed(empty_documents(spark), vocabulary(packing.VOCABULARY)).count() == 0
