import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscore.llm.packing import OpenBins, pack, plan_bins, token_pieces
from leafscore.llm.tokens import encode


def best_fit(lengths, capacity):
    """Number of bins of best-fit decreasing, one document at a time."""
    rooms, bins = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bins += room == capacity
        bisect.insort(rooms, room - length)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 500))]
    seen, bins = set(), defaultdict(list)
    for length, rank, ranks, first, offset in plan_bins(Counter(lengths), capacity):
        for k in range(ranks):
            assert (length, rank + k) not in seen
            seen.add((length, rank + k))
            bins[first + k].append((offset, length))
    assert len(seen) == len(lengths)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit(lengths, capacity)


def test_plan_stays_small_for_any_number_of_documents():
    assert len(plan_bins({k: 10**9 + k for k in range(1, 2049)})) < 10_000


def test_tightest_capacity():
    bins = OpenBins(2048)
    for room in (7, 100, 2047):
        bins.push(room, 0, 1)
    assert [bins.tightest(k) for k in (1, 7, 8, 100, 101, 2047, 2048)] == [7, 7, 100, 100, 2047, 2047, None]
    bins.pop(100)
    assert bins.tightest(8) == 2047


def test_documents_are_whole_in_gapless_sequences(make, odd_rows):
    docs = make(odd_rows + [(k, "some words " * (k % 50)) for k in range(100, 400)])
    pieces = token_pieces(docs, ["doc_id"], capacity=64).withColumn("crc", F.crc32("ids"))
    found = pack(pieces, 64).collect()
    assert len(found) == pieces.count()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.crc == zlib.crc32(bytes(r.ids)) and len(bytes(r.ids)) == 4 * r.length
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == best_fit([r.length for r in found], 64)
    long = sorted(by_doc[6], key=lambda r: r.piece)
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in long])
    assert ids.tolist() == [*encode(odd_rows[9][1]).tolist(), 0]
    assert [r.piece for r in long] == list(range(len(long))) and all(r.length == 64 for r in long[1:])
    assert [bytes(r.ids) for r in by_doc[1]] == [b"\0\0\0\0"]


def test_empty_table_and_bad_lengths(make, spark):
    assert pack(token_pieces(make([]), ["doc_id"])).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(0,), (5,)], "length long"), 10).count()
