"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafscore.llm.common import small_side, stored
from leafscore.llm.tokens import VOCABULARY, encode
from leafscore.llm.words import slices

CAPACITY = 2048


def token_pieces(
    docs: DataFrame, keep: list[str], capacity: int = CAPACITY, end_id: int = 0, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Token ids of every whole text in pieces: ``keep`` columns, piece, start, length, ids (little-endian 32-bit).

    A document is its ids and ``end_id``. Only one longer than ``capacity`` is cut: all pieces but the first are full.
    Null and empty texts are a single ``end_id``.
    """
    schema = T.StructType([docs.schema[k] for k in keep] + T.StructType.fromDDL(
        "piece int, start long, length long, ids binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, piece, start, length, ids = [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    found = np.append(encode(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(found) % capacity or capacity, len(found), capacity), len(found)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(found[a:b].tobytes())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in keep), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest capacity that still fits.

    Bins of one capacity are interchangeable, so they are kept as runs (first number, count), not one by one.
    """

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int) -> None:
        at = self.leaves + room
        self.any[at] = bool(self.runs.get(room))
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs.setdefault(room, []).append((first, count))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room)
        return run

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` among the open bins."""
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over document lengths: rows (length, first rank, ranks, first bin, offset).

    Documents of one length are interchangeable. Taken one by one, best fit puts the next into the tightest open bin
    that holds it, and goes on filling that bin while it still fits, since what is left is tighter than all others.
    So a run of equal bins takes them in layers, and the plan has a row per layer however many documents there are.
    """
    bins, rows, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, (first, count) = capacity, (opened, -(-left // (capacity // length)))
                opened += count
            else:
                first, count = bins.pop(room)
            layers = room // length
            full = min(count, left // layers)
            for k in range(layers if full else 0):
                rows.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * layers
            bins.push(room - layers * length, first, full)
            first, count = first + full, count - full
            if count and left:  # fewer documents than would fill the next bin
                for k in range(left):
                    rows.append((length, rank, 1, first, capacity - room + k * length))
                    rank += 1
                bins.push(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            bins.push(room, first, count)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with a ``length`` of 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    The packing is best-fit decreasing over all pieces. Only the number of pieces per length, at most ``capacity``
    rows, reaches the driver, which plans whole runs of equal lengths; the plan is joined back by length and rank.
    Ranks are numbered per length and input split and moved by the counts of the splits before, so no length, however
    frequent, is ordered in one task. Equal rows are packed one by one; an empty table gives an empty result.
    """
    items = stored(
        pieces.select(F.struct("*").alias("piece_row"), F.col("length").alias("size"), F.spark_partition_id().alias("split"),
                      F.monotonically_increasing_id().alias("item")), "pack-pieces")
    counts = items.groupBy("size", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).toLocalIterator()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = small_side(stored(items.sparkSession.createDataFrame(
        plan_bins(histogram, capacity), "of_size long, first_rank long, ranks long, first_bin long, offset long"), "pack-plan"), 500_000)
    within = Window.partitionBy("size", "split").orderBy("item")
    ranked = items.withColumn("within", F.row_number().over(within) - 1).join(
        counts.select("size", "split", "before"), ["size", "split"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(plan, (F.col("size") == F.col("of_size")) & (F.col("rank") >= F.col("first_rank"))
                         & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    return placed.select(
        "piece_row.*", (F.col("first_bin") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
