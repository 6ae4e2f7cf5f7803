"""Removal of repeated passages: a multi-document Burrows-Wheeler construction by columns, over aligned blocks of strings.

A byte goes if a passage of ``LENGTH`` bytes around it also starts earlier in the collection. Equal passages contain
the same anchor (the smallest of their hashed substrings of ``ANCHOR`` bytes) at the same place, so texts are cut into
strings: the consecutive passages with one anchor, which are 168 bytes together at most. Strings with the same anchor
form a block, aligned at it, and a block is all that has to be sorted together.

Equal strings of a block are one string, the first; all passages of the others are repeats. The different strings of
a block are the documents of a column-wise construction (after Bauer, Cox and Rosone): from the last column to the
first, every string inserts one symbol per round. The symbols in the order of the round before are the block's
transform; counting them gives the new order, and range minima over the common prefixes give the new ones. Where
common prefixes reach ``LENGTH``, passages are equal, and all but the first are repeats. Symbols are kept by column in
a sequential file, of which a round reads one column.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import stored
from leafscore.llm.words import map_slices, mix64, per_text, slices, texts_of

LENGTH = 100
ANCHOR = 32
#: Places that an anchor can have in a passage.
PLACES = LENGTH - ANCHOR + 1
COLUMNS = PLACES - 1 + LENGTH
SLICE_BYTES = 256 << 10
#: A longer text is cut into overlapping parts.
PART_BYTES = 4 << 20
BLOCK_STRINGS = 20_000
#: Documents whose anchors are counted to find the frequent ones: one in so many. Only the layout depends on it.
SAMPLED = 64
FREQUENT = 64
#: At most so many anchors can be frequent: each has at least this share of the counted strings.
FREQUENT_SHARE = 1 / 20_000

_BASE = 0xA24BAED4963EE407
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps)
    return _TABLES["up"], _TABLES["down"]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start[k] .. start[k] + count[k] - 1``, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings of the texts: first passage, last passage, anchor (byte numbers), hash of the anchor, hash of the string.

    The anchor of a passage is its leftmost substring with the smallest hash; that depends on the passage alone.
    """
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = hashes & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - PLACES + width], low[PLACES - width:])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    passage = np.zeros(len(anchor) + 1, bool)  # whether one begins here within its text
    marks = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(marks, offsets[:-1][long], 1)
    np.add.at(marks, offsets[1:][long] - LENGTH + 1, -1)
    passage[:-1] = np.cumsum(marks)[: len(anchor)] > 0
    here = np.flatnonzero(passage)
    new = np.ones(len(here), bool)
    new[1:] = (anchor[here[1:]] != anchor[here[:-1]]) | (np.diff(here) > 1)
    heads = np.flatnonzero(new)
    first, last = here[heads], here[np.append(heads[1:], len(here)) - 1]
    at = anchor[first]
    whole = mix64((sums[last + LENGTH] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return first, last, at, hashes[at], whole


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of a batch with their bytes and bounds; of a very long text, parts that share all but one byte of a passage."""
    for part in slices(batch, SLICE_BYTES):
        texts = texts_of(part.column("text"))
        size = len(texts.data)
        for base in range(0, max(size, 1), PART_BYTES if len(texts) == 1 else max(size, 1)):
            data = texts.data[base: base + PART_BYTES + LENGTH - 1] if len(texts) == 1 else texts.data
            yield part, data, np.minimum(texts.offsets - base, len(data)).clip(0), base


def _strings(frequent: np.ndarray, only_counts: bool):
    """The Arrow function that gives ``(anchor, string, ord, place)`` of every string; of frequent anchors, every passage.

    ``place`` holds the first byte, the anchor's distance from it and the number of passages less one. Strings that
    come again in a batch are marked by a place under 0; they are repeats whatever the rest of the collection has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for part, data, offsets, base in _parts(batch):
                first, last, at, block, whole = cut(data, offsets)
                hot = np.isin(block, frequent) if len(frequent) else np.zeros(len(block), bool)
                if hot.any():
                    start = _ranges(first[hot], last[hot] - first[hot] + 1)
                    up, down = _powers(len(data))
                    sums = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
                    own = mix64((sums[start + LENGTH] - sums[start]) * down[start])
                    first, last, at = (np.concatenate([x[~hot], start]) for x in (first, last, at))
                    at[len(at) - len(start):] = start
                    # A passage alone is told apart from strings of the same anchor by the block it is dealt to.
                    block = np.concatenate([block[~hot], mix64(own + np.uint64(1))])
                    whole = np.concatenate([whole[~hot], own])
                doc = np.searchsorted(offsets, first, side="right") - 1
                ords = part.column("ord").to_numpy(zero_copy_only=False)[doc]
                place = (first - offsets[doc] + base) << 16 | (at - first) << 8 | (last - first)
                found.append((block.view(np.int64), whole.view(np.int64), ords, place))
            block, whole, ords, place = (np.concatenate([f[k] for f in found]) for k in range(4))
            order = np.lexsort((place, ords, whole, block))
            block, whole, ords, place = (x[order] for x in (block, whole, ords, place))
            again = np.zeros(len(block), bool)
            again[1:] = (block[1:] == block[:-1]) & (whole[1:] == whole[:-1])
            if only_counts:
                block = block[~again]
                yield pa.RecordBatch.from_arrays([pa.array(block)], names=["block"])
                continue
            block[again] = mix64(ords[again]).view(np.int64)
            place[again] = ~place[again]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, whole, ords, place)], names=["block", "string", "ord", "place"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by block, string and order: repeats (block null) and members of blocks with several strings."""
    rest = None

    def decide(block, whole, ords, place):
        known = place < 0
        same_block = np.zeros(len(block), bool)
        same_block[1:] = (block[1:] == block[:-1]) & ~known[1:] & ~known[:-1]
        same = same_block.copy()
        same[1:] &= whole[1:] == whole[:-1]
        heads = np.flatnonzero(~same_block)
        different = np.add.reduceat((~same).astype(np.int64), heads) if len(heads) else heads
        member = ~same & ~known & (np.repeat(different, np.diff(np.append(heads, len(block)))) > 1)
        out = same | known | member
        kept = np.where(known, ~place, place)[out]
        return pa.RecordBatch.from_arrays(
            [pa.array(ords[out]), pa.array(block[out], mask=~member[out]), pa.array(kept)], names=["ord", "block", "place"])

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "string", "ord", "place")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last block may go on
        if whole:
            yield decide(*(x[:whole] for x in now))
        rest = [x[whole:] for x in now]
    if rest is not None and len(rest[0]):
        yield decide(*rest)


def repeated_passages(block: np.ndarray, strings: np.ndarray, bounds: np.ndarray, lead: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which passages of the strings are repeats, by string and column: the construction over a few blocks at once.

    ``block`` is sorted. String ``k`` is ``strings[bounds[k]:bounds[k + 1]]`` and has its anchor ``lead[k]`` bytes from
    its start; of equal passages in a block, the one with the lowest ``rank`` stays.
    """
    n = len(block)
    flags = np.zeros((n, PLACES), bool)
    begin = PLACES - 1 - lead
    with tempfile.TemporaryFile() as file:
        table = np.zeros((COLUMNS, n), np.uint16)
        count = np.diff(bounds)
        table[_ranges(begin, count), np.repeat(np.arange(n), count)] = strings.astype(np.uint16) + 1  # 0 is the end mark
        file.write(table[::-1].tobytes())
        del table
        file.seek(0)
        group = np.cumsum(np.append(0, block[1:] != block[:-1])) if n else np.zeros(0, np.int64)
        order, common = np.arange(n), np.zeros(n, np.int64)
        for column in range(COLUMNS - 1, -1, -1):
            symbol = np.frombuffer(file.read(2 * n), np.uint16).astype(np.int64)
            key = group[order] * 257 + symbol[order]  # the transform of this round, by block
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            least = _range_minima(common, moved)
            equal = np.zeros(n, bool)
            equal[1:] = (key[1:] == key[:-1]) & (key[1:] % 257 > 0)
            common = np.where(equal, np.minimum(least + 1, LENGTH), 0)
            order = order[moved]
            if column < PLACES:
                heads = np.flatnonzero(common < LENGTH)
                size = np.diff(np.append(heads, n))
                if (size > 1).any():
                    own = rank[order]
                    first = np.repeat(np.minimum.reduceat(own, heads), size)
                    flags[order[own != first], column] = True
    return flags


def _range_minima(common: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Of each neighbouring pair in the new order, the least common prefix between their old places (0 where they fall)."""
    low, high = moved[:-1] + 1, moved[1:] + 1
    some = np.flatnonzero(high > low)
    out = np.zeros(len(moved), np.int64)
    if not len(some):
        return out
    low, high = low[some], high[some]
    level = np.frexp(high - low)[1] - 1
    table, found = common, np.zeros(len(some), np.int64)
    for k in range(int(level.max()) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        own = level == k
        found[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
    out[some + 1] = found
    return out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked strings: ``(block, ord, place, bytes)``."""
    for batch in batches:
        texts = texts_of(batch.column("text"))
        asked = batch.column("asked")
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        block, place = asked.flatten().flatten()
        at = place.to_numpy(zero_copy_only=False)
        start, count = texts.offsets[owner] + (at >> 16), (at & 0xFF) + LENGTH
        step = 1 << 12
        for k in range(0, len(at), step):
            c = count[k: k + step]
            data = texts.data[_ranges(start[k: k + step], c)]
            ends = np.concatenate([[0], np.cumsum(c)]).astype(np.int32)
            strings = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            ords = batch.column("ord").take(pa.array(owner[k: k + step]))
            yield pa.RecordBatch.from_arrays([block[k: k + step], ords, place[k: k + step], strings], names=["block", "ord", "place", "bytes"])


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches ``(ord, start, stop)`` from strings sorted by block, a bounded number of whole blocks at a time."""

    def work(table: pa.Table):
        table = table.combine_chunks()
        block, ords, place = (table[c].to_numpy() for c in ("block", "ord", "place"))
        column = table["bytes"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        _, ends, data = column.buffers()
        bounds = np.frombuffer(ends, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
        strings = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]]
        start, lead = place >> 16, place >> 8 & 0xFF
        rank = np.empty(len(block), np.int64)
        rank[np.lexsort((start + lead, ords))] = np.arange(len(block))
        flags = repeated_passages(block, strings, bounds - bounds[0], lead, rank)
        row, where = np.nonzero(flags)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (where[1:] != where[:-1] + 1)
        heads = np.flatnonzero(new)
        if len(heads):
            row, low, high = row[heads], where[heads], where[np.append(heads[1:], len(where)) - 1]
            base = start[row] + lead[row] - (PLACES - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ords[row], base + low, base + high + LENGTH)], names=["ord", "start", "stop"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_STRINGS:
            table = pa.Table.from_batches(held)
            block = table["block"].to_numpy()
            whole = int(np.searchsorted(block, block[-1]))
            if whole:
                yield from work(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), len(block) - whole
    if size:
        yield from work(pa.Table.from_batches(held))


def _remove(batch: pa.RecordBatch) -> list:
    texts = texts_of(batch.column("text"))
    spans = batch.column("spans")
    count = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
    packed = spans.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), count)
    marks = np.zeros(len(texts.data) + 1, np.int32)
    np.add.at(marks, texts.offsets[owner] + (packed >> 32), 1)
    np.add.at(marks, texts.offsets[owner] + (packed & 0xFFFFFFFF), -1)
    gone = np.cumsum(marks[:-1]) > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    first[edges] = gone[edges]
    removed = per_text(texts, gone)
    left = texts.data[~gone].tobytes()
    sizes = np.diff(texts.offsets)
    ends = np.concatenate([[0], np.cumsum(sizes - removed)])
    kept = [left[ends[k]: ends[k + 1]] for k in range(len(texts))]
    digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
    return [sizes, removed, per_text(texts, first), digests, pa.array(kept, pa.binary())]


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``ord``, a number in the order of the documents, and the same with one row for each number.

    The number is doc_id itself where it tells all rows apart. Otherwise rows are numbered by doc_id (null last) and a
    hash of the text; rows that repeat both share a number.
    """
    doubtful = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if not doubtful.limit(1).count():
        known = docs.withColumn("ord", F.col("doc_id").cast("bigint"))
        return known, known
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    # The numbers are written: range bounds are sampled, and must not be drawn again.
    order = stored(
        hashed.select("doc_id", "text_hash").distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("ord", F.monotonically_increasing_id()), "document-order")
    order = order.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    on = hashed["doc_id"].eqNullSafe(order["_id"]) & (hashed["text_hash"] == order["_hash"])
    known = hashed.join(order, on).select(*docs.columns, "ord")
    return known, known.dropDuplicates(["ord"])


def remove_repeats(docs: DataFrame, texts_too: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row of ``docs (doc_id, text)``.

    Texts are UTF-8 bytes. A byte is removed if it lies in a passage of 100 bytes that also starts earlier: in a
    document with a smaller doc_id, or earlier in its own. Passages overlap, do not cross documents and are judged on
    the input. ``kept`` are the bytes that stay (only with ``texts_too``), ``n_spans`` the maximal stretches removed.

    Null and empty texts have no bytes, texts under 100 bytes lose none. Documents go by doc_id, null last, then by a
    hash of their text; rows that repeat both are one document and get the same result each. An empty table gives an
    empty result. Strings and anchors are compared by 64-bit hashes for being equal as a whole, passages within a block
    by their bytes.

    Skew: copies of a string shrink in the task that reads them. Anchors that very many different strings share (the
    edges of a common passage) are found by counting one document in 64; their passages are dealt one by one, which
    leaves nothing to sort together. So no task holds a hot group.
    """
    texts, single = numbered(docs.select("doc_id", "text"))
    kind = "block long, string long, ord long, place long"
    rows = single.where(F.octet_length("text") >= LENGTH).select("ord", "text")
    sample = rows.where(F.pmod(F.xxhash64("ord", F.lit("sample")), F.lit(SAMPLED)) == 0)
    counts = stored(
        sample.mapInArrow(_strings(np.zeros(0, np.uint64), True), "block long").groupBy("block").count(), "anchor-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    bound = max(FREQUENT, total * FREQUENT_SHARE)
    frequent = np.array([r["block"] for r in counts.where(F.col("count") >= bound).select("block").collect()], np.int64).view(np.uint64)
    strings = rows.mapInArrow(_strings(frequent, False), kind)
    sorted_strings = strings.repartition("block").sortWithinPartitions("block", "string", "ord", "place")
    found = stored(sorted_strings.mapInArrow(_compare, "ord long, block long, place long"), "string-matches")
    asked = found.where("block IS NOT NULL").groupBy("ord").agg(F.collect_list(F.struct("block", "place")).alias("asked"))
    fetched = rows.join(asked, "ord").mapInArrow(_fetch, "block long, ord long, place long, bytes binary")
    built = fetched.repartition("block").sortWithinPartitions("block").mapInArrow(_construct, "ord long, start long, stop long")
    start = F.shiftright("place", 16)
    whole = found.where("block IS NULL").select("ord", start.alias("start"), (start + F.col("place").bitwiseAND(0xFF) + LENGTH).alias("stop"))
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("stop"))
    spans = whole.unionByName(built).groupBy("ord").agg(F.collect_list(packed).alias("spans"))
    joined = texts.join(spans, "ord", "left").select("doc_id", "text", "spans")
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too
    size = 5 if texts_too else 4
    work = lambda part: _remove(part)[:size]
    rows = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<bigint>")))
    return map_slices(rows, ["doc_id", "spans"], added, lambda: work).drop("spans")
