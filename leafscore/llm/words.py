"""Array helpers for Arrow batches of texts: slices of bounded size, words with 64-bit hashes, word n-grams.

They work on the UTF-8 bytes of many texts at once. White space is ASCII here (space, tab to carriage return), so
words can be cut on bytes. Texts are handled whole; a slice holds at least one text, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
HASH_BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


class Texts(NamedTuple):
    """Bytes of some texts one after the other, and where each begins (one more entry than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words in order: first byte, end, text number, hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The bytes behind a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return Texts(raw, offsets - offsets[0])


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have at most ``limit`` bytes, or one row if it has more."""
    ends = texts_of(batch.column("text")).offsets[1:]
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(
    df: DataFrame, keep: list[str], added: str, work: Callable[[], Callable[[pa.RecordBatch], list]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df``'s columns ``keep`` plus the ``added`` ones (DDL) that ``work()`` computes for each slice of its ``text``.

    ``work`` is called once per task and returns the function for a slice, which gives one array per added column.
    """
    more = T.StructType.fromDDL(added).fields
    schema = T.StructType([df.schema[k] for k in keep] + more)
    names = schema.names
    kinds = [{T.LongType: np.int64, T.DoubleType: np.float64, T.BooleanType: np.bool_}.get(type(f.dataType)) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            for part in slices(batch, limit):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a.astype(k)) for a, k in zip(compute(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + arrays, names=names)

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, HASH_BLOCK)
        up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        if size > 4 * HASH_BLOCK:  # for one giant word only
            return up, down
        _TABLES["up"], _TABLES["down"] = up, down
    return _TABLES["up"], _TABLES["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _SAME) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and do not overlap; ``table`` maps bytes first.

    Differences of running sums of byte * base**position, moved back to position 0, so a block of spans costs a few
    array operations.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASH_BLOCK, side="right")))
        base = start[at]
        n = int(end[to - 1] - base)
        up, down = _tables(max(n, 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((table[data[base: end[to - 1]]].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[np.minimum(s, max(n - 1, 0))]
        at = to
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(texts: Texts, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the runs without separator bytes; none crosses from one text to the next."""
    data, offsets = texts
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words_of(texts: Texts, lower: bool = False) -> Words:
    """The words of the texts; ``lower`` makes A-Z equal to a-z."""
    start, end, doc = spans(texts, _SPACE)
    return Words(start, end, doc, span_hashes(texts.data, start, end, _LOWER if lower else _SAME))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word and hash of every run of ``n`` words within one text."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1:])
    h = words.hash[at]
    for k in range(1, n):
        h = mix64(h + np.uint64(0x632BE59BD9B4E019)) ^ words.hash[at + k] * np.uint64(0xFF51AFD7ED558CCD)
    return at, mix64(h)


def per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes each text has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


def seen_before(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, hash) items: whether the same item came earlier, and how often the item occurs in all."""
    key = hashes ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    earlier = np.ones(len(key), bool)
    earlier[first] = False
    return earlier, counts[number]
