"""Runs of repeated words: Lyndon arrays from suffix grouping, Lyndon roots extended into maximal repetitions.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Every run holds Lyndon words
of length ``q`` for one of the two orders of the alphabet, so the Lyndon arrays of both orders name all of them. The
arrays come from the first phase of a suffix sorter by grouping (Baier): positions are grouped by their first word, and
the groups are finished from the highest to the lowest; a finished group refines the groups of the nearest lower
positions on its left. When a group is finished, the length of its context is the Lyndon array of its positions.

All stretches of a slice are worked on at once, one group of each per round, with array operations.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafscore.llm.words import map_slices, mix64, texts_of, words_of

SHORTEST = 6
EXPONENT = 4
SLICE_BYTES = 8 << 20
#: Rounds of cutting at rare words; what is left after them is searched as it is.
CUTS = 40


class Runs(NamedTuple):
    """Runs in the order of their start, then period: first word, number of words, smallest period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start[k] .. start[k] + count[k] - 1``, one range after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - count), count)


def stretches(codes: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the stretches that may hold a run of the exponent.

    A word inside such a run occurs at least ``exponent`` times in the stretch around it. So texts are cut at words
    that occur less often, and the parts again, until nothing changes. No run is lost, and none is cut.
    """
    at, part = np.arange(len(codes)), doc.astype(np.int64)
    done_at, done_n = [], []
    for k in range(CUTS):
        if not len(at):
            break
        key = codes[at] ^ mix64(part.astype(np.uint64) + np.uint64(1))
        _, number, counts = np.unique(key, return_inverse=True, return_counts=True)
        stay = counts[number] >= exponent
        whole = np.ones(int(part.max()) + 1, bool)
        whole[part[~stay]] = False
        finished = whole[part]
        if k == CUTS - 1:
            finished[:], stay[:] = True, True
        ends = _firsts(part[finished])
        done_at.append(at[finished][ends])
        done_n.append(np.diff(np.append(ends, int(finished.sum()))))
        stay &= ~finished
        at, part = at[stay], part[stay]
        if len(at):
            first = np.zeros(len(at), bool)
            first[0] = True
            first[1:] = (np.diff(at) != 1) | (part[1:] != part[:-1])
            part = np.cumsum(first) - 1
            long = np.bincount(part)[part] >= shortest
            at, part = at[long], part[long]
            part = np.unique(part, return_inverse=True)[1] if len(part) else part
    start, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_at, done_n))
    order = np.argsort(start, kind="stable")
    keep = n[order] >= shortest
    return start[order][keep], n[order][keep]


def lyndon(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word at every position, and a number that equal Lyndon words of a part share.

    Part ``k`` is ``codes[bounds[k]:bounds[k + 1]]``; its end counts as smaller than any code. Every part keeps a list
    of its open positions; those of its highest group are taken off in a round. Members that follow each other in the
    list have the same next lower position ``p`` on their left, whose Lyndon word grows by theirs: ``p`` leaves its
    group upwards, further the more members follow it.
    """
    n = len(codes)
    part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    slot = np.lexsort((codes, part))
    firsts = _firsts(part[slot], codes[slot]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, n))
    group, place, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    group[slot], place[slot] = np.repeat(firsts, sizes), np.arange(n)
    size[firsts] = sizes
    length, moving = np.ones(n, np.int64), np.zeros(n, bool)
    left, right = np.append(np.arange(-1, n - 1), n), np.append(np.arange(1, n + 1), n)  # n stands for none
    filled = bounds[:-1] < bounds[1:]
    left[bounds[:-1][filled]] = n
    right[bounds[1:][filled] - 1] = n
    low, top = bounds[:-1][filled], bounds[1:][filled].copy()
    while len(top):
        start = group[slot[top - 1]]
        members = np.sort(slot[_ranges(start, top - start)])
        top, low = start[start > low], low[start > low]
        before = left[members]
        head = np.ones(len(members), bool)
        head[1:] = before[1:] != members[:-1]
        head = np.flatnonzero(head)
        count = np.diff(np.append(head, len(members)))
        p, behind = before[head], right[members[head + count - 1]]
        left[behind], right[p] = p, behind
        some = p < n
        p, count, grow = p[some], count[some], length[members[head[some]]]
        if not len(p):
            continue
        length[p] += count * grow
        old = group[p]
        order = np.lexsort((count, old))
        p, old, count = p[order], old[order], count[order]
        of_group, of_new = _firsts(old), _firsts(old, count)
        n_group, n_new = np.diff(np.append(of_group, len(p))), np.diff(np.append(of_new, len(p)))
        tail = np.repeat(old[of_group] + size[old[of_group]] - n_group - of_group, n_group)
        target = tail + np.arange(len(p))
        # Members that stay but stand in the places taken change with those that leave from elsewhere.
        moving[p] = True
        there = slot[target]
        pushed, free = there[~moving[there]], place[p]
        free = free[free < target[np.repeat(of_group, n_group)]]
        slot[free], place[pushed] = pushed, free
        slot[target], place[p] = p, target
        moving[p] = False
        fresh = target[of_new]
        size[old[of_group]] -= n_group
        size[fresh] = n_new
        group[p] = np.repeat(fresh, n_new)
    return length, group


def runs_of(codes: np.ndarray, start: np.ndarray, n: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> Runs:
    """All runs of at least ``exponent`` (3 or more) within the stretches, by word number."""
    if not len(start):
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    where = _ranges(start, n)
    word = np.unique(codes[where], return_inverse=True)[1].astype(np.int64)
    half = len(word)
    bounds = np.concatenate([[0], np.cumsum(n)])
    both = np.concatenate([bounds, half + bounds[1:]])
    word = np.concatenate([word, -word])  # the second order
    length, group = lyndon(word, both)
    at = np.arange(len(word))
    part = np.repeat(np.arange(len(both) - 1), np.diff(both))
    end = both[1:][part]
    # Equal Lyndon words one behind the other: i is followed by the same word at i + length.
    then = at + length
    inside = then < end
    followed = np.flatnonzero(inside & (group[np.where(inside, then, 0)] == group))
    p = length[followed]
    order = np.lexsort((followed, followed % p, p))
    i, p = followed[order], p[order]
    new = np.ones(len(i), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:])
    new = np.flatnonzero(new)
    times = np.diff(np.append(new, len(i))) + 1
    i, p, times = (x[times >= exponent - 1] for x in (i[new], p[new], times))
    if not len(i):
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    # A whole root more on either side would be in the chain, so each side is extended by less than one period.
    stop = i + p * times
    room = np.minimum(p, i - both[:-1][part[i]])
    i = i - _common(word, i - 1, i - 1 + p, room, -1)
    stop = stop + _common(word, stop, stop - p, np.minimum(p, both[1:][part[stop - 1]] - stop), 1)
    size = stop - i
    good = (size >= exponent * p) & (size >= shortest)
    first, size, p = where[i[good] % half], size[good], p[good]
    found = np.unique(np.stack([first, p, size], axis=1), axis=0)
    return Runs(found[:, 0], found[:, 2], found[:, 1])


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on are equal in the direction of ``step``, up to ``room``."""
    out = room.copy()
    some = np.flatnonzero(room > 0)
    if not len(some):
        return out
    count = room[some]
    move = _ranges(np.zeros(len(some), np.int64), count)
    differs = word[np.repeat(a[some], count) + step * move] != word[np.repeat(b[some], count) + step * move]
    heads = np.cumsum(count) - count
    out[some] = np.minimum.reduceat(np.where(differs, move, np.iinfo(np.int64).max), heads)
    return np.minimum(out, room)


def looped(offsets: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """Which word stands at each place after the loops of one document in ten are planted.

    Document ``d`` with crc32 of its decimal id divisible by 10 repeats its words from ``a`` on with period ``p``.
    ``offsets`` are the word bounds of the documents. Null ids get no loop.
    """
    place = np.arange(offsets[-1])
    for k, doc_id in enumerate(ids):
        n = int(offsets[k + 1] - offsets[k])
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[offsets[k] + a: offsets[k + 1]] = offsets[k] + a + np.arange(n - a) % p
    return place


ADDED = """n_words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"""
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
EMPTY = hashlib.sha256(b"").hexdigest()


def _search(plant: bool, exponent: int, shortest: int):
    def work(batch: pa.RecordBatch) -> list:
        texts = texts_of(batch.column("text"))
        words = words_of(texts)
        offsets = np.searchsorted(words.doc, np.arange(len(texts) + 1))
        place = looped(offsets, batch.column("doc_id").to_pylist()) if plant else np.arange(len(words.hash))
        codes = words.hash[place]
        runs = runs_of(codes, *stretches(codes, words.doc, exponent, shortest), exponent, shortest)
        # A word goes if a run holds it behind its first period.
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, runs.start + runs.period, 1)
        np.add.at(edges, runs.start + runs.length, -1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        cuts = np.searchsorted(kept, offsets)
        of_doc = np.searchsorted(runs.start, offsets)
        listed, digests, collapsed = [], [], []
        for k in range(len(texts)):
            a, b = of_doc[k], of_doc[k + 1]
            found = [(int(s - offsets[k]), int(n), int(p)) for s, n, p in zip(runs.start[a:b], runs.length[a:b], runs.period[a:b], strict=True)]
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            listed.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            digests.append(hashlib.sha256(lines.encode()).hexdigest() if found else EMPTY)
            collapsed.append(_joined(texts.data, words, place[kept[cuts[k]: cuts[k + 1]]]))
        return [np.diff(offsets), pa.array(listed, pa.list_(RUN)), pa.array(digests), pa.array(collapsed)]

    return work


def _joined(data: np.ndarray, words, chosen: np.ndarray) -> str:
    """SHA-256 of the chosen words joined by one space."""
    if not len(chosen):
        return EMPTY
    start, count = words.start[chosen], words.end[chosen] - words.start[chosen] + 1
    at = _ranges(start, count)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.cumsum(count) - 1] = 32
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def find_runs(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), exponent: int = EXPONENT, shortest: int = SHORTEST, plant: bool = False,
) -> DataFrame:
    """``keep`` plus ``(n_words, runs, runs_sha256, collapsed_sha256)`` for every row of ``docs (doc_id, text)``.

    ``runs`` lists ``(start, length, period)`` of all runs with at least ``exponent`` periods and ``shortest`` words, by
    start and period, counted in words from 0. ``collapsed_sha256`` is the digest of the words that are left, joined by
    one space, when each run keeps its first period only. With ``plant``, one document in ten gets a loop of its own
    words first (``looped``), known repetitions to measure against.

    Words are runs of characters other than space and the ASCII controls tab to carriage return, taken from whole
    texts. A text is one task's work, whatever its length; the work is in proportion to its words and the number of
    different Lyndon words. Null and empty texts have no words and no runs. Repeated rows are searched one by one,
    null ids are kept, an empty table gives an empty result.
    """
    if exponent < 3:
        raise ValueError("exponent is 3 or more")
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    found = map_slices(rows, list(dict.fromkeys([*keep, "doc_id"])), ADDED, lambda: _search(plant, exponent, shortest), SLICE_BYTES)
    return found.select(*keep, "n_words", "runs", "runs_sha256", "collapsed_sha256")
