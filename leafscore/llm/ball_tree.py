"""Ranked lexical search as exact maximum inner product search in sparse ball trees.

A document is a sparse vector of saturated term frequencies, an item the vector of its terms' weights; the score is
their inner product in integers. Each task builds ball trees over its documents. A node has the centroid of its
documents and the largest distance from it, so no document below scores more than ``<q, centroid> + |q| * radius``.
Nodes are opened best bound first, and a subtree is left out when its bound, rounded up, is under the score that an
item's list already asks for. Leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafscore.llm.common import stored
from leafscore.llm.words import _LOWER, Texts, map_slices, span_hashes, spans, texts_of

TOP = 20
#: Text of the items that are searched for in one pass, which bounds what every task holds of them.
BLOCK_BYTES = 256 << 10
TREE_DOCS = 2048
TREE_ENTRIES = 2_000_000
LEAF_DOCS = 32
#: A side of a split has at least one row in so many, so the depth stays logarithmic.
LEAST_SHARE = 16
#: Relative error that covers the rounding of sums of doubles over a node's entries.
SLACK = 1e-9

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _SEPARATOR[_first: _last + 1] = False


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every term: runs of ASCII letters, digits and any other characters beyond ASCII."""
    start, end, doc = spans(texts, _SEPARATOR)
    return doc, span_hashes(texts.data, start, end, _LOWER)


class Items(NamedTuple):
    """The items of one pass: keys, sorted term hashes, and per item the terms' numbers and repeats."""

    keys: list
    vocabulary: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


def item_terms(rows: list) -> Items:
    """``rows`` of (item_id, text), as many as one pass takes."""
    doc, hashes = terms_of(texts_of(pa.array([r["text"] for r in rows], pa.string())))
    vocabulary, number = np.unique(hashes, return_inverse=True)
    pair, repeats = np.unique(doc * max(1, len(vocabulary)) + number, return_counts=True)
    owner, terms = np.divmod(pair, max(1, len(vocabulary)))
    return Items([r["item_id"] for r in rows], vocabulary, np.searchsorted(owner, np.arange(len(rows) + 1)), terms, repeats)


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of the documents with a term: all their terms, and the counts of those of the vocabulary."""

    def work(batch: pa.RecordBatch) -> list:
        texts = texts_of(batch.column("text"))
        doc, hashes = terms_of(texts)
        n = np.bincount(doc, minlength=len(texts))
        at = np.searchsorted(vocabulary, hashes)
        known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
        size = max(1, len(vocabulary))
        pair, tf = np.unique(doc[known] * size + at[known], return_counts=True)
        bounds = np.searchsorted(pair // size, np.arange(len(texts) + 1))
        return [n, *(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v.astype(np.int32))) for v in (pair % size, tf))]

    return map_slices(docs, ["doc_id"], "n long, terms array<int>, tf array<int>", lambda: work).where("n > 0")


def length_factors(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms, in whole numbers of any size."""
    if len(n) and int(n.max()) * documents * 25 >= 2**62:
        return np.array([75 + 25 * int(k) * documents // terms for k in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * documents // terms


class Tree(NamedTuple):
    """Nodes in the order of their making: bounds of their rows in ``order``, children (-1 for a leaf), centroid, radius."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    centroid: np.ndarray
    radius: np.ndarray


def _gather(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the rows, one row after the other, and the rows' lengths."""
    count = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[rows] - (ends - count), count), count


def build_tree(bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF_DOCS) -> Tree:
    """A ball tree over sparse rows, each with an entry at least.

    A node is split into the rows nearer to either of two far rows, or in the middle if one side would be too small.
    """
    n = len(bounds) - 1
    order, low, high, child, centroids, radii = np.arange(n), [0], [n], [], [], []
    norms = np.add.reduceat(values * values, bounds[:-1])
    k = 0
    while k < len(low):
        rows = order[low[k]: high[k]]
        at, count = _gather(bounds, rows)
        column, value = columns[at], values[at]
        heads = np.cumsum(count) - count
        center = np.bincount(column, value, width) / len(rows)
        square = float(center @ center)
        gap = norms[rows] - 2 * np.add.reduceat(value * center[column], heads) + square
        # What cancels in the difference is bounded by the sizes of its parts.
        radii.append(math.sqrt(max(0.0, float((gap + SLACK * (norms[rows] + square)).max()))) * (1 + SLACK))
        centroids.append(center)
        if len(rows) <= leaf:
            child.append(-1)
        else:
            pole = np.zeros(width)
            far = int(gap.argmax())
            pole[column[heads[far]: heads[far] + count[far]]] = value[heads[far]: heads[far] + count[far]]
            near = np.add.reduceat(value * pole[column], heads)
            other = int((norms[rows] - 2 * near).argmax())
            anti = np.zeros(width)
            anti[column[heads[other]: heads[other] + count[other]]] = value[heads[other]: heads[other] + count[other]]
            side = near - np.add.reduceat(value * anti[column], heads)
            ranked = np.argsort(side, kind="stable")
            half = int((side <= 0).sum())
            if min(half, len(rows) - half) * LEAST_SHARE < len(rows):
                half = len(rows) // 2
            order[low[k]: high[k]] = rows[ranked]
            child.append(len(low))
            low += [low[k], low[k] + half]
            high += [low[k] + half, high[k]]
        k += 1
    return Tree(order, np.array(low), np.array(high), np.array(child), np.stack(centroids, axis=1), np.array(radii))


class _Best:
    """The best documents of an item so far: highest score, then smallest doc_id, null last."""

    def __init__(self, top: int) -> None:
        self.top, self.heap = top, []

    @property
    def least(self) -> int:
        """The score that a document needs at least to come in."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search(
    tree: Tree, bounds: np.ndarray, terms: np.ndarray, exact: np.ndarray, ids: list, items: Items, weights: np.ndarray,
    scale: np.ndarray, best: list[_Best],
) -> int:
    """Bring the documents of one tree into the items' lists; how many leaves were scored."""
    opened = 0
    query = np.zeros(len(weights), np.int64)
    for k, found in enumerate(best):
        own = items.terms[items.bounds[k]: items.bounds[k + 1]]
        if not len(own):
            continue
        value = weights[own] * items.repeats[items.bounds[k]: items.bounds[k + 1]]
        scaled = value / scale[own]
        reach = scaled @ tree.centroid[own] + math.sqrt(float(scaled @ scaled)) * tree.radius
        reach = np.ceil(reach * (1 + SLACK) + SLACK * np.abs(scaled).sum() * np.abs(tree.centroid).max() + 1).astype(np.int64)
        query[own] = value
        waiting = [(-int(reach[0]), 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < found.least:
                break
            below = int(tree.child[node])
            if below >= 0:
                for x in (below, below + 1):
                    if reach[x] >= found.least:
                        heapq.heappush(waiting, (-int(reach[x]), x))
                continue
            opened += 1
            rows = tree.order[tree.low[node]: tree.high[node]]
            at, count = _gather(bounds, rows)
            score = np.add.reduceat(query[terms[at]] * exact[at], np.cumsum(count) - count)
            for x in np.flatnonzero(score >= found.least):
                found.add(int(score[x]), ids[rows[x]])
        query[own] = 0
    return opened


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)


def _searcher(items: Items, weights: np.ndarray, documents: int, total: int, top: int):
    """The Arrow function of a task: trees over bounded blocks of its documents, one list per item for all of them."""
    scale = np.sqrt(np.maximum(weights, 1).astype(np.float64))  # <q / s, x * s> is <q, x>, with smaller balls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in items.keys]
        for batch in batches:
            offsets, terms = _lists(batch.column("terms"))
            tf = _lists(batch.column("tf"))[1].astype(np.int64)
            m = length_factors(batch.column("n").to_numpy(zero_copy_only=False), documents, total)
            rows = np.flatnonzero(np.diff(offsets) > 0)
            ids = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(rows):
                limit = int(np.searchsorted(offsets[rows + 1], offsets[rows[at]] + TREE_ENTRIES, side="right"))
                part = rows[at: max(at + 1, min(limit, at + TREE_DOCS))]
                at += len(part)
                entries, count = _gather(offsets, part)
                own, times = terms[entries], tf[entries]
                exact = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(m[part], count))
                bounds = np.concatenate([[0], np.cumsum(count)])
                tree = build_tree(bounds, own, exact * scale[own], len(weights))
                search(tree, bounds, own, exact, [ids[r] for r in part], items, weights, scale, best)
        found = [(k, None if not known else -d, score) for k, b in enumerate(best) for score, known, d in b.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], kind) for c, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))],
            names=["item", "doc_id", "score"])

    return run


def _rank_block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    items = item_terms(block.collect())  # a bounded block
    counts = stored(term_counts(docs, items.vocabulary), "term-counts")
    documents, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One number per term of the block's items.
    frequent = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(items.vocabulary)), np.int64)
    for term, df in frequent:
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    found = counts.mapInArrow(_searcher(items, weights, documents, total, top), "item int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Lists of many tasks are merged in two steps, so no task reads an item's entries of all of them.
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", block.schema["item_id"].dataType)])
    keys = spark.createDataFrame(list(enumerate(items.keys)), schema)
    return found.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` highest-scoring documents of every item, exactly.

    A term is a run of letters and digits, A-Z lower-cased. With N documents that have a term, L terms in all of them
    and df documents with the term, its weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; an occurrence count tf in
    a document of n terms counts ``10^9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L``. A score is the sum of
    weight times count over an item's terms, repeats included; documents at 0 are left out, equal scores go by
    ascending doc_id, null last.

    Items are taken in blocks of about ``block_bytes`` of text, as many passes over the documents as it takes; what
    every task holds of the items is bounded by that. A tree takes at most 2,048 documents and 2 million entries (or one
    document), so memory does not grow with a partition. Null and empty texts have no terms: such a document scores
    nothing, such an item has no rows. Rows that repeat a doc_id are ranked one by one; rows that repeat item_id and
    text are one item. Empty tables give an empty result. Terms are compared by 64-bit hashes.
    """
    asked = items.select("item_id", "text").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    parts = [
        _rank_block(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), top) for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
