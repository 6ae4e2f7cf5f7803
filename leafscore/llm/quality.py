"""Quality rules: text measures, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import hash_sample, uniform
from leafscore.llm.words import Texts, map_slices, ngrams, per_text, seen_before, span_hashes, spans, texts_of, words_of

#: Buckets for word uni- and bigrams, and for byte trigrams. Word bucket 0 is for a word that follows itself.
BUCKETS = 2048
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class QualityModel(NamedTuple):
    """Weights by bucket, bias, and the slope and shift that turn a margin into a calibrated probability."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float


def measures(texts: Texts) -> dict[str, np.ndarray]:
    """The rule measures of each text: words, code points in words, symbols, repeated lines, words in repeated windows."""
    n, data = len(texts), texts.data
    words = words_of(texts)
    at, windows = ngrams(words, 3)
    _, times = seen_before(words.doc[at], windows)
    covered = np.zeros(len(words.hash), bool)
    for k in range(3):
        covered[at[times > 1] + k] = True
    start, end, doc = spans(texts, _NEWLINE)
    visible = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_SPACE[data], out=visible[1:])
    real = visible[end] > visible[start]
    start, end, doc = start[real], end[real], doc[real]
    again, _ = seen_before(doc, span_hashes(data, start, end))
    return {
        "n_words": np.bincount(words.doc, minlength=n),
        "word_chars": per_text(texts, ~_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(texts, _SYMBOL[data]),
        "n_dup_lines": np.bincount(doc[again], minlength=n),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def buckets(texts: Texts) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all word n-grams and of all byte trigrams."""
    words = words_of(texts, lower=False)
    at, pairs = ngrams(words, 2)
    pair_bucket = 1 + (pairs % np.uint64(BUCKETS - 1)).astype(np.int64)
    pair_bucket[words.hash[at] == words.hash[at + 1]] = 0
    word = (np.concatenate([words.doc, words.doc[at]]),
            np.concatenate([1 + (words.hash % np.uint64(BUCKETS - 1)).astype(np.int64), pair_bucket]))
    data = texts.data.astype(np.uint32)
    if len(data) < 3:
        return word, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    inside = doc[:-2] == doc[2:]
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    return word, (doc[:-2][inside], hashed[inside])


def vectors(texts: Texts) -> np.ndarray:
    """Bucket shares of each text, scaled so that an evenly spread text has ones: words first, then characters."""
    parts = []
    for doc, bucket in buckets(texts):
        count = np.bincount(doc * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        parts.append(count * (BUCKETS / np.maximum(count.sum(1, keepdims=True), 1)))
    return np.hstack(parts).astype(np.float32)


def margins(texts: Texts, model: QualityModel) -> np.ndarray:
    """The linear score of each text, summed over n-gram occurrences without building its vector."""
    out = np.full(len(texts), model.bias)
    for (doc, bucket), weight in zip(buckets(texts), (model.word, model.char), strict=True):
        total = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        out += np.bincount(doc, weight[bucket], minlength=len(texts)) * (BUCKETS / total)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the bias is not penalised."""
    n = len(y)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # largest curvature, for the step
        v = x.T @ (x @ v) / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= np.float32(top)
    step = 1 / (0.25 * (top + 1) + ridge)
    w = u = np.zeros(x.shape[1], np.float32)
    b = c = 0.0
    for k in range(rounds):
        g = (_sigmoid(x @ u + c) - y).astype(np.float32)
        w_new, b_new = u - np.float32(step) * (x.T @ g / n + np.float32(ridge) * u), c - step * float(g.mean())
        m = k / (k + 3)
        u, c = w_new + np.float32(m) * (w_new - w), b_new + m * (b_new - b)
        w, b = w_new, b_new
    return w, b


def fit_calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over the margins (Newton steps, targets pulled in from 0 and 1)."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-12, float(np.abs(d).max())))
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 2400, ridge: float = 1e-3, rounds: int = 300, seed: str = "quality",
) -> QualityModel:
    """Fit on about ``sample_rows`` labelled documents, chosen by a hash of doc_id (the bound of the training sample).

    ``labels`` has doc_id and quality (0 or 1); rows with a null in either are left out and a doc_id labelled twice
    takes the lower label. A quarter of the sample, again by hash, is held back for the calibration. Without labels
    of both kinds the model gives every text the smoothed share of good labels.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hash_sample(known, "doc_id", sample_rows, seed).select(F.col("doc_id").alias("id"), "quality")
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
        "text", F.col("quality").cast("double").alias("label"), (uniform(seed + "-fold", F.col("doc_id")) < 0.25).alias("held"))

    def work():
        def one(part: pa.RecordBatch) -> list:
            x = vectors(texts_of(part.column("text"))).astype(np.float16)
            return [pa.array([r.tobytes() for r in x], pa.binary())]
        return one

    found = map_slices(joined, ["label", "held"], "vector binary", work, 1 << 18).toArrow()
    y = np.array(found.column("label").to_pylist(), float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        none = np.zeros(BUCKETS)
        return QualityModel(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    x = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float16).reshape(len(y), -1).astype(np.float32)
    order = np.lexsort((x[:, 0], x.sum(1), y))  # rows arrive in any order
    x, y, held = x[order], y[order], np.array(found.column("held").to_pylist(), bool)[order]
    if len(set(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    w, b = fit_logistic(x[~held], y[~held], ridge, rounds)
    slope, shift = fit_calibration(x[held] @ w + b, y[held]) if held.any() else (1.0, 0.0)
    return QualityModel(w[:BUCKETS].astype(float), w[BUCKETS:].astype(float), b, slope, shift)


def quality_rules(
    docs: DataFrame, model: QualityModel, min_words: int = 50, most_repeated: int = 50, threshold: float = 0.5,
) -> DataFrame:
    """Measures, rule result, calibrated probability and verdict of every document, scored in Arrow batches.

    A text fails the base rules with fewer than ``min_words`` words or more than ``most_repeated`` percent of its
    words in repeated 3-word windows; it is kept if it passes and its probability reaches ``threshold``. Null and
    empty texts have no words and fail. Only doc_id and text are read; repeated rows give equal results.
    """
    def work():
        def one(part: pa.RecordBatch) -> list:
            texts = texts_of(part.column("text"))
            found = measures(texts)
            failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > most_repeated * found["n_words"])
            p = _sigmoid(model.slope * margins(texts, model) + model.shift)
            return [*(v.astype(np.int64) for v in found.values()), failed, p, ~failed & (p >= threshold)]
        return one

    added = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
             "quality double, kept boolean")
    return map_slices(docs.select("doc_id", "text"), ["doc_id"], added, work)
