"""Language identification: presence n-gram kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import stored, uniform
from leafscore.llm.words import Texts, map_slices, texts_of

#: Prediction for texts without a letter.
UNDETERMINED = "und"
#: Hash buckets for the presence of byte n-grams, and the n-gram lengths that the kernel blends.
DIMENSIONS = 8192
LENGTHS = (1, 2, 3)
#: Texts per matrix product.
BLOCK = 256
#: Sampled texts from which a language's rejection bound is derived.
LEAST_SAMPLE = 20


class LanguageModel(NamedTuple):
    """Languages, landmark presence vectors (scaled to length 1) and the dual weights per language; for the rejection
    of texts, the log share of a language's sample that has each bucket, and the least mean of it over a text's buckets."""

    names: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    typical: np.ndarray
    least: np.ndarray


def presence(texts: Texts) -> np.ndarray:
    """One row per text: 1 where a byte n-gram of the whole text falls in the bucket, scaled to length 1."""
    n = len(texts)
    x = np.zeros(n * DIMENSIONS, np.float32)
    data = texts.data.astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(texts.offsets))
    code = np.zeros(len(data), np.uint32)
    for length in range(1, max(LENGTHS) + 1):
        count = len(data) - length + 1
        if count <= 0:
            break
        code = (code[:count] << np.uint32(8)) | data[length - 1:]
        if length in LENGTHS:
            inside = doc[:count] == doc[length - 1:]
            bucket = ((code + np.uint32(length << 28)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
            x[(doc[:count] * np.int32(DIMENSIONS) + bucket.astype(np.int32))[inside]] = 1
    x = x.reshape(n, DIMENSIONS)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit_ridge(x: np.ndarray, labels: np.ndarray, names: tuple[str, ...], per_language: int, ridge: float) -> LanguageModel:
    """Landmarks are the first ``per_language`` rows of each language; one ridge regression per language on their map."""
    marks = np.concatenate([np.flatnonzero(labels == k)[:per_language] for k in range(len(names))])
    values, vectors = np.linalg.eigh((x[marks] @ x[marks].T).astype(np.float64))
    useful = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, useful] / np.sqrt(values[useful])
    mapped = (x @ x[marks].T).astype(np.float64) @ root
    target = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    size = np.bincount(labels, minlength=len(names))[labels].astype(float)
    weight = (len(labels) / len(names)) / size  # languages count alike
    gram = mapped.T @ (mapped * weight[:, None])
    dual = np.linalg.solve(gram + ridge * len(labels) * np.eye(gram.shape[0]), mapped.T @ (target * weight[:, None]))
    return LanguageModel(names, x[marks], (root @ dual).astype(np.float32), *fit_rejection(x > 0, labels, len(names)))


def fit_rejection(has: np.ndarray, labels: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Per language, the log share of the sample that has each bucket, and the least mean of it that a text must reach.

    Each text of the sample is measured against the others of its language. The bound is the lowest hundredth of these
    values, less a quarter of their distance to the median. A sample of under ``LEAST_SAMPLE`` texts rejects nothing.
    """
    typical, least = np.zeros((languages, has.shape[1]), np.float32), np.full(languages, -np.inf)
    for k in range(languages):
        own = has[labels == k]
        n, counts = len(own), own.sum(0)
        typical[k] = np.log((counts + 1) / (n + 1))
        if n >= LEAST_SAMPLE:
            others = np.log(np.maximum(counts, 1) / n)  # of a text's own buckets, without the text
            means = (own @ others) / np.maximum(own.sum(1), 1)
            low = np.quantile(means, 0.01, method="lower")
            least[k] = low - 0.25 * (np.median(means) - low)
    return typical, least


def fit_language(
    docs: DataFrame, sample_per_language: int = 300, landmarks_per_language: int = 32, max_languages: int = 256,
    ridge: float = 1e-3, seed: str = "language",
) -> LanguageModel:
    """Fit on about ``sample_per_language`` texts of every language; more than ``max_languages`` are an error.

    ``docs`` has doc_id, text and lang; rows with a null text or lang are left out. The bounds are those of the
    training sample, drawn by a hash of doc_id at a rate per language, so no language's rows meet in one task.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    rates = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-rates")
    found = rates.count()
    if found > max_languages:
        raise ValueError(f"{found} languages, more than max_languages={max_languages}: none is left out, raise the bound for a larger model")
    drawn = uniform(seed, F.col("doc_id"))
    sample = usable.select("doc_id", "lang", "text", drawn.alias("draw")).join(
        F.broadcast(rates.select(F.col("lang").alias("of"), "n")),  # at most max_languages rows
        (F.col("lang") == F.col("of")) & (F.col("draw") < sample_per_language / F.col("n")),
    ).select("lang", "draw", "text")

    def work():
        def one(part: pa.RecordBatch) -> list:
            bits = np.packbits(presence(texts_of(pc.utf8_lower(part.column("text")))) > 0, axis=1)
            return [pa.array([r.tobytes() for r in bits], pa.binary())]
        return one

    rows = map_slices(sample, ["lang", "draw"], "bits binary", work, 1 << 18).toArrow().sort_by([("lang", "ascending"), ("draw", "ascending"), ("bits", "ascending")])
    names = tuple(dict.fromkeys(rows.column("lang").to_pylist()))
    if not names:
        return LanguageModel((), np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 0), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    labels = np.array([names.index(v) for v in rows.column("lang").to_pylist()])
    x = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(labels), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return fit_ridge(x, labels, names, landmarks_per_language, ridge)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs``' columns ``keep`` plus the language and score of every whole text, read from ``text`` alone.

    Kernels against the landmarks are products of presence matrices of up to 256 texts. The score is the winning
    regression value, from -1 and 1 brought to 0 and 1. Null texts, texts without a letter, and every text if the
    model knows no language, get ``und`` and score 0. Repeated rows get equal results; a tie goes to the first
    language by name. A third name adds the support: by how much the text's n-grams are, on average, more usual in the
    language's sample than its rejection bound asks. Texts unlike all learned languages are below 0; ``und`` has -1.
    """
    found_names = np.array([*model.names, UNDETERMINED], dtype=object)

    def work():
        def one(part: pa.RecordBatch) -> list:
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            best = np.full(part.num_rows, len(model.names))
            score, support = np.zeros(part.num_rows), np.full(part.num_rows, -1.0)
            for at in range(0, part.num_rows if model.names else 0, BLOCK):
                x = presence(texts_of(pc.utf8_lower(part.column("text").slice(at, BLOCK))))
                value = (x @ model.landmarks.T) @ model.weights
                best[at: at + BLOCK] = value.argmax(1)
                score[at: at + BLOCK] = np.clip((value.max(1) + 1) / 2, 0, 1)
                if len(names) > 2:
                    has = (x > 0).astype(np.float32)
                    mean = (has @ model.typical.T) / np.maximum(has.sum(1, keepdims=True), 1)
                    winner = value.argmax(1)
                    support[at: at + BLOCK] = np.minimum(mean[np.arange(len(winner)), winner] - model.least[winner], 1e9)
            best[~letters], score[~letters], support[~letters] = len(model.names), 0, -1
            return [pa.array(found_names[best], pa.string()), score, *([support] if len(names) > 2 else [])]
        return one

    others = [k for k in keep if k != "text"]  # the text travels once
    ready = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("kept"), has_letter(F.col("text")).alias("letters"), "text")
    found = map_slices(ready, ["kept", "letters", *(["text"] if "text" in keep else [])], "language string, value double" + (", support double" if len(names) > 2 else ""), work)
    return found.select(
        *["text" if k == "text" else F.col("kept")[k].alias(k) for k in keep], F.col("language").alias(names[0]), F.col("value").alias(names[1]),
        *[F.col("support").alias(n) for n in names[2:]])
