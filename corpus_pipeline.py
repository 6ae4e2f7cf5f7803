"""A training-corpus pipeline over ``documents``: identify languages, drop exact and near copies, mix sources, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; between stages the rows
are written as Parquet and read again, so a lost executor costs at most one stage. All but the last stage return the
columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscore.llm import exact_dedup, language, mixing, near_dedup, packing
from leafscore.llm.common import read, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in one of the languages that the documents themselves are labelled with.

    Those without a letter are rejected, and those whose n-grams are less usual in the language found than nearly all
    of its labelled sample's are (``language.fit_rejection``).
    """
    model = language.fit_language(docs)
    found = language.identify(docs, model, docs.columns, names=("_language", "_language_score", "_language_support"))
    kept = (F.col("_language") != language.UNDETERMINED) & (F.col("_language_support") >= 0)
    return found.where(kept).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, keep the smallest doc_id."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target shares."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens; a repeated document is packed as often."""
    pieces = packing.token_pieces(docs, ["doc_id"])
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The language model and the packing have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
