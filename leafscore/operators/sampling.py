"""Deterministic splits and subsets by hash order, and canonical configuration hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.operators.slices import numbered

# Run-time keys that are no part of a configuration's identity.
VOLATILE_KEYS = ("timestamp", "pid", "temp_path", "output_dir", "log_dir", "start_time", "end_time", "run_id")
TEST_SPLITS = ("test", "test_split", "test_set")


def _hashed(ids: DataFrame, column: str, seed: int) -> DataFrame:
    key = F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string"))
    return ids.select(column).distinct().withColumn("_h", F.sha2(key, 256))


def subset_sample(ids: DataFrame, n: int, seed: int = 42, column: str = "document_id") -> DataFrame:
    """Exactly n ids (or all), the same for the same seed: the first in hash order, of any number.

    Places come from slices of the hash order, so neither a task nor the driver gathers the n ids.
    """
    placed = numbered(_hashed(ids, column, seed), [], ["_h", column], "_place", "subset")
    return placed.where(F.col("_place") <= n).select(column)


def split_assign(
    ids: DataFrame, development: int = 500, validation: int = 126, seed: int = 42, column: str = "document_id"
) -> DataFrame:
    """Disjoint development and validation ids from the first places of the hash order, of any number."""
    placed = numbered(_hashed(ids, column, seed), [], ["_h", column], "_place", "split")
    return placed.where(F.col("_place") <= development + validation).select(
        column, F.when(F.col("_place") <= development, "development").otherwise("validation").alias("split")
    )


def resolve_split(files: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """Ids of one split; the frozen test split needs explicit permission before anything is read."""
    name = split.strip().lower()
    if name in TEST_SPLITS:
        if not allow_test:
            raise PermissionError("the test split is frozen; pass allow_test=True to read it")
        name = "test"
    return files.where(F.col("split") == name).select("split", "stem").distinct()


def config_hash(entries: DataFrame) -> DataFrame:
    """SHA-256 of each configuration's sorted key/value JSON without volatile keys.

    ``entries``: (config_id, key, value) with unique keys per configuration.
    """
    kept = entries.where(~F.col("key").isin(*VOLATILE_KEYS))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    text = F.to_json(F.map_from_entries(pairs))
    return kept.groupBy("config_id").agg(F.sha2(text, 256).alias("config_hash"))
