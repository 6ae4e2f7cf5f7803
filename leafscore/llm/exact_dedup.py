"""Exact de-duplication by a tree merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.llm.common import stored

KEY = ("digest", "n_bytes", "probe")


def text_key(text: Column) -> list[Column]:
    """SHA-256, byte length and a second, unrelated hash of a text; null counts as empty.

    The digest is never null; saying so spares a filter that would compute it once more.
    """
    whole = F.coalesce(text, F.lit(""))
    return [
        F.coalesce(F.unhex(F.sha2(whole, 256)), F.lit(b"")).alias("digest"), F.octet_length(whole).cast("bigint").alias("n_bytes"),
        F.xxhash64(whole).alias("probe"),
    ]


def merge_runs(runs: DataFrame, fan_in: int, best) -> DataFrame:
    """One round: each block of ``fan_in`` runs becomes one, with the kept identifier and the count per text.

    Spark's exchange brings equal digests of a block together and its aggregation is the multiway merge. Equal
    SHA-256 digests whose length or second hash differ are never merged into one identifier: the three form the key.
    """
    return runs.groupBy(*KEY, F.expr(f"int(run div {fan_in})").alias("run")).agg(
        best("id").alias("id"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, keep: str = "smallest", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """Every row with its group: ``(row, digest, keep_id, group_size, kept)``, ``row`` being the input row.

    Rows are dealt to ``runs`` runs by a hash of doc_id. Within a run equal texts shrink to one entry (combined before
    the exchange), then runs merge ``fan_in`` at a time until one is left, so a text that a third of all rows share
    is at most one entry per run and round. The result travels down the same tree: each round is joined to the one
    below on (text, run), which spreads the rows of a hot text over all runs and needs no special case.

    ``keep`` is "smallest" or "largest" doc_id. Null texts equal empty ones. A null doc_id loses to any other; rows
    that repeat both text and doc_id count one by one in ``group_size`` and the first of them stays.
    """
    if keep not in ("smallest", "largest") or runs < 1 or fan_in < 2:
        raise ValueError("keep is smallest or largest, runs at least 1 and fan_in at least 2")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), *text_key(F.col("text")),
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
    )
    entries = rows.groupBy(*KEY, "run").agg(best("id").alias("id"), F.count(F.lit(1)).alias("n"))
    levels = [stored(entries, "digest-runs")]
    left = runs
    while left > 1:
        levels.append(merge_runs(levels[-1], fan_in, best))
        left = -(-left // fan_in)

    def down(top: DataFrame, below: DataFrame) -> DataFrame:
        parent = F.expr(f"int(b.run div {fan_in})")
        on = [F.col(f"b.{k}") == F.col(f"t.{k}") for k in KEY] + [parent == F.col("t.run")]
        return below.alias("b").join(top.alias("t"), reduce(Column.__and__, on)).select(
            *[f"b.{k}" for k in KEY], "b.run", "t.id", "t.n")

    groups = reduce(down, reversed(levels[:-1]), levels[-1])
    first = Window.partitionBy(*KEY, "run", "id").orderBy(F.lit(1))
    joined = rows.join(groups.withColumnsRenamed({"id": "keep_id", "n": "group_size"}), [*KEY, "run"])
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(first) == 1)
    return joined.select("row", "digest", "keep_id", "group_size", stays.alias("kept"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """The rows that stay, with the input's columns; an empty table gives an empty result."""
    return exact_groups(docs, keep, **options).where("kept").select("row.*")
