"""Mixing sources to target weights: word totals per source, repetition rates, floor copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.llm.common import WORD, small_side, stored, uniform


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Words to take per source: ``(source, source_size, target, rate)``.

    ``sizes`` has one row per source. Sources in code point order, null last, get the weights in turn and share
    ``share`` of all words by weight. No target exceeds ``most`` times its source; the excess goes to the others by
    weight. With sources ordered by cap over weight, the capped ones are a prefix, so running sums find the level at
    which the water stands without iterating. The windows see one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(
            by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("level") >= F.col("fill"))
        .withColumn("at", F.min(F.when(~F.col("capped"), F.struct("fill", "source", "level"))).over(everything))
    )
    return ranked.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("at.level") * F.col("weight")).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def plan_mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """Each document with its number of copies: ``(row, size, source_size, target, copies)``, ``row`` being the input row.

    Copies are floor(rate) plus one with probability equal to the fraction, decided by a hash of the seed and doc_id,
    so reruns agree. A source's words are pre-aggregated before the shuffle, and the rates (one row per source) are
    broadcast while a count shows that they are few. Null texts have size 0 but are still copied; a null source is a
    source of its own, last in order; rows that repeat a doc_id share its draw. An empty table gives an empty result.
    """
    if most < 1 or share > most:
        raise ValueError("share must not exceed most, which is at least 1")
    sized = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"),
        word_count(F.col("text")).alias("size"),
    )
    sums = sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = small_side(stored(source_targets(sums, weights, share, most), "mix-targets"))
    fraction = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(uniform(seed, F.col("id")) < fraction, 1).otherwise(0)
    return sized.join(targets, F.col("of").eqNullSafe(F.col("source"))).select(
        "row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every input row as often as ``plan_mix`` says, with the input's columns."""
    planned = plan_mix(docs, **options).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
