"""Exact quantiles and resampling over value counts that are spread over tasks by value ranges.

Rows are counted per (group, metric, value) and the counts are range-partitioned by that, so a *slice* is what one
partition has of a group's values, and all of a slice lies below all of the next. A group has at most one slice per
partition; the slices' totals, added up in order, say in which slice a rank lies. No task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafscore.operators import slices as S
from leafscore.operators.slices import same


def value_counts(rows: DataFrame, values: list[str], keys: list[str], decimals: int | None = None) -> DataFrame:
    """``(*keys, metric, value, n)``: how often each group has each value of each metric; nulls are left out."""
    value = lambda v: F.round(F.col(v), decimals) if decimals is not None else F.col(v)
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), value(v).cast("double").alias("value")) for v in values])
    long = rows.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.value")
    return long.where("value IS NOT NULL").groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def sliced(counts: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """Counts with the number of the value range that each lies in, written once."""
    return S.sliced(counts, [*keys, "metric"], ["value"], "value-slices", slices).withColumnRenamed(S.SLICE, "slice")


def slice_totals(cut: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, metric, slice, size, before, total)``: rows in a slice, in those below it and in the group."""
    group = [*keys, "metric"]
    by_slice = cut.groupBy(*group, "slice").agg(F.sum("n").alias("size"))
    whole = Window.partitionBy(*group)
    below = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return by_slice.withColumns({"before": F.coalesce(F.sum("size").over(below), F.lit(0)), "total": F.sum("size").over(whole)})


def quantiles_of(cut: DataFrame, probabilities: list[float], keys: list[str]) -> DataFrame:
    """``(*keys, metric, n, quantiles)`` of sliced counts, linear between the two nearest ranks."""
    group = [*keys, "metric"]
    totals = slice_totals(cut, keys)
    position = [(F.col("total") - 1) * p for p in probabilities]
    wanted = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (F.floor(h) if side == 0 else F.ceil(h)).cast("long").alias("rank"))
        for k, h in enumerate(position) for side in (0, 1)])
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("size")))
    asked = totals.withColumn("asked", inside).where(F.size("asked") > 0)
    # Only the slices that hold a wanted rank are looked into.
    met = cut.alias("c").join(asked.alias("a"), same("c", "a", [*group, "slice"])).select("c.*", "a.before", "a.total", "a.asked")
    upto = Window.partitionBy(*group, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("above", F.col("before") + F.sum("n").over(upto))
    hits = met.withColumn("hit", F.explode(F.filter(
        "asked", lambda w: (w["rank"] < F.col("above")) & (w["rank"] >= F.col("above") - F.col("n")))))
    ends = [[F.max(F.when((F.col("hit.k") == k) & (F.col("hit.side") == side), F.col("value"))) for side in (0, 1)] for k in range(len(probabilities))]
    at = [(F.first("total") - 1) * p for p in probabilities]
    return hits.groupBy(*group).agg(
        F.first("total").alias("n"),
        F.array(*[low + (high - low) * (h - F.floor(h)) for (low, high), h in zip(ends, at, strict=True)]).alias("quantiles"))


def exact_quantiles(
    rows: DataFrame, values: list[str], probabilities: list[float], keys: list[str] | None = None,
    decimals: int | None = None, slices: int | None = None,
) -> DataFrame:
    """``(*keys, metric, n, quantiles)``: exact quantiles of each metric, interpolated linearly, null values left out.

    Groups without a value have no row. Keys may be null.
    """
    keys = keys or []
    return quantiles_of(sliced(value_counts(rows, values, keys, decimals), keys, slices), probabilities, keys)


def with_quantiles(stats: DataFrame, quantiles: DataFrame, names: dict[str, tuple[str, int]], keys: list[str]) -> DataFrame:
    """``stats`` plus columns ``{name: (metric, place in quantiles)}``; one row per group in both frames."""
    wide = quantiles.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == metric, F.col("quantiles")[k])).alias(name) for name, (metric, k) in names.items()])
    return stats.alias("s").join(wide.alias("q"), same("s", "q", keys), "left").select("s.*", *[f"q.{n}" for n in names])
