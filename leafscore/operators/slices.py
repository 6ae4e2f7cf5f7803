"""Ordered work within groups that no single task has to hold: slices of a range-partitioned table.

A window over a group puts the whole group into one task. Here rows are range-partitioned by (group, order) and
written; a *slice* is what one partition has of a group. Windows run over (group, slice), and what a slice needs from
those before it comes from a summary of one row per slice, of which a group has at most one per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.operators.layout import written

SLICE = "_slice"


def same(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of the named columns of two aliased frames; true without names."""
    return reduce(Column.__and__, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))


def sliced(rows: DataFrame, group: list[str], order: list, label: str, slices: int | None = None) -> DataFrame:
    """``rows`` with their slice number, range-partitioned by group and order and written once.

    Range bounds are sampled; written, they stay the same when a part has to be computed again.
    """
    keys = [*group, *order]
    ranged = rows.repartitionByRange(slices, *keys) if slices else rows.repartitionByRange(*keys)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def within(group: list[str], order: list):
    """The window over a group's rows in one slice."""
    return Window.partitionBy(*group, SLICE).orderBy(*order)


def before(group: list[str]):
    """The window over the summaries of a group's earlier slices."""
    return Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def carried(
    rows: DataFrame, group: list[str], parts: list[Column], carries: dict[str, Column], wholes: dict[str, Column] | None = None,
) -> DataFrame:
    """``rows`` plus what the earlier slices of their group come to; null in a group's first slice.

    ``parts`` are aggregates (aliased) over a slice, ``carries`` aggregates of them over the earlier slices, which may
    use ``wholes``, aggregates over all slices of the group. Ranges part
    at most one group at each bound, so a slice has at most one group that began before it: what is carried over is no
    longer than the number of partitions, whatever the rows, and is broadcast.
    """
    summary = rows.groupBy(*group, SLICE).agg(*parts)
    summary = summary.withColumns({n: c.over(Window.partitionBy(*group)) for n, c in (wholes or {}).items()})
    past = before(group)
    summary = summary.select(*group, SLICE, F.count(F.lit(1)).over(past).alias("_earlier"), *[c.over(past).alias(n) for n, c in carries.items()])
    on = same("r", "s", group) & (F.col(f"r.{SLICE}") == F.col(f"s.{SLICE}"))
    return rows.alias("r").join(F.broadcast(summary.where("_earlier > 0")).alias("s"), on, "left").select("r.*", *[f"s.{n}" for n in carries])


def numbered(rows: DataFrame, group: list[str], order: list, name: str, label: str, slices: int | None = None) -> DataFrame:
    """``rows`` with their number in the group's order, from 1: a row number without a task for the whole group."""
    cut = sliced(rows, group, order, label, slices)
    met = carried(cut, group, [F.count(F.lit(1)).alias("n")], {"_base": F.sum("n")})
    number = F.coalesce("_base", F.lit(0)) + F.row_number().over(within(group, order))
    return met.withColumn(name, number.cast("int")).drop("_base", SLICE)
