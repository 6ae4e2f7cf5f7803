"""Physical layout helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.session import shared_dir


#: Parts that one split of a table of short rows is dealt into before costly work: 4 MB of a split of 128 MB.
PARTS = 32


def spread(scan: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Repartition a scan feeding per-row heavy work when it has fewer splits than the cluster has cores.

    A table of many files already has one task per split and passes through without a shuffle; a single small
    file would otherwise run on one core. Four tasks per core even out rows of very different cost. With ``parts`` every
    split is dealt into so many, however many there are: for tables of millions of short rows a split, which may also
    lie in a few row groups that cannot be split.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if parts is None and splits >= cores:
        return scan
    return scan.repartition(max(cores * 4, splits * (parts or 0)), *keys)


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` plus columns that are computed once per row, or without any the rows with each of theirs computed once.

    The optimizer puts a projected expression wherever its column is used, also several times into one filter; it leaves
    what a generator makes alone. The lambda also keeps the long expressions out of the generated code of their stage,
    whose methods the JVM would otherwise interpret because of their size.
    """
    own = [c.alias(n) for n, c in columns.items()] or [F.col(f"`{n}`") for n in rows.columns]
    made = F.inline(F.transform(F.array(F.struct(*own)), lambda r: r))
    return rows.select("*", made) if columns else rows.select(made)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and the same when an executor is lost."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
