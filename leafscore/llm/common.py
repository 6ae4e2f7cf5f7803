"""Helpers shared by the operators: written intermediate tables, checked broadcasts, bounded hash samples."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscore.session import shared_dir

#: Words are runs of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a small table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe when an executor is lost."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


def free_exchanges(docs: DataFrame) -> None:
    """Let Spark delete the exchange files of frames that are no longer referred to; it does so when it collects garbage."""
    gc.collect()
    docs.sparkSession._jvm.System.gc()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` rows, otherwise unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(seed: str, *keys: Column) -> Column:
    """A reproducible number in [0, 1) for the keys: 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def hash_sample(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """About ``size`` rows chosen by a hash of ``key``; all rows if there are fewer. The same rows on every run."""
    total = rows.count()
    if total <= size:
        return rows
    return rows.where(uniform(seed, F.col(key)) < size / total)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
