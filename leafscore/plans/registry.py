"""Query registry: each entry is a DataFrame builder over the tables plus, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafscore.plans import views
from leafscore.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to source tables and domain views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return views.load(self.spark, self.sf_dir, name)

    def once(self, rows: DataFrame, label: str) -> DataFrame:
        """The rows written to the shared folder and read back: for frames that are dear to derive and read often."""
        path = shared_dir(self.spark, label)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


#: White space of every kind, as the operators strip it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    """DuckDB SQL for ``strip``."""
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with DuckDB SQL over ``{table}``/``{view}`` names."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.duckdb_sql(sql)
        return fn

    return register
