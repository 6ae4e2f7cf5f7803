"""Canonical JSON of nested VARIANT values, level by level, and the hash of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.operators.layout import written
from leafscore.operators.sampling import VOLATILE_KEYS


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("scalar")


def _literal(text: Column) -> Column:
    """A string as a JSON literal."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical_json(rows: DataFrame, column: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` plus ``canonical``: the VARIANT as JSON text without white space, keys sorted at every depth.

    Object keys in ``leave_out`` go with all they hold, at every depth. Numbers are in shortest form, so ``1.50`` and
    ``1.5`` are equal and strings are never numbers. A null value gives null; a JSON null gives ``null``.

    The values are taken apart one level per round with ``variant_explode`` until no object or array is left, and put
    together again from the deepest level up, so the plan grows with the depth of the values and nothing else, and any
    nesting is handled. Each level is written once.
    """
    spark = rows.sparkSession
    base = written(rows.withColumn("_row", F.monotonically_increasing_id()), "canonical-rows")
    empty = F.array().cast("array<int>")
    start = base.where(F.col(column).isNotNull()).select(
        "_row", empty.alias("path"), F.lit(None).cast("string").alias("key"), F.col(column).alias("value"))
    levels = []
    while True:
        level = start.withColumn("kind", _kind(F.col("value")))
        level = level.withColumn("json", F.when(F.col("kind") == "scalar", F.to_json("value")))
        levels.append(written(level, "canonical-level"))
        inner = levels[-1].where("kind <> 'scalar'")
        if not inner.limit(1).count():
            break
        each = spark.tvf.variant_explode(F.col("o.value").outer())
        start = inner.alias("o").lateralJoin(each.alias("e")).where(F.col("e.key").isNull() | ~F.col("e.key").isin(*leave_out)).select(
            "o._row", F.concat("o.path", F.array("e.pos")).alias("path"), "e.key", "e.value")
    built = levels[-1].select("_row", "path", "key", "json")
    for level in reversed(levels[:-1]):
        named = F.when(F.col("key").isNotNull(), F.concat(_literal(F.col("key")), F.lit(":"))).otherwise("")
        entry = F.struct(F.element_at("path", -1).alias("pos"), F.concat(named, "json").alias("t"))
        children = built.groupBy("_row", F.slice("path", 1, F.size("path") - 1).alias("path")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ",").alias("inner"))
        inner = F.coalesce("inner", F.lit(""))
        built = level.join(children, ["_row", "path"], "left").select(
            "_row", "path", "key",
            F.when(F.col("kind") == "object", F.concat(F.lit("{"), inner, F.lit("}")))
            .when(F.col("kind") == "array", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.col("json")).alias("json"))
    whole = built.select("_row", F.col("json").alias("canonical"))
    return base.join(whole, "_row", "left").drop("_row")


def nested_config_hash(configs: DataFrame, column: str = "config") -> DataFrame:
    """``configs`` without the VARIANT, plus ``config_hash``: SHA-256 of its canonical JSON without run-time keys.

    Key order and run-time keys, at any depth, do not change the hash. Rows may repeat; a null configuration has none.
    """
    return canonical_json(configs, column, VOLATILE_KEYS).withColumn("config_hash", F.sha2("canonical", 256)).drop(column, "canonical")
