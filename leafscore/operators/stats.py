"""Experiment statistics: condition summaries, bootstrap intervals, latency, run totals and integrity checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.functions.scalars import mean4, ratio
from leafscore.operators import quantiles, resampling, scoring


def condition_counts(records: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Requested/successful/failed documents per condition and the derived status.

    Conditions named only in ``conditions`` come out as ``EMPTY``.
    """
    out = records.groupBy("condition_id").agg(
        F.count("*").alias("requested"), F.count_if(F.col("status") == "success").alias("successful")
    )
    if conditions is not None:
        out = conditions.select("condition_id").distinct().join(out, "condition_id", "left").na.fill(
            0, ["requested", "successful"]
        )
    requested, successful = F.col("requested"), F.col("successful")
    failed = requested - successful
    return out.withColumns(
        {
            "failed": failed,
            "failure_rate": ratio(failed, requested),
            "status": F.when(requested == 0, "EMPTY")
            .when(successful == 0, "ALL_FAILED")
            .when(failed > 0, "PARTIAL_FAILURE")
            .otherwise("SUCCESS"),
        }
    )


def condition_text_stats(records: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean, exact median and sample deviation of each metric over the successful rows.

    The median keeps one counter per distinct value; metrics carry four decimals, which bounds that map.
    """
    aggs: list[Column] = [F.count("*").alias("sample_size")]
    for m in metrics:
        aggs += [
            mean4(m).alias(f"{m}_mean"),
            F.round(F.median(m), 4).alias(f"{m}_median"),
            F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 4).alias(f"{m}_std"),
        ]
    return records.where(F.col("status") == "success").groupBy(*(keys or ["condition_id"])).agg(*aggs)


def metric_summary(
    records: DataFrame, metrics: list[str], keys: list[str] | None = None, estimators: dict[str, resampling.Estimator] | None = None,
    iterations: int = 1000, ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Per group and metric of the successful rows: ``(*keys, metric, sample_size, mean, median, std, ci_lower, ci_upper)``.

    The interval is the bootstrap's for the mean, or for the metric's estimator in ``estimators`` (``resampling``). Medians
    and intervals work on value counts by ranges of values, so any number of groups, metrics and rows may be given; the
    two are joined by group and metric. Nulls of a metric are left out of it, and a metric without values has no row.
    """
    keys = keys or ["condition_id"]
    rows = records.where(F.col("status") == "success").select(*keys, *metrics)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    moments = rows.select(*keys, F.explode(each).alias("_m")).select(*keys, "_m.metric", "_m.v").where("v IS NOT NULL").groupBy(
        *keys, "metric").agg(
            F.count("*").alias("sample_size"), mean4("v").alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("std"))
    medians = quantiles.exact_quantiles(rows, metrics, [0.5], keys)
    chosen = {m: (estimators or {}).get(m, resampling.mean(m)) for m in metrics}
    intervals = resampling.bootstrap(rows, chosen, keys, iterations, ci, seed)
    group = [*keys, "metric"]
    met = moments.alias("m").join(medians.alias("q"), quantiles.same("m", "q", group)).join(intervals.alias("i"), quantiles.same("m", "i", group))
    return met.select(
        *[f"m.{k}" for k in group], "m.sample_size", "m.mean", F.round(F.col("q.quantiles")[0], 4).alias("median"), "m.std", "i.ci_lower", "i.ci_upper")


# Hash bootstrap ---------------------------------------------------------------------------------------------


def poisson_thresholds(levels: int = 12) -> list[str]:
    """Eight-digit hex cut points of the Poisson(1) distribution function over 32-bit hashes."""
    cuts, total = [], 0.0
    for k in range(levels):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(f"{min(int(total * 2**32), 2**32 - 1):08x}")
    return cuts


#: Cells that a task keeps of its sums before it hands them on, and draws that are held at once.
SUM_CELLS, DRAW_CELLS = 4_000_000, 2_000_000


def _lane_sums(batches: Iterator[pa.RecordBatch], keys: list[str], iterations: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sums of weights and of weighted values per group and replicate, from rows in which a document's are neighbours.

    The weights belong to the document, so they are drawn once for all of its rows in a batch, and a batch is one product
    of (replicates x documents) by (documents x groups). Sums stay in the task until they hold too many cells.
    """
    cuts = np.array([int(c, 16) for c in poisson_thresholds()], np.uint32)
    heads = [f"{seed}:{b}".encode() for b in range(iterations // 4)]
    room, step = max(1, SUM_CELLS // iterations), max(1, DRAW_CELLS // max(iterations, 1000))
    sums: dict[tuple, list] = {}
    types: list[pa.DataType] = []

    def weights(document: str | None) -> np.ndarray:
        tail = b"" if document is None else b":" + document.encode()
        raw = b"".join(hashlib.md5(h + tail, usedforsecurity=False).digest() for h in heads)
        return np.searchsorted(cuts, np.frombuffer(raw, ">u4"), side="right")

    def flush() -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate(types)]
        longs = pa.list_(pa.int64())
        arrays += [pa.array([v[i] for v in sums.values()], kind) for i, kind in enumerate([pa.int64(), pa.int64(), longs, longs])]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", "x", "w", "s"])

    for whole in batches:
        types = [whole.schema.field(k).type for k in keys]
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            document = batch.column("_d").dictionary_encode(null_encoding="encode")
            groups = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
            codes = np.stack([np.zeros(batch.num_rows, np.int64), *[g.indices.to_numpy() for g in groups]], axis=1)
            found, first, group = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            group, place, x = group.reshape(-1), document.indices.to_numpy(), batch.column("_x").to_numpy()
            names = [tuple(g.dictionary[int(c)].as_py() for g, c in zip(groups, row[1:])) for row in found]
            drawn = np.stack([weights(d) for d in document.dictionary.to_pylist()], axis=1)
            # Sums of whole numbers below 2**53 are exact in doubles, whose products are much faster.
            kind = np.float64 if np.abs(x.astype(np.float64)).max() * len(cuts) * len(x) < 2.0**53 else np.int64
            values, rows = (np.zeros((len(document.dictionary), len(names)), kind) for _ in range(2))
            np.add.at(values, (place, group), x.astype(kind))
            np.add.at(rows, (place, group), 1)
            w, s = ((drawn.astype(kind) @ m).T.astype(np.int64) for m in (rows, values))
            for k, (name, n) in enumerate(zip(names, np.bincount(group).tolist(), strict=True)):
                kept = sums.get(name, [0, int(x[first[k]]), 0, 0])
                sums[name] = [kept[0] + n, kept[1], kept[2] + w[k], kept[3] + s[k]]
            if len(sums) > room:
                yield flush()
    if sums:
        yield flush()


def bootstrap_ci(
    records: DataFrame, value: str, keys: list[str], iterations: int = 1000, ci: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile interval of the mean with Poisson(1) row weights drawn from md5(seed:block:document).

    One hash serves four replicates and all groups that a document is in: rows meet by document, and each task sums
    weights by values in matrix products. Weights and four-decimal values are summed as integers, so the result does
    not depend on row order, and a task leaves keys x iterations sums to shuffle.
    """
    if iterations % 4:
        raise ValueError("iterations must be a multiple of 4")
    x = F.round(F.col(value) * 10_000).cast("long")
    rows = records.select(*keys, F.col("document_id").cast("string").alias("_d"), x.alias("_x")).where(F.col("_x").isNotNull())
    met = rows.repartition("_d").sortWithinPartitions("_d")
    kinds = dict(rows.dtypes)
    fields = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, x long, w array<long>, s array<long>"])
    parts = met.mapInArrow(lambda batches: _lane_sums(batches, keys, iterations, seed), fields)
    lanes = parts.select(*keys, "n", "x", F.posexplode(F.arrays_zip("w", "s")).alias("_b", "_r")).groupBy(*keys, "_b").agg(
        F.sum("n").alias("n"), F.max("x").alias("_x"), F.sum("_r.w").alias("_w"), F.sum("_r.s").alias("_s"))
    alpha = 1.0 - ci
    cuts_at = F.array(F.lit(alpha / 2.0), F.lit(1.0 - alpha / 2.0))
    mean = F.when(F.col("_w") > 0, F.col("_s") / F.col("_w") / 10_000)
    one = F.col("_x") / 10_000
    # Of a fixed number of replicates.
    bounds = lanes.groupBy(*keys).agg(F.max("n").alias("n"), F.max("_x").alias("_x"), F.percentile(mean, cuts_at).alias("_q"))
    return bounds.select(
        *keys,
        "n",
        F.when(F.col("n") == 1, one).otherwise(F.round(F.col("_q")[0], 4)).alias("ci_lower"),
        F.when(F.col("n") == 1, one).otherwise(F.round(F.col("_q")[1], 4)).alias("ci_upper"),
    )


# Counted bootstrap ------------------------------------------------------------------------------------------


def bootstrap_ci_counts(
    records: DataFrame, values: list[str], keys: list[str], iterations: int = 1000, ci: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile interval of the mean by multinomial resampling of value counts.

    Resampling n rows with replacement is a multinomial draw over the distinct values, so the rows are first
    counted per (keys, metric, value). Values carry four decimals: a group holds its distinct values, never its
    rows, however many documents a condition has. The seed moves by 20 for each group in key order and by 1 for each
    metric, so that no two draw the same stream.
    """
    long = records.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("metric"), F.round(v, 4).alias("value")) for v in values])
        ).alias("_m"),
    ).select(*keys, "_m.metric", "_m.value")
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))
    group = [*keys, "metric"]
    places = counts.select(*keys).distinct().withColumn("_place", F.row_number().over(Window.orderBy(*keys)) - 1)
    counts = counts.join(F.broadcast(places), keys)  # one row per condition
    types = dict(counts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in group) + ", n long, ci_lower double, ci_upper double"
    low, high = 50.0 * (1.0 - ci), 100.0 - 50.0 * (1.0 - ci)

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        x, c = pdf["value"].to_numpy(), pdf["n"].to_numpy()
        n = int(c.sum())
        if n == 1:
            bounds = (float(x[0]), float(x[0]))
        else:
            rng = np.random.default_rng(seed + 20 * int(pdf["_place"].iloc[0]) + values.index(key[-1]))
            step = max(1, 2_000_000 // len(x))
            means = np.concatenate(
                [rng.multinomial(n, c / n, size=min(step, iterations - i)) @ x / n for i in range(0, iterations, step)]
            )
            bounds = tuple(round(float(np.percentile(means, q)), 4) for q in (low, high))
        return pd.DataFrame([[*key, n, *bounds]], columns=[*group, "n", "ci_lower", "ci_upper"])

    return counts.groupBy(*group).applyInPandas(resample, schema)


# Field statistics -------------------------------------------------------------------------------------------


def condition_field_stats(matches: DataFrame) -> DataFrame:
    """Match rates and precision/recall/F1 per (condition, field); F1 from the rounded rates."""
    rates = matches.groupBy("condition_id", "field_name").agg(
        F.round(F.avg(F.col("match_raw").cast("int")), 4).alias("match_rate_raw"),
        F.round(F.avg(F.col("match_normalized").cast("int")), 4).alias("match_rate_normalized"),
    )
    prf = scoring.field_prf(matches, keys=["condition_id"], f1_from_rounded=True)
    return rates.join(prf, ["condition_id", "field_name"])


def condition_kie_summary(matches: DataFrame) -> DataFrame:
    """Exact-match means, mean match fraction, macro rates over fields and the entity block per condition.

    ``mean_match_fraction`` is what run summaries call macro F1; ``macro_f1_normalized`` is the field average.
    """
    documents = matches.groupBy("condition_id", "document_id").agg(
        F.bool_and("match_raw").alias("raw"),
        F.bool_and("match_normalized").alias("normalized"),
        F.avg(F.col("match_normalized").cast("int")).alias("fraction"),
    )
    means = documents.groupBy("condition_id").agg(
        F.count("*").alias("sample_size"),
        F.round(F.avg(F.col("raw").cast("int")), 4).alias("raw_doc_em_rate"),
        F.round(F.avg(F.col("normalized").cast("int")), 4).alias("normalized_doc_em_rate"),
        F.round(F.avg("fraction"), 4).alias("mean_match_fraction"),
    )
    prf = scoring.field_prf(matches, keys=["condition_id"], f1_from_rounded=True)
    return means.join(scoring.macro_and_entity(prf, keys=["condition_id"]), "condition_id")


def run_totals(counts: DataFrame) -> DataFrame:
    """Sums over conditions and the overall failure rate."""
    return counts.agg(
        F.count("*").alias("conditions"),
        F.sum("requested").alias("total_requested"),
        F.sum("successful").alias("total_successful"),
        F.sum("failed").alias("total_failed"),
    ).withColumn("failure_rate", ratio(F.col("total_failed"), F.col("total_requested")))


def run_integrity(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, expected, actual, ok) from pairs of one-row, one-column frames."""
    out = None
    for name, (expected, actual) in checks.items():
        e, a = expected.toDF("expected"), actual.toDF("actual")
        row = e.crossJoin(a).select(
            F.lit(name).alias("check"),
            F.col("expected").cast("double").alias("expected"),
            F.col("actual").cast("double").alias("actual"),
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def latency_stats(samples: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, median, population deviation, extremes and exact p90/p95/p99, two decimals.

    Percentiles are found over value ranges (``quantiles``), so any number of different times may be given.
    """
    keys = keys or []
    v = F.col(value)
    two = lambda c: F.round(c, 2)
    stats = samples.groupBy(*keys).agg(
        two(F.avg(v)).alias("mean_ms"), two(F.stddev_pop(v)).alias("std_ms"), two(F.min(v)).alias("min_ms"), two(F.max(v)).alias("max_ms"))
    places = {f"{n}_ms": (value, k) for k, n in enumerate(("median", "p90", "p95", "p99"))}
    found = quantiles.exact_quantiles(samples, [value], [0.5, 0.9, 0.95, 0.99], keys)
    return quantiles.with_quantiles(stats, found, places, keys).withColumns({n: two(n) for n in places})


def speedup_projection(slow: DataFrame, fast: DataFrame, evaluations: int) -> DataFrame:
    """Speed-up of two one-row latency frames and projected hours for a number of evaluations."""
    a = slow.select(F.col("mean_ms").alias("a_mean"), F.col("median_ms").alias("a_median"))
    b = fast.select(F.col("mean_ms").alias("b_mean"), F.col("median_ms").alias("b_median"))
    floor = lambda c: F.greatest(F.col(c), F.lit(0.001))
    hours = lambda c: F.round(evaluations * (F.col(c) / 1000.0) / 3600.0, 2)
    return a.crossJoin(b).select(
        F.round(F.col("a_mean") / floor("b_mean"), 2).alias("mean_speedup"),
        F.round(F.col("a_median") / floor("b_median"), 2).alias("median_speedup"),
        hours("a_mean").alias("hours_a"),
        hours("b_mean").alias("hours_b"),
        F.round(hours("a_mean") - hours("b_mean"), 2).alias("hours_saved"),
    )
