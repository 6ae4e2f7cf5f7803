"""Bootstrap intervals of any estimator over resampled value counts, with groups that span tasks.

Resampling a group's N rows with replacement is a multinomial draw over its distinct values. The draw goes down a tree
over the values (in units of 1e-4): a node has at most 4,096 children, gets from its parent how many rows each replicate
puts into it, and deals them to its children by another multinomial. So the unit of work is a node, whatever the size
of its group, and as nodes are fixed ranges of values and seeded by their place, results depend on neither partitioning
nor row order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT = 12
UNIT = 10_000
#: Cells of a draw that are held at once.
CELLS = 2_000_000


class Estimator(NamedTuple):
    """What is computed on each replicate: a quantile, or the sum of the value over the sum of ``weight``.

    Without a weight column the latter is the mean.
    """

    value: str
    quantile: float | None = None
    weight: str | None = None


def mean(value: str) -> Estimator:
    return Estimator(value)


def median(value: str) -> Estimator:
    return Estimator(value, quantile=0.5)


def quantile(value: str, p: float) -> Estimator:
    return Estimator(value, quantile=p)


def ratio(value: str, weight: str) -> Estimator:
    """Sum of ``value`` over sum of ``weight``, rows being resampled as pairs."""
    return Estimator(value, weight=weight)


def _counts(rows: DataFrame, estimators: dict[str, Estimator], keys: list[str]) -> DataFrame:
    """``(*keys, metric, x, w, n)``: distinct (value, weight) pairs with their number of rows; nulls are left out."""
    unit = lambda c: F.round(F.col(c) * UNIT).cast("long")
    pairs = F.array(*[
        F.struct(F.lit(name).alias("metric"), unit(e.value).alias("x"), (unit(e.weight) if e.weight else F.lit(UNIT).cast("long")).alias("w"))
        for name, e in estimators.items()])
    long = rows.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.metric", "_m.x", "_m.w")
    return long.where("x IS NOT NULL AND w IS NOT NULL").groupBy(*keys, "metric", "x", "w").agg(F.count(F.lit(1)).alias("n"))


def _rng(seed: int, key: tuple) -> np.random.Generator:
    words = np.frombuffer(repr(tuple(None if pd.isna(k) else k for k in key)).encode(), np.uint8)
    return np.random.default_rng([seed, *words.tolist()])


def _draws(rng: np.random.Generator, given: np.ndarray, n: np.ndarray):
    """(first replicate, draws) of a bounded number of replicates at a time."""
    step = max(1, CELLS // len(n))
    for at in range(0, len(given), step):
        yield at, rng.multinomial(given[at: at + step], n / n.sum())


def bootstrap(
    rows: DataFrame, estimators: dict[str, Estimator], keys: list[str], iterations: int = 1000, ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """``(*keys, metric, n, ci_lower, ci_upper)``: percentile intervals of each named estimator per group, four decimals.

    Values and weights count with four decimals; rows in which either is null are left out, groups without rows have
    no result. Quantiles interpolate linearly between the two nearest ranks of a replicate. A ratio whose weights sum to
    zero in a replicate leaves that replicate out.
    """
    counts = _counts(rows, estimators, keys)
    group = [*keys, "metric"]
    kinds = dict(counts.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in group)
    cuts = {name: e.quantile for name, e in estimators.items()}
    # Nodes from the root down; the root of a group is the one range that holds all its values.
    widest = counts.agg(F.max(F.abs("x"))).first()[0] or 0
    levels = max(1, -(-(int(widest).bit_length() + 1) // SHIFT))
    node = lambda level: F.shiftright("x", SHIFT * level)

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["n"].sum())
        p = cuts[key[-1]]
        low = int(np.floor((total - 1) * p)) if p is not None else -1
        full = np.full(iterations, total)
        ranks = [np.full(iterations, r) for r in (low, min(low + 1, total - 1) if low >= 0 else -1)]
        return pd.DataFrame([[*key, 0, total, full, *ranks]], columns=[*group, "node", "total", "given", "low", "high"])

    def deal(key: tuple, above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        """Rows of each replicate, and the wanted ranks, from a node to its children."""
        below = below.sort_values("child")
        parent = above.iloc[0]
        given, n = np.asarray(parent["given"]), below["n"].to_numpy()
        found = np.concatenate([d for _, d in _draws(_rng(seed, key), given, n)])
        ends = found.cumsum(axis=1)
        ranks = []
        for rank in (np.asarray(parent["low"]), np.asarray(parent["high"])):
            inside = (rank[:, None] >= ends - found) & (rank[:, None] < ends) & (rank >= 0)[:, None]
            ranks.append(np.where(inside, rank[:, None] - (ends - found), -1))
        return pd.DataFrame({
            **{k: [v] * len(n) for k, v in zip(group, key)}, "node": below["child"].to_numpy(), "total": parent["total"],
            "given": list(found.T), "low": list(ranks[0].T), "high": list(ranks[1].T)})

    def close(key: tuple, above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        """A node's part of every replicate's sums, and the values at the wanted ranks that fall into it."""
        below = below.sort_values(["x", "w"])
        parent = above.iloc[0]
        x, w, n = (below[c].to_numpy() for c in ("x", "w", "n"))
        given, ranks = np.asarray(parent["given"]), [np.asarray(parent[c]) for c in ("low", "high")]
        sums = [np.zeros(iterations) for _ in range(4)]
        for at, found in _draws(_rng(seed, key), given, n):
            part = slice(at, at + len(found))
            sums[0][part], sums[1][part] = found @ x, found @ w
            if cuts[key[-2]] is not None:
                ends = found.cumsum(axis=1)
                for k, rank in enumerate(ranks):
                    here = rank[part]
                    place = (ends > here[:, None]).argmax(axis=1)
                    sums[2 + k][part] = np.where(here >= 0, x[place], 0)
        return pd.DataFrame([[*key[:-1], int(parent["total"]), *sums]], columns=[*group, "total", *"xwlh"])

    fields = f"{head}, node long, total long, given array<long>, low array<long>, high array<long>"
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("n"))
    state = sizes.groupBy(*group).applyInPandas(start, fields)
    for level in range(levels, 0, -1):
        above = F.lit(0).cast("long") if level == levels else node(level + 1)
        children = counts.groupBy(*group, above.alias("node"), node(level).alias("child")).agg(F.sum("n").alias("n"))
        state = state.groupBy(*group, "node").cogroup(children.groupBy(*group, "node")).applyInPandas(deal, fields)
    leaves = counts.withColumn("node", node(1))
    parts = state.groupBy(*group, "node").cogroup(leaves.groupBy(*group, "node")).applyInPandas(
        close, f"{head}, total long, x array<double>, w array<double>, l array<double>, h array<double>")
    each = parts.select(*group, "total", F.posexplode(F.arrays_zip("x", "w", "l", "h")).alias("r", "v"))
    each = each.groupBy(*group, "r").agg(F.first("total").alias("n"), *[F.sum(f"v.{c}").alias(c) for c in "xwlh"])
    value = F.when(F.col("w") != 0, F.col("x") / F.col("w"))
    for name, p in cuts.items():
        if p is not None:
            share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
            value = F.when(F.col("metric") == name, (F.col("l") + share * (F.col("h") - F.col("l"))) / UNIT).otherwise(value)
    bounds = F.percentile(value, F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))  # of a fixed number of replicates
    return each.groupBy(*group).agg(F.first("n").alias("n"), bounds.alias("_q")).select(
        *group, "n", F.round(F.col("_q")[0], 4).alias("ci_lower"), F.round(F.col("_q")[1], 4).alias("ci_upper"))
