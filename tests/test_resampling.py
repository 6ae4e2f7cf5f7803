import random

import numpy as np
import pytest

from leafscore.operators import resampling as R


def table(spark, seed=1, n=500):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(["a", "a", "a", None])
        x = round(rng.choice([rng.betavariate(2, 5), rng.gauss(3, 2), 0.25]), 4)
        rows.append((kind, k, None if k % 50 == 7 else x, round(rng.uniform(1, 4), 2), round(rng.expovariate(0.01), 4)))
    rows += [("one", -1, 0.125, 2.0, 9.5), ("none", -2, None, 1.0, None)]
    return rows, spark.createDataFrame(rows, "kind string, id int, x double, w double, ms double").repartition(5)


def plain(rows, kind, statistic, iterations=4000):
    rng = np.random.default_rng(7)
    own = np.array([r[2:] for r in rows if r[0] == kind and r[2] is not None], float)
    own = own[rng.integers(0, len(own), (iterations, len(own)))]
    return np.percentile([statistic(s) for s in own], [2.5, 97.5])


STATISTICS = {
    "mean": (R.mean("x"), lambda s: s[:, 0].mean()), "median": (R.median("x"), lambda s: np.median(s[:, 0])),
    "p90": (R.quantile("x", 0.9), lambda s: np.quantile(s[:, 0], 0.9)), "ratio": (R.ratio("x", "w"), lambda s: s[:, 0].sum() / s[:, 1].sum()),
    "wide": (R.mean("ms"), lambda s: s[:, 2].mean()),
}


def test_intervals_agree_with_plain_resampling(spark):
    rows, df = table(spark)
    df = df.where("x IS NOT NULL OR kind = 'none'")
    found = {(r.kind, r.metric): r for r in R.bootstrap(df, {k: e for k, (e, _) in STATISTICS.items()}, ["kind"]).collect()}
    assert {k for k, _ in found} == {"a", None, "one"}
    for name, (_, statistic) in STATISTICS.items():
        for kind in ("a", None):
            low, high = plain(rows, kind, statistic)
            r = found[kind, name]
            assert r.n == sum(x[0] == kind and x[2] is not None for x in rows)
            wide = max(high - low, 0.01)
            assert abs(r.ci_lower - low) < 0.2 * wide and abs(r.ci_upper - high) < 0.2 * wide, (name, kind, r, low, high)
    assert (found["one", "mean"].ci_lower, found["one", "median"].ci_upper, found["one", "ratio"].ci_lower) == (0.125, 0.125, 0.0625)


def test_neither_partitions_nor_order_matter(spark):
    _, df = table(spark, 3, 200)
    few = {"m": R.mean("x"), "q": R.median("x")}
    got = [sorted(map(str, R.bootstrap(d, few, ["kind"], iterations=150).collect())) for d in (df.coalesce(1), df.repartition(7), df.orderBy("x"))]
    assert got[0] == got[1] == got[2]
    other = sorted(map(str, R.bootstrap(df, few, ["kind"], iterations=150, seed=1).collect()))
    assert other != got[0]


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_no_values(spark, rows):
    assert R.bootstrap(spark.createDataFrame(rows, "x double"), {"m": R.mean("x")}, [], iterations=10).count() == 0
