import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscore.operators import quantiles as Q
from leafscore.operators import stats as X


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [("hot", rng.choice([rng.random(), 0.25, 7.5]), rng.randint(0, 5) / 4) for _ in range(4000)]
    rows += [("one", 3.5, None)] + [(None, rng.gauss(0, 1), 2.0) for _ in range(37)] + [("none", None, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "kind string, a double, b double").repartition(6)


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_quantiles_match_numpy(spark, slices):
    rows, df = table(spark)
    cuts = [0.0, 0.025, 0.5, 0.9, 0.99, 1.0]
    found = {(r.kind, r.metric): r for r in Q.exact_quantiles(df, ["a", "b"], cuts, ["kind"], slices=slices).collect()}
    want = {(k, m): [r[i] for r in rows if r[0] == k and r[i] is not None] for k in ("hot", "one", None) for i, m in ((1, "a"), (2, "b"))}
    want = {k: v for k, v in want.items() if v}
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k].n == len(v)
        assert found[k].quantiles == pytest.approx(list(np.quantile(v, cuts)), abs=1e-12)


def test_a_hot_group_spreads_over_slices_in_order(spark):
    _, df = table(spark)
    cut = Q.sliced(Q.value_counts(df, ["a"], ["kind"]), ["kind"], 16)
    hot = cut.where("kind = 'hot'").groupBy("slice").agg(F.min("value"), F.max("value"), F.count("*")).orderBy("slice").collect()
    assert len(hot) >= 12 and max(r[3] for r in hot) < 500
    assert all(x[2] < y[1] for x, y in zip(hot, hot[1:]))


def test_without_keys_and_without_rows(spark):
    _, df = table(spark)
    assert Q.exact_quantiles(df, ["a"], [0.5]).count() == 1
    assert Q.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0
    row = X.latency_stats(df.where("a IS NULL"), "a").first()
    assert row.mean_ms is None and row.p99_ms is None


def test_no_percentile_buffer_in_the_plans(spark):
    _, df = table(spark)
    plan = X.latency_stats(df, "a", ["kind"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_counts(spark):
    rows, df = table(spark)
    found = {(r.kind, r.value): r.n for r in Q.value_counts(df, ["b"], ["kind"], 1).collect()}
    want = Counter((k, float(F_round(b))) for k, _, b in rows if b is not None)
    assert found == dict(want)


def F_round(x):
    """Half up at one decimal, as SQL rounds."""
    return int(x * 10 + 0.5) / 10
