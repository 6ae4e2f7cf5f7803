import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscore.operators import stats as X


def sample(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(c, i, round(float(v), 4)) for c in ("a", "b") for i, v in enumerate(rng.beta(2, 5, n))]
    return rows, spark.createDataFrame(rows, "condition_id string, document_id int, cer double")


def plain_interval(values, iterations=1000, seed=42):
    rng = np.random.default_rng(seed)
    v = np.asarray(values)
    means = v[rng.integers(0, len(v), (iterations, len(v)))].mean(axis=1)
    return np.percentile(means, [2.5, 97.5])


@pytest.mark.parametrize("kind", ["hash", "counts"])
def test_interval_agrees_with_plain_resampling(spark, kind):
    rows, df = sample(spark)
    out = X.bootstrap_ci(df, "cer", ["condition_id"]) if kind == "hash" else X.bootstrap_ci_counts(df, ["cer"], ["condition_id"])
    for r in out.collect():
        low, high = plain_interval([v for c, _, v in rows if c == r["condition_id"]])
        assert r["ci_lower"] == pytest.approx(low, abs=0.004) and r["ci_upper"] == pytest.approx(high, abs=0.004)


def test_intervals_do_not_depend_on_partitioning(spark):
    _, df = sample(spark, 60)
    for fn in (lambda d: X.bootstrap_ci(d, "cer", ["condition_id"], iterations=200),
               lambda d: X.bootstrap_ci_counts(d, ["cer"], ["condition_id"], iterations=200)):
        assert sorted(map(tuple, fn(df.repartition(1)).collect())) == sorted(map(tuple, fn(df.repartition(7)).collect()))


def test_single_value_and_hot_condition(spark):
    rows = [("one", 1, 0.125)] + [("hot", i, (i % 7) / 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "condition_id string, document_id int, cer double")
    got = {r["condition_id"]: r for r in X.bootstrap_ci(df, "cer", ["condition_id"], iterations=200).collect()}
    assert (got["one"]["ci_lower"], got["one"]["ci_upper"]) == (0.125, 0.125)
    counted = X.bootstrap_ci_counts(df, ["cer"], ["condition_id"], iterations=200)
    assert {r["condition_id"]: r["n"] for r in counted.collect()} == {"one": 1, "hot": 3000}


def test_latency_stats_match_numpy(spark):
    v = [100.0, 110.5, 90.25, 300.0, 120.0, 95.0]
    r = X.latency_stats(spark.createDataFrame([(x,) for x in v], "ms double"), "ms").first()
    want = dict(mean_ms=np.mean(v), median_ms=np.median(v), std_ms=np.std(v), min_ms=90.25, max_ms=300.0,
                p90_ms=np.percentile(v, 90), p95_ms=np.percentile(v, 95), p99_ms=np.percentile(v, 99))
    for k, w in want.items():
        assert r[k] == pytest.approx(w, abs=0.0051)


def test_run_integrity(spark):
    one = lambda v: spark.range(1).select(F.lit(v))
    got = X.run_integrity({"rows": (one(5), one(5)), "delta": (one(0), one(1))}).collect()
    assert {r["check"]: r["ok"] for r in got} == {"rows": True, "delta": False}


def test_hash_weights_are_drawn_once_per_document(spark):
    """Against weights drawn one by one; repeated rows, null keys and documents, large values, one batch or many."""
    import hashlib

    rows = [("a", d, d * 0.1001) for d in range(40)] + [("b", d % 7, -d * 1.5) for d in range(30)] + [
        (None, None, 0.25), (None, 3, None), (None, 4, 0.5), ("big", 1, 9e13), ("big", 2, 8e13)]
    df = spark.createDataFrame(rows, "condition_id string, document_id int, cer double")
    cuts = X.poisson_thresholds()

    def weight(d, i):
        text = ":".join(["42", str(i // 4)] + ([] if d is None else [str(d)]))
        part = hashlib.md5(text.encode()).hexdigest()[8 * (i % 4):][:8]
        return sum(part >= c for c in cuts)

    want = {}
    for key in ("a", "b", None, "big"):
        own = [(d, round(v * 10_000)) for c, d, v in rows if c == key and v is not None]
        means = []
        for i in range(40):
            w = [weight(d, i) for d, _ in own]
            if sum(w):
                means.append(sum(a * x for a, (_, x) in zip(w, own)) / sum(w) / 10_000)
        want[key] = (len(own), *np.percentile(means, [2.5, 97.5]))
    found = X.bootstrap_ci(df, "cer", ["condition_id"], iterations=40)
    got = {r["condition_id"]: (r["n"], r["ci_lower"], r["ci_upper"]) for r in found.collect()}
    assert set(got) == set(want)
    for key, (n, low, high) in want.items():
        assert got[key][0] == n and got[key][1:] == pytest.approx((low, high), abs=0.00006, rel=1e-15)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert X.bootstrap_ci(df.where("false"), "cer", ["condition_id"]).collect() == []
