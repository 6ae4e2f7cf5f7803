import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from leafscore.operators.canonical import canonical_json, nested_config_hash
from leafscore.operators.sampling import VOLATILE_KEYS


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if k not in VOLATILE_KEYS}
    return [plain(v) for v in value] if isinstance(value, list) else value


def dumped(value):
    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def tree(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        keys = ["a", "B", "é", 'q"uote', "line\nend", "z/", *VOLATILE_KEYS[:3]]
        return {k: tree(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 6))}
    if depth and kind < 0.7:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, -7, 12345678901, 0.5, 2.25, "", "text", "1", "ü\t\\", "字"])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "config_id int, t string").select("config_id", F.parse_json("t").alias("config"))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sorted_dumps_at_any_depth(spark, seed):
    rng = random.Random(seed)
    values = [tree(rng, 5) for _ in range(60)] + [{}, [], {"pid": 1}, [[[[[[["deep"]]]]]]]]
    got = {r.config_id: r.config_hash for r in nested_config_hash(frame(spark, [json.dumps(v) for v in values])).collect()}
    assert got == {k: hashlib.sha256(dumped(v).encode()).hexdigest() for k, v in enumerate(values)}


def test_order_spacing_and_run_time_keys_do_not_matter(spark):
    texts = ['{"a": {"x": 1.50, "pid": 3}, "b": [1, 2]}', '{"b":[1,2],"run_id":"r","a":{"x":1.5}}', '{"b":[2,1],"a":{"x":1.5}}', '{"b":["1",2],"a":{"x":1.5}}']
    a, b, c, d = (r[1] for r in nested_config_hash(frame(spark, texts)).orderBy("config_id").collect())
    assert a == b and len({a, c, d}) == 3


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "null"), (None, '{"k":1}'), (None, '{"k":1}')], "config_id int, t string").select(
        "config_id", F.try_parse_json("t").alias("config"))
    got = sorted(str(r.canonical) for r in canonical_json(df, "config").collect())
    assert got == ["None", "null", '{"k":1}', '{"k":1}']
    assert nested_config_hash(df.limit(0)).count() == 0
