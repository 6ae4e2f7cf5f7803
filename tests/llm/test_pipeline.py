import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafscore.llm.exact_dedup import exact_dedup
from leafscore.llm.queries import ORACLES, QUERIES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_is_answered(spark, name):
    table, key = {"op10": ("pages", "page_id"), "op12": ("benchmark", "item_id")}.get(name[:4], ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in QUERIES[name](spark, SF).select(key).collect()} == want


def test_stages_keep_their_promises(spark, make, tmp_path):
    rows = [(k, f"the quick brown fox number {k} jumps over the lazy dog near the old river bank today", "en", f"s{k % 3}") for k in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, None, None, "s1"), (102, "12345 !!", None, "s1")]
    long = " ".join(f"w{k}" for k in range(80))
    rows += [(200, long, "en", "s2"), (201, long + " tail", "en", "s2")]
    docs = make(rows)
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, out, SF).write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in out.collect()]
        if name != "pack":
            assert out.columns == docs.columns
    assert set(seen["language"]) == {r[0] for r in rows} - {101, 102}
    assert set(seen["exact_dedup"]) == set(seen["language"]) - {100}
    assert set(seen["near_dedup"]) == set(seen["exact_dedup"]) - {201}
    assert set(seen["mix"]) <= set(seen["near_dedup"])
    assert sorted(set(seen["pack"])) == sorted(set(seen["mix"])) and len(seen["pack"]) >= len(seen["mix"])


def test_run_applies_all_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(found.columns)
    ids = {r.doc_id for r in found.collect()}
    assert ids and ids <= {r.doc_id for r in exact_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}


def test_language_stage_rejects_what_is_unlike_the_learned_languages(spark):
    import base64
    import random

    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    rng = random.Random(4)
    junk = []
    for size in (60, 300, 2000):
        junk += ["".join(rng.choice(letters) for _ in range(size)) for letters in (
            "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz   ", [chr(c) for c in range(0x4E00, 0x8E00)], "абвгдежзиклмнопрсту   ", "ابتثجحخدذرزسش  ")]
        junk += [base64.b64encode(rng.randbytes(size)).decode(), ("for (int i = 0; i < n; ++i) { buf[i] ^= key[i % 16]; } " * 40)[:size]]
    first = docs.first().asDict()
    rows = [{**first, "doc_id": 10**9 + k, "text": t, "lang": None} for k, t in enumerate(junk)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF).collect()}
    assert not [t[:40] for k, t in kept.items() if k >= 10**9]
    clean = docs.where(r"lang IS NOT NULL AND text RLIKE '\\p{L}'").select("doc_id", F.length("text").alias("n")).collect()
    assert sum(r.doc_id in kept for r in clean) >= 0.985 * len(clean)
    short = [r for r in clean if r.n < 60]
    assert sum(r.doc_id in kept for r in short) >= 0.9 * len(short)
