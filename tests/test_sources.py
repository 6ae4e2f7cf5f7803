import json

import pytest
from pyspark.sql import functions as F

from leafscore.operators import audit as A
from leafscore.operators import sampling as P
from leafscore.sources import corpus, runs
from leafscore.sources.tables import matrix_frames, read_matrix_config, read_ops_tables

GOOD = {"company": "RESTAURANT XYZ", "date": "01/01/2019", "address": "PENANG, JALAN RAYA", "total": "RM 120.50", "cashier": "C1"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "nested"
    files = {
        "train/img/doc_1.jpg": b"\xff\xd8\xff", "train/img/doc_2.PNG": b"", "train/img/.hidden.jpg": b"x", "train/img/notes.md": b"x",
        "train/box/doc_1.txt": "﻿10,10,100,10,100,30,10,30,BOOK STORE SDN BHD\r\n\r\n5,55,140,55,140,75,5,75,PENANG, JALAN RAYA\r\n".encode(),
        "train/box/doc_2.txt": b"10,20,30,MALFORMED\n1,2,3,4,5,6,7,nan,x\n1,2,3,4,5,6,7,8,9,10,extra\n1,2,3,4,5,6,7,8,9,ten,fine\n-10,10,150,10,150,40,-10,40,OUT\n",
        "train/entities/doc_1.txt": json.dumps(GOOD).encode(),
        "train/entities/doc_2.json": b'{"company": "BAD", "date": "x"}',
        "train/entities/orphan.txt": b'{"company":"A","date":"d","address":"a","total":5}',
        "test/box/doc_1.txt": b"1,1,2,1,2,2,1,2,T\n",
        "test/entities/doc_9.txt": b"[1]",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_corpus_index(spark, tree):
    rows = {(r["split"], r["stem"]): r for r in corpus.read_corpus_index(spark, tree).collect()}
    assert set(rows) == {("train", "doc_1"), ("train", "doc_2"), ("train", "orphan"), ("test", "doc_1"), ("test", "doc_9")}
    assert rows["train", "doc_2"]["img_path"].endswith("doc_2.PNG")
    assert {k for k, r in rows.items() if r["is_document"]} == {("train", "doc_1"), ("train", "doc_2"), ("test", "doc_1"), ("test", "doc_9")}


def test_a_folder_is_listed_in_ranges_of_names(tmp_path):
    folder = tmp_path / "train" / "img"
    folder.mkdir(parents=True)
    names = {f"X{k:04d}.jpg" for k in range(0, 900, 3)} | {"é.jpg", "0.png"}
    for k, name in enumerate(sorted(names)):
        (folder / name).write_bytes(b"x" * (k % 4))
    (folder / "inner").mkdir()
    reader = corpus.CorpusTreeReader(str(tmp_path), 7)
    parts = reader.partitions()
    found = [list(reader.read(p)) for p in parts]
    assert len(parts) == 7 and max(map(len, found)) < 60
    rows = [r for part in found for r in part]
    assert {r[2] for r in rows} == names and len(rows) == len(names)
    assert sum(r[3] == 0 for r in rows) == sum(k % 4 == 0 for k in range(len(names)))


def test_written_tree_reads_back_with_zero_length_files(spark, tmp_path):
    rows = [("train", "img", f"a {k}.jpg", k % 3) for k in range(40)] + [("test", "box", "ü.txt", 0), ("test", "box", "b.md", 3)]
    files = spark.createDataFrame(rows, "split string, kind string, name string, size bigint").repartition(3)
    assert corpus.write_corpus_tree(files, str(tmp_path / "t")) == 42
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t"):
        got = sorted(map(tuple, corpus.read_corpus_files(spark, root).collect()))
        assert got == sorted((s, k, n.rsplit(".", 1)[0], z) for s, k, n, z in rows if not n.endswith(".md"))
    index = {r.stem: r for r in corpus.read_corpus_index(spark, str(tmp_path / "t")).collect()}
    assert index["ü"].is_document and index["a 7"].img_path.endswith("train/img/a 7.jpg")


def test_missing_and_empty_trees(spark, tmp_path):
    assert corpus.read_corpus_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no corpus"):
        corpus.read_corpus_files(spark, str(tmp_path / "none")).count()


def test_box_lines(spark, tree):
    rows = corpus.read_box_lines(spark, tree)
    good, bad = A.quarantine(rows.where("split = 'train'"))
    assert {r["transcript"] for r in good.collect()} == {"BOOK STORE SDN BHD", "PENANG, JALAN RAYA", "9,ten,fine", "OUT"}
    assert sorted(r["reason"] for r in bad.collect()) == ["extra_coordinates", "non_finite", "too_few_parts"]
    out = good.where("transcript = 'OUT'").first()
    assert (out["x_min"], out["x_max"], out["y_min"], out["y_max"]) == (-10.0, 150.0, 10.0, 40.0)
    text = {(r["split"], r["document_id"]): r["full_text"] for r in corpus.full_text(rows).collect()}
    assert text["train", "doc_1"] == "BOOK STORE SDN BHD\nPENANG, JALAN RAYA"


def test_entities(spark, tree):
    rows = {r["document_id"]: r for r in corpus.read_entities(spark, tree).collect()}
    assert rows["doc_1"]["reason"] is None and rows["doc_1"]["total"] == "RM 120.50" and json.loads(rows["doc_1"]["metadata"]) == {"cashier": "C1"}
    assert {k: r["reason"] for k, r in rows.items() if r["reason"]} == {"doc_2": "missing_keys", "orphan": "not_a_string", "doc_9": "not_an_object"}


def test_audit_on_the_tree(spark, tree):
    files = corpus.read_corpus_files(spark, tree)
    boxes, entities = corpus.read_box_lines(spark, tree), corpus.read_entities(spark, tree)
    sizes = spark.createDataFrame([("doc_2", 120, 50)], "document_id string, width int, height int")
    report = A.audit_report(
        A.audit_files(files), A.audit_polygons(boxes), A.audit_boxes(boxes, sizes), A.audit_entities(entities), A.audit_isolation(files), A.audit_triplets(files))
    got = {r["name"]: (r["errors"], r["warnings"], r["status"]) for r in report.collect()}
    assert got["image_file_exists"] == (1, 0, "FAILED") and got["ocr_file_exists"] == (0, 0, "PASSED")
    assert got["ocr_polygons_valid"] == (3, 0, "FAILED") and got["bbox_geometry_bounds"] == (0, 1, "PASSED")
    assert got["kie_file_exists_and_valid_json"] == (1, 0, "FAILED") and got["kie_required_keys_and_string_values"][0] == 2
    assert got["id_uniqueness_and_split_isolation"][0] == 1
    counts = {r["split"]: r for r in A.audit_counts(files, {"train": 2, "test": 1}, strict=True).collect()}
    assert counts["train"]["ok"] and counts["test"]["severity"] == "error" and not counts["test"]["ok"]


def test_split_guard(spark, tree):
    files = corpus.read_corpus_files(spark, tree)
    with pytest.raises(PermissionError):
        P.resolve_split(files, "test_set")
    assert P.resolve_split(files, "test", allow_test=True).count() == 2


def test_splits_are_stable_disjoint_and_sized(spark):
    ids = spark.range(900).select(F.col("id").alias("document_id"))
    a = {tuple(r) for r in P.split_assign(ids).collect()}
    assert a == {tuple(r) for r in P.split_assign(ids.repartition(9)).collect()}
    dev, val = ({i for i, s in a if s == name} for name in ("development", "validation"))
    assert (len(dev), len(val), dev & val) == (500, 126, set())
    assert a != {tuple(r) for r in P.split_assign(ids, seed=7).collect()}
    assert P.subset_sample(ids, 40).count() == 40 and P.subset_sample(ids, 5000).count() == 900


def test_config_hash_ignores_order_and_volatile_keys(spark):
    rows = [(1, "a", "1"), (1, "b", "2"), (1, "pid", "77"), (2, "b", "2"), (2, "a", "1"), (2, "timestamp", "now"), (3, "a", "2")]
    got = dict(map(tuple, P.config_hash(spark.createDataFrame(rows, "config_id int, key string, value string")).collect()))
    assert got[1] == got[2] != got[3]


def test_record_checks(spark):
    rows = [(1, "0.5", 0.0, 0.0, 1.0, 1.0), (2, "x", 2.0, 0.0, 1.0, 1.0), (None, "1.5", 0.0, 0.0, float("nan"), 1.0), (3, "NaN", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "document_id int, confidence string, x_min double, y_min double, x_max double, y_max double")
    got = [set(r["violations"]) for r in A.record_checks(df).collect()]
    assert got[0] == set() and got[1] == {"confidence_not_a_number", "box_inverted"}
    assert {"empty_id", "confidence_out_of_range", "box_not_finite"} <= got[2] and "confidence_not_finite" in got[3]


def test_run_records_round_trip(spark, tmp_path):
    path = tmp_path / "records.jsonl"
    path.write_text('{"condition_id":"a","document_id":"1","status":"success","ocr_metrics":{"cer_raw":0.5}}\n\n{"condition_id":"a","document_id":"1","status":"ocr_failed"}\nbroken\n')
    rows = runs.read_run_records(spark, str(path))
    assert rows.count() == 2
    last = runs.last_per_document(rows.withColumn("n", F.monotonically_increasing_id()), "n").first()
    assert last["status"] == "ocr_failed"
    out = str(tmp_path / "out")
    runs.write_run_records(rows, out)
    assert runs.read_run_records(spark, out).where("condition_id = 'a'").count() == 2


def test_condition_csv_defaults(spark, tmp_path):
    path = tmp_path / "b1.csv"
    names = [c.split()[0] for c in runs.B1_COLUMNS.split(", ")]
    path.write_text(",".join(names) + "\n" + ",".join(["D1_S1_P0", "D1", "Blur", "S1"] + ["0.5"] * 17 + [""]) + "\n")
    row = runs.read_condition_csv(spark, str(path), runs.B1_COLUMNS, {"f_tot": 0.0}).first()
    assert row["cer"] == 0.5 and row["f_tot"] == 0.0


def test_ops_tables_and_config(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert read_ops_tables(spark, str(tmp_path), ("documents",))["documents"].count() == 3
    (tmp_path / "m.yaml").write_text("matrix:\n  degradations: [rotation]\n  severities: [0, 2]\n  preprocessing_pipelines: {p_b: [], p_a: []}\n")
    d, s, p = matrix_frames(spark, read_matrix_config(str(tmp_path / "m.yaml")))
    assert [r[0] for r in d.collect()] == ["rotation"] and [r[0] for r in s.collect()] == [2] and [r[0] for r in p.collect()] == ["p_a", "p_b"]
