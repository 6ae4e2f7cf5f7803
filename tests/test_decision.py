import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafscore.functions.scalars import COARSE_BUCKETS, FINE_BUCKETS, bucket, is_date_text, parse_amount
from leafscore.operators import decision as D
from leafscore.operators import issues as I

FIELDS = "document_id int, field_name string, value string, corrected_value string, confidence double"


@pytest.mark.parametrize("raw, want", [
    ("RM 12.50", 12.5), ("12O.50", None), ("1,234.50", 1234.5), ("12,5", 12.5), ("", None), ("$5", 5.0), ("5 USD", 5.0), ("-5", None), ("1.2.3", None),
])
def test_parse_amount(one, raw, want):
    assert one(parse_amount(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("2018-12-25", True), ("25/12/18", True), ("25 DEC 2018", True), ("DEC 25, 2018", True), ("1/2", False), ("25-12-2018 10:00", False), ("May", False),
])
def test_is_date_text(one, raw, want):
    assert one(is_date_text(F.col("x")), x=raw) is want


@pytest.mark.parametrize("value, coarse, fine", [
    (0.5, "0.00–0.59", "0.50–0.70"), (0.6, "0.60–0.69", "0.50–0.70"), (0.7, "0.70–0.79", "0.70–0.85"), (0.85, "0.80–0.89", "0.85–0.95"),
    (0.9, "0.90–1.00", "0.85–0.95"), (0.95, "0.90–1.00", "0.95–1.00"), (1.0, "0.90–1.00", "0.95–1.00"), (-0.1, None, None), (3.0, "0.90–1.00", "0.95–1.00"),
])
def test_bucket_edges(spark, value, coarse, fine):
    c = F.lit(value)
    assert tuple(spark.range(1).select(bucket(c, COARSE_BUCKETS), bucket(c, FINE_BUCKETS)).first()) == (coarse, fine)


def docs(spark, *types):
    return spark.createDataFrame(list(enumerate(types)), "document_id int, document_type string")


def test_validation_order_and_types(spark):
    fields = spark.createDataFrame([
        (0, "company", "A", None, 0.9), (0, "total", "0", None, 0.9), (0, "date", "soon", None, 0.9),
        (1, "company", "ACME", None, 0.9), (1, "date", "01/02/2019", None, 0.9),
        (2, "company", "ACME", " ", 0.9), (2, "date", "x", "01/02/2019", 0.9), (2, "total", "12O.5", None, 0.9),
    ], FIELDS)
    got = {r["document_id"]: [e["code"] for e in r["errors"]] for r in D.validate_document(docs(spark, "receipt", "act", "other", "invoice"), fields).collect()}
    assert got[0] == ["empty_value", "document_integrity", "invalid_date"]
    assert got[1] == []
    assert got[2] == ["missing_required_field", "invalid_number"]
    assert got[3] == ["missing_required_field"] * 3


def test_decision_gates(spark):
    good = [("company", "ACME"), ("date", "01/02/2019"), ("total", "5.00")]
    rows = [(d, n, v, None, 0.96) for d in (0, 1, 3) for n, v in good] + [(2, "company", "ACME", None, 0.96)]
    rows[3] = (1, "company", "ACME", None, 0.5)
    rows += [(3, "note", "x", None, 0.84), (3, "address", "y", None, 0.2)]
    fields = spark.createDataFrame(rows, FIELDS)
    quality = spark.createDataFrame([(2, 0.4, "Degraded"), (1, 0.5, "Acceptable")], "document_id int, quality_score double, profile_summary string")
    got = {r["document_id"]: r for r in D.decide(docs(spark, *["receipt"] * 4), fields, quality).collect()}
    assert (got[0]["decision"], got[0]["reason"]) == ("automatic", "none")
    assert got[1]["reason"] == "low_confidence" and got[1]["explanation"] == "Field 'company' confidence (0.50) below threshold (0.90)."
    assert got[2]["reason"] == "low_image_quality" and "0.40" in got[2]["explanation"]
    assert got[3]["explanation"] == "Fields 'address', 'note' confidence below required threshold."


def test_document_confidence_hands_weight_on(spark):
    fields = spark.createDataFrame([(0, "a", "x", None, 0.8), (1, "a", "x", None, 0.8), (2, "a", "x", None, 1.4)], FIELDS)
    tokens = spark.createDataFrame([(0, "0.4"), (0, None), (2, None)], "document_id int, confidence string")
    quality = spark.createDataFrame([(0, 0.6)], "document_id int, quality_score double")
    got = {r[0]: r[1] for r in D.document_confidence(docs(spark, *"abcd"), fields, tokens, quality).collect()}
    assert got == {0: 0.67, 1: 0.8, 2: 0.7, 3: 0.0}


def test_plan_thresholds(spark):
    m = spark.createDataFrame([(0, 1.5, 40.0, 10.0), (1, -1.4, 31.9, 10.1), (2, 0.0, 50.0, 1.0)],
                              "document_id int, rotation_angle double, contrast_score double, noise_score double")
    rows = [(r["document_id"], r["step_order"], r["operation"]) for r in D.plan_preprocessing(m).collect()]
    assert rows == [(0, 2, "deskew"), (1, 2, "clahe"), (1, 3, "denoise_median")]
    steps = [r["operation"] for r in D.step_order(m).where("document_id = 2").orderBy("step_order").collect()]
    assert steps == ["quality_analysis", "preprocessing_evaluation", "ocr_recognition", "kie_extraction", "decision_engine"]


DOC = ("document_id int, status string, decision string, review_reason string, review_started_at timestamp_ntz, "
       "review_finished_at timestamp_ntz, processing_finished_at timestamp_ntz, created_at timestamp_ntz")
EVENT = "event_id int, document_id int, action string, field_name string, new_value string, metadata_json string, created_at timestamp_ntz"


def lifecycle(spark, rows, events):
    from datetime import datetime

    d = datetime(2024, 1, 1)
    docs_ = spark.createDataFrame([(i, s, dec, r, None, None, None, d) for i, s, dec, r in rows], DOC)
    ev = spark.createDataFrame([(k, i, a, None, None, m, datetime(2024, 1, day)) for k, (i, a, m, day) in enumerate(events)], EVENT)
    return docs_, ev


def test_explanations(spark):
    import json

    first = json.dumps({"reason": "low_confidence", "review_details": {"reasons": ["low_field_confidence:total"], "fields": {"total": {"confidence": 0.5, "threshold": 0.9}}}})
    docs_, ev = lifecycle(spark, [
        (1, "completed_automatic", None, None), (2, "processing", None, None), (3, "completed_manual", None, "none"),
        (4, "manual_review", None, "invalid_date"), (5, "manual_review", None, None), (6, "error", None, None),
    ], [
        (3, "decision_evaluated", json.dumps(first), 2), (3, "decision_evaluated", '{"reason":"invalid_number"}', 3),
        (4, "decision_evaluated", '{"reason":"low_confidence"}', 2), (5, "decision_evaluated", "not json", 2),
    ])
    got = {r["document_id"]: r for r in I.explain_decision(docs_, ev).collect()}
    assert got[1]["automatic_eligible"] and got[1]["reasons"] == []
    assert got[2]["decision"] == "pending"
    r = got[3]["reasons"][0]
    assert got[3]["primary_reason"] == "low_confidence" and (r["code"], r["field"], r["confidence"]) == ("low_confidence", "total", 0.5)
    assert [x["code"] for x in got[4]["reasons"]] == ["invalid_date"] and got[4]["summary"].startswith("Manual review required due to invalid date (1")
    assert got[5]["reasons"] == [] and got[5]["summary"] == "Manual review required by operational policy."
    assert got[6]["decision"] == "rejected"


def test_issues_and_actions(spark):
    docs_, ev = lifecycle(spark, [(1, "error", None, None), (2, "manual_review", None, "low_image_quality"), (3, "completed_automatic", "automatic", "none")], [])
    jobs = spark.createDataFrame([(1, 1, "failed", "boom", "2024-01-01")], "job_id int, document_id int, status string, error_message string, created_at string")
    quality = D.quality_score(spark.createDataFrame([(2, 10.0, 50.0, 5.0, 3.0)], "document_id int, blur_score double, contrast_score double, noise_score double, rotation_angle double"))
    issues = I.derive_issues(docs_, ev, jobs, quality)
    got = {r["issue_id"]: r for r in issues.collect()}
    assert got["iss-1-proc"]["production"] == "boom" and got["iss-1-proc"]["severity"] == "critical"
    assert got["iss-2-0"]["condition_code"] == "D6" and got["iss-2-0"]["severity"] == "medium"
    summary = {r["document_id"]: r["summary"] for r in I.issue_summary(docs_, issues).collect()}
    assert summary[1].startswith("1 blocking") and summary[2].startswith("1 non-blocking") and summary[3].startswith("Zero")
    actions = [r["action_id"] for r in I.issue_actions(issues).where("document_id = 2").orderBy("position").collect()]
    assert actions == ["act-quality", "act-research-d6", "act-review", "act-document"]


def test_corrections_replay_and_gate(spark):
    from datetime import datetime

    fields = spark.createDataFrame([(1, "total", "x", None, 0.5), (1, "company", "ACME", None, 0.9), (1, "date", "01/02/2019", None, 0.9)], FIELDS)
    ev = spark.createDataFrame([(1, 1, "field_corrected", "total", "y", None, datetime(2024, 1, 1)), (2, 1, "field_corrected", "total", "7.00", None, datetime(2024, 1, 2)),
                                (3, 1, "field_corrected", "note", "n", None, datetime(2024, 1, 3))], EVENT)
    old = {r["event_id"]: r["old_value"] for r in D.corrections_replay(fields, ev).collect()}
    assert old == {1: "x", 2: "y", 3: None}
    now = {r["field_name"]: r for r in D.current_fields(fields, ev).collect()}
    assert now["total"]["corrected_value"] == "7.00" and now["note"]["confidence"] == 1.0
    pending = spark.createDataFrame([(1, "receipt", "manual_review")], "document_id int, document_type string, status string")
    assert D.review_gate(pending, fields, ev).first()["status"] == "completed_manual"
    assert D.review_gate(pending, fields, ev.where("event_id < 2")).first()["review_reason"] == "invalid_number"


def test_corrections_replay_of_a_hot_field(spark):
    """One field with most corrections, in many slices; ties in time go by event id."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    events = [(k, rng.choice([1, 1, 1, 2]), "field_corrected", rng.choice(["total", "total", "date", None]), start + timedelta(minutes=rng.randint(0, 500)),
               rng.choice([None, f"v{k}"])) for k in range(1500)]
    df = spark.createDataFrame(events, "event_id int, document_id int, action string, field_name string, created_at timestamp, new_value string").repartition(4)
    fields = spark.createDataFrame([(1, "total", "first", None), (2, "date", "x", "y")], "document_id int, field_name string, value string, corrected_value string")
    base, want, seen = {(1, "total"): "first", (2, "date"): "y"}, {}, {}
    for k, d, _, f, _, v in sorted(events, key=lambda e: (e[4], e[0])):
        if f is not None:
            old = seen.get((d, f))
            want[k] = (d, f, old if old is not None else base.get((d, f)), v)
            seen[d, f] = v
    for slices in (1, 11):
        got = {r.event_id: (r.document_id, r.field_name, r.old_value, r.new_value) for r in D.corrections_replay(fields, df, slices).collect()}
        assert got == want


def test_samples_of_any_size_without_a_single_task(spark):
    from leafscore.operators import sampling as P

    ids = spark.range(3000).select((F.col("id") % 1000).alias("document_id"))
    order = [r[0] for r in P._hashed(ids, "document_id", 42).orderBy("_h", "document_id").collect()]
    assert sorted(r[0] for r in P.subset_sample(ids, 700).collect()) == sorted(order[:700])
    got = {r.document_id: r.split for r in P.split_assign(ids, 300, 200).collect()}
    assert got == {d: "development" if k < 300 else "validation" for k, d in enumerate(order[:500])}
    assert P.subset_sample(ids, 5000).count() == 1000 and P.subset_sample(ids.limit(0), 5).count() == 0


@pytest.mark.parametrize("head, declared, size, want", [
    (b"\xff\xd8\xff\xe0", "image/jpg", 9, (True, "image/jpeg", "", False)), (b"%PDF-1", "image/png", 9, (True, "application/pdf", "", True)),
    (b"%PDF", "application/octet-stream", 9, (True, "application/pdf", "", False)), (b"<html>", None, 9, (False, "application/octet-stream", "Unrecognized or unsupported file format signature.", False)),
    (b"%PDF", "x", 0, (False, "", "File is empty.", False)), (None, None, None, (False, "", "File is empty.", False)),
    (b"%PDF", "x", 101, (False, "", "File size exceeds maximum limit of 100 bytes.", False)), (None, "", 5, (False, "application/octet-stream", "Unrecognized or unsupported file format signature.", False)),
])
def test_upload_check(spark, head, declared, size, want):
    from leafscore.functions.text import upload_check

    row = spark.createDataFrame([(None if head is None else bytearray(head), declared, size)], "h binary, d string, s int")
    assert tuple(row.select(upload_check(F.col("h"), F.col("d"), F.col("s"), 100)).first()[0]) == want
