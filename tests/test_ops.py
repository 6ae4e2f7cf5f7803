from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafscore.operators import feedback as B
from leafscore.operators import ops as O

NOW = datetime(2024, 3, 10, 15, 30)
DOC = ("document_id int, document_type string, status string, decision string, review_reason string, confidence double, created_at timestamp_ntz, "
       "processing_finished_at timestamp_ntz, review_started_at timestamp_ntz, review_finished_at timestamp_ntz, processing_duration_ms double, review_duration_ms double")
EVENT = "event_id int, document_id int, action string, field_name string, metadata_json string, created_at timestamp_ntz"
FIELD = "document_id int, field_name string, value string, corrected_value string, confidence double"


@pytest.mark.parametrize("period, want", [
    ("all", (None, None)), (None, (None, None)), ("bogus", (None, None)), ("today", (datetime(2024, 3, 10), NOW)),
    (" 7D ", (datetime(2024, 3, 4), NOW)), ("30d", (datetime(2024, 2, 10), NOW)), ("90d", (datetime(2023, 12, 12), NOW)),
])
def test_period_bounds(period, want):
    assert O.period_bounds(period, NOW) == want


def test_explicit_bounds_win():
    assert O.period_bounds("7d", NOW, date_to=NOW) == (None, NOW)


def doc(i, status="completed_manual", reason="low_confidence", made=1, done=2, kind="receipt", decision=None, conf=0.5):
    day = lambda d: None if d is None else datetime(2024, 1, d)
    return (i, kind, status, decision, reason, conf, day(made), day(done), None, None, 10.0, None)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOC)


def events(spark, *rows):
    return spark.createDataFrame([(k, d, a, f, m, datetime(2024, 1, day)) for k, (d, a, f, m, day) in enumerate(rows)], EVENT)


def test_either_bound_may_use_either_column(spark):
    rows = docs(spark, doc(1, made=1, done=9), doc(2, made=1, done=None), doc(3, made=5, done=None), doc(4, made=1, done=20))
    kept = rows.where(O.in_period_either(datetime(2024, 1, 4), datetime(2024, 1, 10))).select("document_id").collect()
    assert sorted(r[0] for r in kept) == [1, 3, 4]


def test_empty_tables_give_zero_rates(spark):
    d, e = docs(spark, doc(1)).where("1 = 0"), events(spark, (1, "x", None, None, 1)).where("1 = 0")
    f = spark.createDataFrame([], FIELD)
    jobs = spark.createDataFrame([], "status string")
    row = O.overview(d, e, f, jobs).first()
    assert row["total_documents"] == 0 and row["automation_rate"] == 0.0 and row["average_confidence"] == 0.0
    assert B.feedback_summary(d, e).first()["avg_corrections"] == 0.0
    assert B.signals(d, e, f).count() == 0
    assert [r["total_count"] for r in O.confidence_distribution(d, f).collect()] == [0] * 5


def test_corrections_fall_back_to_fields(spark):
    f = spark.createDataFrame([(1, "total", "a", "b", 0.5), (1, "date", "a", None, 0.5)], FIELD)
    e = events(spark, (1, "field_corrected", "total", None, 9))
    jobs = spark.createDataFrame([("running",)], "status string")
    late = O.overview(docs(spark, doc(1)), e, f, jobs, start=datetime(2024, 1, 10)).first()
    assert (late["corrections_total"], late["corrections_source"], late["queue_pending_count"]) == (1, "fields", 1)
    assert O.overview(docs(spark, doc(1)), e, f, jobs).first()["corrections_source"] == "events"


def test_trend_fills_empty_days(spark):
    got = O.trends(docs(spark, doc(1, "completed_automatic", made=2, done=4), doc(2, "error", made=4, done=4)), datetime(2024, 1, 1), datetime(2024, 1, 5), NOW).orderBy("day").collect()
    assert [r["processed_count"] for r in got] == [0, 0, 0, 2, 0] and [r["total_documents"] for r in got] == [0, 1, 0, 1, 0]
    assert got[3]["automation_rate"] == 0.5
    assert O.trends(docs(spark, doc(1)), None, None, NOW).count() == 7


def test_decision_reasons_shapes(spark):
    quoted = '"{\\"decision\\":\\"manual_review\\",\\"reason\\":\\"ocr_error\\"}"'
    e = events(
        spark, (1, "decision_evaluated", None, '{"decision":"AUTOMATIC"}', 1), (1, "decision_evaluated", None, quoted, 1),
        (1, "decision_evaluated", None, "garbage", 1), (1, "decision_evaluated", None, None, 1),
        (1, "decision_evaluated", None, '{"reason":"x","review_details":{"reasons":[{"field":"total"},{"code":"invalid_date"}]}}', 1),
        (1, "decision_evaluated", None, '{"reason":"none"}', 1))
    got = {(r["dimension"], r["key"]): r["count"] for r in O.decision_reasons(e).collect()}
    assert got == {("reason", "ocr_error"): 1, ("reason", "x"): 1, ("reason", "invalid_date"): 1, ("category", "pipeline"): 1, ("category", "validation"): 2, ("field", "total"): 1}
    totals = O.decision_totals(e).first()
    assert (totals["total_decisions"], totals["automatic_count"]) == (6, 1)


def feedback_case(spark):
    d = docs(
        spark, doc(1), doc(2, reason="none"), doc(3, "manual_review", made=1, done=1), doc(4, "completed_manual", made=1, done=1), doc(5, "completed_automatic", reason="none"))
    e = events(
        spark, (1, "field_corrected", "total", None, 5), (1, "field_corrected", None, None, 5), (3, "field_corrected", "total", None, 6), (99, "field_corrected", "date", None, 6),
        (2, "decision_evaluated", None, '{"reason":"invalid_date"}', 1), (2, "decision_evaluated", None, '{"reason":"none"}', 2), (99, "decision_evaluated", None, '{"reason":"ocr_error"}', 1))
    return d, e


def test_feedback_backfills_and_keeps_orphans(spark):
    d, e = feedback_case(spark)
    start = datetime(2024, 1, 2)
    row = B.feedback_summary(d, e, start).first()
    assert (row["processed"], row["completed_manual_review"], row["with_corrections"], row["total_correction_events"]) == (3, 2, 2, 4)
    rows = {r["document_id"]: r for r in B.document_feedback(d, e, start).collect()}
    assert set(rows) == {1, 2, 3, 99} and rows[99]["reason"] == "ocr_error" and not rows[99]["in_map"]
    assert rows[2]["reason"] == "invalid_date" and rows[3]["reason"] == "low_confidence"
    reasons = {r["reason"]: (r["reviewed_documents"], r["correction_events"]) for r in B.breakdown(B.document_feedback(d, e, start), "reason").collect()}
    assert reasons == {"low_confidence": (2, 3), "invalid_date": (1, 0)}
    fields = {r["field"]: (r["correction_count"], r["affected_documents"]) for r in B.by_field(e, start).collect()}
    assert fields == {"total": (2, 2), "unknown": (1, 1), "date": (1, 1)}


def test_improvement_map_is_wider(spark):
    d, e = feedback_case(spark)
    row = B.improvement_overview(d, e, datetime(2024, 1, 2)).first()
    assert (row["documents_processed"], row["documents_reviewed"], row["documents_corrected"]) == (4, 2, 2)
    rows = {r["document_id"]: r["reason"] for r in B.document_feedback(d, e, datetime(2024, 1, 2), reviewed_scope=False).collect()}
    assert rows[99] == "manual_review" and rows[5] == "manual_review"


def test_confidence_share_falls_back_to_events(spark):
    d, e = feedback_case(spark)
    f = spark.createDataFrame([(5, "total", "a", "a", 0.96), (5, "date", "a", None, 0.2), (77, "date", "a", "b", 0.2)], FIELD)
    got = {r["bucket"]: (r["evaluated_fields"], r["corrected_fields"]) for r in B.improvement_by_confidence(d, e, f).collect()}
    assert got["0.95–1.00"] == (1, 0) and got["0.00–0.50"] == (1, 0)


def test_one_hot_document(spark):
    """A document with a third of all events is one row wherever it is joined."""
    rows = [(1 if k % 3 == 0 else k, "field_corrected", "total", None, 5) for k in range(3000)]
    e = events(spark, *rows)
    d = docs(spark, *[doc(i) for i in range(1, 3000, 7)])
    assert B.corrections(e).where("document_id = 1").count() == 1
    assert B.feedback_summary(d, e).first()["total_correction_events"] == 3000


def test_similar_documents_excludes_itself(spark):
    d, e = feedback_case(spark)
    got = {r["document_id"]: (r["total"], r["corrections"]) for r in O.similar_documents(d, e).collect()}
    assert got == {1: (2, 1), 3: (2, 1), 4: (2, 2)}


def test_list_documents_pages(spark):
    d = docs(spark, *[doc(i, made=i) for i in range(1, 8)]).withColumn("filename", F.concat(F.lit("A"), F.col("document_id").cast("string"), F.lit("_x%.pdf")))
    got = O.list_documents(d, search="_X%", limit=2, offset=1).collect()
    assert [r["document_id"] for r in got] == [6, 5] and got[0]["total"] == 7
    assert O.list_documents(d, search="axx").count() == 0


def reviewed_documents(spark, n=400):
    kinds, reasons = ["receipt", "invoice", None], ["low_confidence", "invalid_date", "none", None]
    d = docs(spark, *[doc(i, ["completed_manual", "completed_automatic", "manual_review"][i % 3], reasons[i % 4], kind=kinds[i % 3 - i % 2]) for i in range(n)])
    e = events(spark, *[(i * 7 % (n + 9), "field_corrected", ["total", "date", None, ""][i % 4], None, 1 + i % 20) for i in range(n)])
    return d, e


def test_breakdowns_in_one_pass_equal_one_by_one(spark):
    d, e = reviewed_documents(spark)
    rows = B.document_feedback(d, e)
    for only in (False, True):
        got = sorted(map(str, B.breakdowns(rows, ["reason", "document_type", "status"], only).collect()))
        want = [r for k in ("reason", "document_type", "status") for r in B.breakdown(rows, k, only).select(
            F.lit(k).alias("dimension"), F.col(k).alias("key"), "reviewed_documents", "documents_with_corrections", "correction_events", "correction_rate").collect()]
        assert got == sorted(map(str, want)) and len(got) > 5
    assert B.breakdowns(rows.limit(0), ["reason", "status"]).count() == 0


def test_sketches_merge_and_stay_within_their_error(spark):
    d = spark.range(60_000).select((F.col("id") % 20_000).alias("document_id"), F.lit("field_corrected").alias("action"), (F.col("id") % 3 + F.col("id") % 20_000 % 2).alias("f"), (F.col("id") % 11).alias("day"))
    exact = {r.f: (r[1], r[2]) for r in d.groupBy("f").agg(F.count("*"), F.countDistinct("document_id")).collect()}
    near = B.sketched_documents(B.correction_sketches(d, ["f", "day"]), ["f"]).collect()
    assert {r.f: r.correction_count for r in near} == {f: n for f, (n, _) in exact.items()}
    assert all(abs(r.affected_documents - exact[r.f][1]) <= 4 * 1.04 / 64 * exact[r.f][1] for r in near)
    few = d.where("document_id < 5")
    assert {r.affected_documents for r in B.sketched_documents(B.correction_sketches(few, ["day"]), []).collect()} == {5}


def test_signals_read_the_tables_a_few_times(spark, tmp_path):
    """The plans of everything that is read, written bases included, scan source tables at most five times."""
    d, e = reviewed_documents(spark)
    f = spark.createDataFrame([(i, "total", "a", "b", 0.5) for i in range(50)], FIELD)
    for name, df in (("docs", d), ("events", e), ("fields", f)):
        df.write.parquet(str(tmp_path / name))
    read = []
    plain = B.written
    B.written = lambda df, label: (read.append(df), plain(df, label))[1]
    try:
        out = B.signals(*[spark.read.parquet(str(tmp_path / n)) for n in ("docs", "events", "fields")])
    finally:
        B.written = plain
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in [*read, out]]
    assert 3 <= sum(p.count(str(tmp_path)) for p in plans) <= 5
    assert out.count() > 0

