"""Queries over operations and feedback analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from leafscore.functions.scalars import COARSE_BUCKETS, FINE_BUCKETS, bucket, reason_category
from leafscore.operators import feedback as B
from leafscore.operators import ops as O
from leafscore.plans.registry import query

# The period of the bounded queries: documents from 1997 on, correction events until 20 January 2024.
START, END = datetime(1997, 1, 1), datetime(2024, 1, 20)
S, E = f"TIMESTAMP '{START}'", f"TIMESTAMP '{END}'"
EITHER = f"(processing_finished_at >= {S} OR created_at >= {S}) AND (processing_finished_at <= {E} OR created_at <= {E})"
DONE = "status IN ('completed_automatic','completed_manual','manual_review','error')"
MANUAL = "coalesce(status IN ('manual_review','completed_manual') OR decision = 'manual_review', false)"
CATEGORY = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 'low_confidence' THEN 'confidence' WHEN {0} = 'low_image_quality' THEN 'quality'
  WHEN {0} = 'none' THEN 'none' WHEN {0} IN ('ocr_error','kie_error','pipeline_failure','system_error') THEN 'pipeline' ELSE 'validation' END"""


def rate(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN round(({a}) / ({b})::DOUBLE * 100.0E0, 1) ELSE 0.0E0 END"


def bucket_sql(x: str, edges) -> str:
    cases = " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{n}'" for n, lo, hi in edges)
    return f"CASE WHEN {x} >= 1.0 THEN '{edges[-1][0]}' {cases} END"


def labels_sql(edges) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{n}' AS bucket" for n, _, _ in edges) + ")"


@query("period_filter", f"""SELECT document_id, processing_finished_at FROM {{doc_lifecycle}}
  WHERE processing_finished_at >= TIMESTAMP '2001-05-04 00:00:00' AND processing_finished_at <= TIMESTAMP '2001-08-01 12:00:00'""")
def _(t):
    start, end = O.period_bounds("90d", datetime(2001, 8, 1, 12))
    return t.doc_lifecycle.where(O.in_period(F.col("processing_finished_at"), start, end)).select(
        "document_id", "processing_finished_at")


@query("period_filter_either", f"SELECT document_id FROM {{doc_lifecycle}} WHERE {EITHER}")
def _(t):
    return t.doc_lifecycle.where(O.in_period_either(START, END)).select("document_id")


@query("list_documents", """WITH f AS (SELECT document_id, filename, created_at FROM {filed_documents}
    WHERE status = 'manual_review' AND contains(lower(filename), 'receipt'))
  SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, document_id DESC LIMIT 20 OFFSET 10""")
def _(t):
    docs = t.filed_documents.select("document_id", "filename", "created_at", "status")
    return O.list_documents(docs, status="manual_review", search="Receipt", limit=20, offset=10).drop("status")


@query("recent_documents", """SELECT document_id, filename, status, updated_at FROM {filed_documents}
  ORDER BY updated_at DESC, created_at DESC, document_id DESC LIMIT 10""")
def _(t):
    return O.recent_documents(t.filed_documents).select("document_id", "filename", "status", "updated_at")


@query("next_jobs", """SELECT job_id, document_id, priority FROM {processing_jobs} WHERE status IN ('pending','retrying')
  ORDER BY priority DESC, created_at, job_id LIMIT 25""")
def _(t):
    return O.next_jobs(t.processing_jobs, 25).select("job_id", "document_id", "priority")


@query("active_value", "SELECT document_id, field_name, coalesce(corrected_value, value) AS active FROM {extracted_fields}")
def _(t):
    return t.extracted_fields.select("document_id", "field_name", F.coalesce("corrected_value", "value").alias("active"))


@query("safe_rate", f"SELECT document_type, {rate('auto', 'n')} AS rate FROM (SELECT document_type, count(*) FILTER (status = 'completed_automatic') AS auto, count(*) FILTER (confidence > 2) + count(*) FILTER (document_type <> 'act') AS n FROM {{doc_lifecycle}} GROUP BY document_type)")
def _(t):
    from leafscore.functions.scalars import safe_rate

    rows = t.doc_lifecycle.groupBy("document_type").agg(
        F.count_if(F.col("status") == "completed_automatic").alias("auto"),
        (F.count_if(F.col("confidence") > 2) + F.count_if(F.col("document_type") != "act")).alias("n"))
    return rows.select("document_type", safe_rate(F.col("auto"), F.col("n")).alias("rate"))


@query("reason_category", f"SELECT document_id, review_reason, {CATEGORY.format('review_reason')} AS category FROM {{doc_lifecycle}}")
def _(t):
    return t.doc_lifecycle.select("document_id", "review_reason", reason_category(F.col("review_reason")).alias("category"))


@query("bucket_join_coarse", f"SELECT document_id, {bucket_sql('confidence', COARSE_BUCKETS)} AS bucket FROM {{doc_lifecycle}}")
def _(t):
    return t.doc_lifecycle.select("document_id", bucket(F.col("confidence"), COARSE_BUCKETS).alias("bucket"))


@query("bucket_join_fine", f"SELECT document_id, field_name, value, {bucket_sql('confidence', FINE_BUCKETS)} AS bucket FROM {{extracted_fields}}")
def _(t):
    return t.extracted_fields.select("document_id", "field_name", "value", bucket(F.col("confidence"), FINE_BUCKETS).alias("bucket"))


OVERVIEW = f"""ov AS (SELECT total_documents, processed_count, automatic_count, manual_review_count, completed_manual_count, error_count,
    {rate('automatic_count', 'processed_count')} AS automation_rate,
    {rate('manual_review_count + completed_manual_count', 'processed_count')} AS manual_review_rate,
    {rate('error_count', 'processed_count')} AS failure_rate,
    CASE WHEN ev > 0 THEN ev ELSE ff END AS corrections_total, CASE WHEN ev > 0 THEN 'events' ELSE 'fields' END AS corrections_source,
    round(coalesce(conf, 0) * 100, 1) AS average_confidence, round(coalesce(proc, 0), 1) AS average_processing_time_ms,
    round(coalesce(rev, 0), 1) AS average_review_time_ms, queue_pending_count
  FROM (SELECT count(*) FILTER (created_at >= {S} AND created_at <= {E}) AS total_documents,
      count(*) FILTER (d AND {DONE}) AS processed_count, count(*) FILTER (d AND status = 'completed_automatic') AS automatic_count,
      count(*) FILTER (d AND status = 'manual_review') AS manual_review_count,
      count(*) FILTER (d AND status = 'completed_manual') AS completed_manual_count, count(*) FILTER (d AND status = 'error') AS error_count,
      avg(confidence) FILTER (d) AS conf, avg(processing_duration_ms) FILTER (d AND confidence IS NOT NULL) AS proc,
      avg(review_duration_ms) FILTER (review_finished_at >= {S} AND review_finished_at <= {E}) AS rev
    FROM (SELECT *, processing_finished_at >= {S} AND processing_finished_at <= {E} AS d FROM {{doc_lifecycle}})),
   (SELECT count(*) AS ev FROM {{audit_events}} WHERE action = 'field_corrected' AND created_at >= {S} AND created_at <= {E}),
   (SELECT count(corrected_value) AS ff FROM {{extracted_fields}}),
   (SELECT count(*) FILTER (status IN ('pending','running','retrying')) AS queue_pending_count FROM {{processing_jobs}}))"""


def _overview(t):
    return O.overview(t.doc_lifecycle, t.audit_events, t.extracted_fields, t.processing_jobs, START, END)


@query("ops_overview", f"WITH {OVERVIEW} SELECT * FROM ov")
def _(t):
    return _overview(t)


def share_sql(key: str, where: str) -> str:
    return (f"SELECT *, {rate('count', 'sum(count) OVER ()')} AS percentage FROM (SELECT {key}, count(*) AS count FROM {{doc_lifecycle}} "
            f"WHERE {where} GROUP BY {key})")


@query("ops_review_reasons", share_sql("review_reason", f"review_reason <> 'none' AND created_at >= {S} AND created_at <= {E}"))
def _(t):
    return O.review_reasons(t.doc_lifecycle, START, END)


@query("ops_type_distribution", share_sql("document_type", f"created_at >= {S} AND created_at <= {E}"))
def _(t):
    return O.type_distribution(t.doc_lifecycle, START, END)


@query("ops_status_distribution", share_sql("status", f"{DONE} AND processing_finished_at >= {S} AND processing_finished_at <= {E}"))
def _(t):
    return O.status_distribution(t.doc_lifecycle, START, END)


@query("ops_document_types", f"""SELECT document_type, total_documents, processed_documents, automatic_count, manual_review_count, error_count,
    average_confidence, average_processing_time_ms, average_review_time_ms, {rate('automatic_count', 'processed_documents')} AS automation_rate,
    {rate('manual_review_count', 'processed_documents')} AS manual_review_rate, {rate('error_count', 'processed_documents')} AS failure_rate
  FROM (SELECT document_type, count(*) FILTER (created_at >= {S} AND created_at <= {E}) AS total_documents, count(*) FILTER (d) AS processed_documents,
    count(*) FILTER (d AND status = 'completed_automatic') AS automatic_count, count(*) FILTER (d AND {MANUAL}) AS manual_review_count,
    count(*) FILTER (d AND status = 'error') AS error_count, round(coalesce(avg(confidence) FILTER (d), 0) * 100, 1) AS average_confidence,
    round(coalesce(avg(processing_duration_ms) FILTER (d), 0), 1) AS average_processing_time_ms,
    round(coalesce(avg(review_duration_ms) FILTER (d), 0), 1) AS average_review_time_ms
  FROM (SELECT *, coalesce(processing_finished_at >= {S} AND processing_finished_at <= {E}, false) AS d FROM {{doc_lifecycle}}) GROUP BY document_type)""")
def _(t):
    return O.document_types(t.doc_lifecycle, START, END)


@query("ops_trends", """WITH b AS (SELECT TIMESTAMP '1999-03-10 06:00:00' AS s, TIMESTAMP '2000-04-20 18:00:00' AS e),
  days AS (SELECT unnest(generate_series(s::DATE::TIMESTAMP, e::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM b),
  a AS (SELECT created_at::DATE AS day, count(*) AS n FROM {doc_lifecycle}, b WHERE created_at BETWEEN s AND e GROUP BY 1),
  p AS (SELECT processing_finished_at::DATE AS day, count(*) AS n, count(*) FILTER (status = 'completed_automatic') AS au,
    count(*) FILTER (status IN ('manual_review','completed_manual')) AS ma, count(*) FILTER (status = 'error') AS er
    FROM {doc_lifecycle}, b WHERE processing_finished_at BETWEEN s AND e GROUP BY 1)
  SELECT strftime(days.day, '%Y-%m-%d') AS day, coalesce(a.n, 0) AS total_documents, coalesce(p.n, 0) AS processed_count,
    coalesce(au, 0) AS automatic_count, coalesce(ma, 0) AS manual_review_count, coalesce(er, 0) AS error_count,
    CASE WHEN p.n > 0 THEN round(au / p.n::DOUBLE, 3) ELSE 0.0E0 END AS automation_rate
  FROM days LEFT JOIN a ON a.day = days.day LEFT JOIN p ON p.day = days.day""")
def _(t):
    return O.trends(t.doc_lifecycle, datetime(1999, 3, 10, 6), datetime(2000, 4, 20, 18), datetime(2024, 2, 1))


@query("ops_queue", """SELECT count(*) FILTER (status = 'manual_review') AS manual_review, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'error') AS errors FROM {doc_lifecycle}""")
def _(t):
    return O.queue(t.doc_lifecycle)


@query("ops_field_corrections", f"""SELECT *, {rate('corrected_count', 'total_occurrences')} AS correction_rate FROM (
  SELECT field_name, count(*) AS total_occurrences, count(corrected_value) AS corrected_count FROM {{extracted_fields}} GROUP BY field_name)""")
def _(t):
    return O.field_corrections(t.extracted_fields)


@query("ops_confidence_distribution", f"""WITH c AS (SELECT {bucket_sql('confidence', COARSE_BUCKETS)} AS bucket, count(*) AS total_count,
    count(*) FILTER ({MANUAL}) AS manual_review_count, count(*) FILTER (document_id IN (SELECT document_id FROM {{extracted_fields}} WHERE corrected_value IS NOT NULL)) AS corrected_count
    FROM {{doc_lifecycle}} WHERE confidence IS NOT NULL AND created_at >= {S} AND created_at <= {E} GROUP BY 1)
  SELECT bucket, coalesce(total_count, 0) AS total_count, coalesce(manual_review_count, 0) AS manual_review_count,
    coalesce(corrected_count, 0) AS corrected_count, {rate('manual_review_count', 'total_count')} AS review_rate
  FROM {labels_sql(COARSE_BUCKETS)} l LEFT JOIN c USING (bucket)""")
def _(t):
    return O.confidence_distribution(t.doc_lifecycle, t.extracted_fields, START, END)


MANUAL_EVENTS = f"""me AS (SELECT event_id, metadata_json AS j, json_extract_string(metadata_json, '$.reason') AS reason,
    json_extract(metadata_json, '$.review_details.reasons') AS rs FROM {{audit_events}}
    WHERE action = 'decision_evaluated' AND lower(coalesce(json_extract_string(metadata_json, '$.decision'), '')) <> 'automatic'),
  it AS (SELECT unnest(CAST(rs AS JSON[])) AS r, reason FROM me WHERE rs IS NOT NULL),
  cd AS (SELECT coalesce(json_extract_string(r, '$.code'), reason, 'unknown') AS code, json_extract_string(r, '$.field') AS field
      FROM it WHERE json_type(r) = 'OBJECT'
    UNION ALL SELECT reason, NULL FROM me WHERE rs IS NULL AND reason <> 'none')"""


@query("ops_decision_reasons", f"""WITH {MANUAL_EVENTS}, lg AS (SELECT 'reason' AS dimension, code AS key FROM cd
    UNION ALL SELECT 'category', {CATEGORY.format('code')} FROM cd UNION ALL SELECT 'field', field FROM cd WHERE field IS NOT NULL),
  ct AS (SELECT dimension, key, count(*) AS count FROM lg GROUP BY ALL)
  SELECT *, {rate('count', 'sum(count) OVER (PARTITION BY dimension)')} AS percentage, CASE WHEN dimension = 'reason'
    THEN concat(upper(replace(key, '_', ' ')[1]), lower(replace(key, '_', ' ')[2:])) END AS description FROM ct""")
def _(t):
    return O.decision_reasons(t.audit_events)


TOTALS = f"""dt AS (SELECT *, total_decisions - automatic_count AS manual_review_count, {rate('automatic_count', 'total_decisions')} AS automation_rate,
    {rate('total_decisions - automatic_count', 'total_decisions')} AS manual_review_rate FROM (
    SELECT count(*) AS total_decisions, count(*) FILTER (json_extract_string(metadata_json, '$.decision') = 'automatic') AS automatic_count
    FROM {{audit_events}} WHERE action = 'decision_evaluated'))"""


@query("ops_decision_totals", f"WITH {TOTALS} SELECT * FROM dt")
def _(t):
    return O.decision_totals(t.audit_events)


QUALITY = f"""sc AS (SELECT * FROM {{doc_lifecycle}} WHERE {EITHER}),
  ql AS (SELECT (SELECT round(avg(quality_score), 4) FROM {{document_quality}} JOIN sc USING (document_id)) AS average_quality_score,
    (SELECT round(avg(f.confidence), 4) FROM {{extracted_fields}} f JOIN sc USING (document_id)) AS average_kie_confidence,
    (SELECT round(avg(TRY_CAST(p.confidence AS DOUBLE)), 4) FROM {{page_tokens}} p JOIN sc USING (document_id)) AS average_ocr_confidence,
    (SELECT round(avg(confidence), 4) FROM sc) AS average_document_confidence, n AS total_documents_validated, bad AS failed_validation_count,
    n - bad AS passed_validation_count, CASE WHEN n > 0 THEN round((n - bad) / n::DOUBLE, 4) END AS validation_pass_rate
  FROM (SELECT count(decision) AS n, count(*) FILTER (decision = 'manual_review' AND review_reason IN ('validation_failed',
    'missing_required_field','invalid_date','invalid_number','empty_value','document_integrity')) AS bad FROM sc))"""


def _quality(t):
    return O.quality_summary(t.doc_lifecycle, t.document_quality, t.extracted_fields, t.page_tokens, START, END)


@query("ops_quality_summary", f"WITH {QUALITY} SELECT * FROM ql")
def _(t):
    return _quality(t)


@query("quality_doc_join", f"SELECT q.document_id, quality_score FROM {{document_quality}} q JOIN {{doc_lifecycle}} d USING (document_id) WHERE {EITHER}")
def _(t):
    ids = t.doc_lifecycle.where(O.in_period_either(START, END)).select("document_id")
    return t.document_quality.join(ids, "document_id")


@query("field_doc_join", f"SELECT document_type, count(*) AS fields, round(avg(f.confidence), 4) AS mean_confidence FROM {{extracted_fields}} f JOIN {{doc_lifecycle}} d USING (document_id) WHERE {EITHER} GROUP BY document_type")
def _(t):
    docs = t.doc_lifecycle.where(O.in_period_either(START, END)).select("document_id", "document_type")
    return t.extracted_fields.join(docs, "document_id").groupBy("document_type").agg(
        F.count("*").alias("fields"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query("page_doc_join", f"SELECT document_type, count(*) AS tokens, count(TRY_CAST(p.confidence AS DOUBLE)) AS scored FROM {{page_tokens}} p JOIN {{doc_lifecycle}} d USING (document_id) WHERE {EITHER} GROUP BY document_type")
def _(t):
    docs = t.doc_lifecycle.where(O.in_period_either(START, END)).select("document_id", "document_type")
    return t.page_tokens.join(docs, "document_id").groupBy("document_type").agg(
        F.count("*").alias("tokens"), F.count(F.col("confidence").try_cast("double")).alias("scored"))


@query("ops_backlog", f"""WITH w AS (SELECT * FROM {{doc_lifecycle}} WHERE status = 'manual_review'),
  r AS (SELECT review_reason AS key, count(*) AS count FROM w WHERE review_reason <> 'none' GROUP BY 1)
  SELECT 'total' AS section, 'open' AS key, count(*) FILTER (review_started_at IS NULL) AS count FROM w
  UNION ALL SELECT 'total', 'in_review', count(*) FILTER (review_started_at IS NOT NULL AND review_finished_at IS NULL) FROM w
  UNION ALL SELECT 'reason', key, count FROM r
  UNION ALL SELECT 'category', {CATEGORY.format('key')}, sum(count)::BIGINT FROM r GROUP BY 2""")
def _(t):
    return O.backlog(t.doc_lifecycle)


@query("event_left_count", """WITH c AS (SELECT DISTINCT document_id FROM {audit_events} WHERE action = 'field_corrected'),
  d AS (SELECT document_id, review_reason, (document_id IN (SELECT document_id FROM c))::INT AS h FROM {doc_lifecycle}
    WHERE review_reason IS NOT NULL AND review_reason <> 'none'),
  x AS (SELECT review_reason, count(*) AS n, sum(h)::BIGINT AS k FROM d GROUP BY 1)
  SELECT document_id, review_reason, n - 1 AS total, k - h AS corrections, n - 1 - (k - h) AS no_corrections FROM d JOIN x USING (review_reason) WHERE n > 1""")
def _(t):
    return O.similar_documents(t.doc_lifecycle, t.audit_events)


@query("historical_similar", """SELECT review_reason, count(*) AS total, count(*) FILTER (h) AS corrections, count(*) FILTER (NOT h) AS no_corrections
  FROM (SELECT review_reason, document_id IN (SELECT document_id FROM {audit_events} WHERE action = 'field_corrected') AS h
    FROM {doc_lifecycle} WHERE review_reason <> 'none') GROUP BY review_reason""")
def _(t):
    return O.historical_similar(t.doc_lifecycle, t.audit_events)


@query("document_detail", """SELECT document_id, section, count(*) AS rows, min(position) AS first_position, max(position) AS last_position FROM (
    SELECT document_id, 'document' AS section, '' AS position FROM {doc_lifecycle}
    UNION ALL SELECT document_id, 'page', idx::VARCHAR FROM {page_tokens} WHERE document_id IN (SELECT document_id FROM {doc_lifecycle})
    UNION ALL SELECT document_id, 'field', field_name FROM {extracted_fields} WHERE document_id IN (SELECT document_id FROM {doc_lifecycle})
    UNION ALL SELECT document_id, 'audit', event_id::VARCHAR FROM {audit_events} WHERE document_id IN (SELECT document_id FROM {doc_lifecycle}))
  GROUP BY ALL""")
def _(t):
    rows = O.document_sections(t.doc_lifecycle, {
        "page": (t.page_tokens, "idx"), "field": (t.extracted_fields, "field_name"), "audit": (t.audit_events, "event_id")})
    return rows.groupBy("document_id", "section").agg(
        F.count("*").alias("rows"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


# Feedback -----------------------------------------------------------------------------------------------------

EVENTS_IN = f"ce AS (SELECT *, coalesce(field_name, 'unknown') AS fld FROM {{audit_events}} WHERE action = 'field_corrected' AND created_at >= {S} AND created_at <= {E})"
PER_DOC = "cd0 AS (SELECT document_id, count(*) AS events FROM ce GROUP BY 1)"
LAST_REASON = """lr AS (SELECT document_id, arg_max(r, {'a': created_at, 'b': event_id}) AS er FROM (
    SELECT document_id, created_at, event_id, json_extract_string(metadata_json, '$.reason') AS r FROM {audit_events}
    WHERE action = 'decision_evaluated') WHERE r <> 'none' GROUP BY 1)"""


def doc_feedback_sql(scope: str, outside: str) -> str:
    """Document-level feedback rows ``df``; ``outside`` is the reason of corrections without a mapped document."""
    return f"""{EVENTS_IN}, {PER_DOC}, {LAST_REASON},
  jn AS (SELECT coalesce(d.document_id, c.document_id) AS document_id, d.document_type, d.status, d.review_reason, c.events,
      d.document_id IS NOT NULL AND (coalesce({scope}, false) OR c.events IS NOT NULL) AS in_map
    FROM {{doc_lifecycle}} d FULL JOIN cd0 c ON d.document_id = c.document_id),
  df AS (SELECT document_id, CASE WHEN in_map THEN document_type ELSE 'unknown' END AS document_type, status,
      CASE WHEN in_map THEN coalesce(er, nullif(review_reason, 'none'), 'manual_review') ELSE {outside} END AS reason, in_map,
      coalesce(events, 0) AS events FROM jn LEFT JOIN lr USING (document_id) WHERE in_map OR events IS NOT NULL)"""


SCOPE = f"{DONE} AND {EITHER}"
FEEDBACK = doc_feedback_sql(f"{SCOPE} AND status = 'completed_manual'", "coalesce(er, 'manual_review')")
IMPROVE = doc_feedback_sql(SCOPE, "'manual_review'")


def breakdown_sql(key: str, reviewed: str = "in_map") -> str:
    return f"""SELECT *, {rate('documents_with_corrections', 'reviewed_documents')} AS correction_rate FROM (
      SELECT {key}, count(*) FILTER ({reviewed}) AS reviewed_documents, count(*) FILTER (events > 0) AS documents_with_corrections,
        sum(events)::BIGINT AS correction_events FROM df GROUP BY {key}) WHERE reviewed_documents > 0"""


IMPROVED = "in_map AND coalesce(status = 'completed_manual' OR events > 0, false)"

FUNNEL = f"""{FEEDBACK}, pr AS (SELECT count(*) AS processed, count(*) FILTER (status = 'completed_automatic' OR decision = 'automatic') AS automatic,
    count(*) FILTER ({MANUAL}) AS manual_review FROM {{doc_lifecycle}} WHERE {SCOPE}),
  cn AS (SELECT count(*) FILTER (in_map AND status = 'completed_manual') AS dn, count(*) FILTER (in_map AND events > 0) AS w, sum(events)::BIGINT AS ev FROM df),
  fn AS (SELECT processed, automatic, manual_review, greatest(dn, w) AS completed_manual_review, w AS with_corrections,
    greatest(dn, w) - w AS without_corrections, {rate('automatic', 'processed')} AS automatic_rate, {rate('manual_review', 'processed')} AS manual_review_rate,
    {rate('w', 'greatest(dn, w)')} AS correction_rate, {rate('greatest(dn, w) - w', 'greatest(dn, w)')} AS no_change_review_rate,
    ev AS total_correction_events, CASE WHEN w > 0 THEN round(ev / w::DOUBLE, 2) ELSE 0.0E0 END AS avg_corrections FROM pr, cn)"""


def _df(t, reviewed=True):
    return B.document_feedback(t.doc_lifecycle, t.audit_events, START, END, reviewed_scope=reviewed)


@query("feedback_funnel", f"WITH {FUNNEL} SELECT processed, automatic, manual_review, completed_manual_review, with_corrections, without_corrections, automatic_rate, manual_review_rate, correction_rate, no_change_review_rate FROM fn")
def _(t):
    return B.feedback_summary(t.doc_lifecycle, t.audit_events, START, END).drop("total_correction_events", "avg_corrections")


@query("feedback_summary", f"WITH {FUNNEL} SELECT total_correction_events, with_corrections, completed_manual_review, correction_rate, no_change_review_rate, avg_corrections FROM fn")
def _(t):
    return B.feedback_summary(t.doc_lifecycle, t.audit_events, START, END).select(
        "total_correction_events", "with_corrections", "completed_manual_review", "correction_rate", "no_change_review_rate", "avg_corrections")


BY_FIELD = f"bf AS (SELECT *, {rate('correction_count', 'sum(correction_count) OVER ()')} AS share FROM (SELECT fld AS field, count(*) AS correction_count, count(DISTINCT document_id) AS affected_documents FROM ce GROUP BY 1))"


@query("feedback_by_field", f"WITH {EVENTS_IN}, {BY_FIELD} SELECT * FROM bf")
def _(t):
    return B.by_field(t.audit_events, START, END)


@query("feedback_by_type", f"WITH {FEEDBACK} {breakdown_sql('document_type')}")
def _(t):
    return B.breakdown(_df(t), "document_type")


@query("feedback_by_reason", f"WITH {FEEDBACK} {breakdown_sql('reason')}")
def _(t):
    return B.breakdown(_df(t), "reason")


def _dimension_sql(key, reviewed="in_map"):
    return f"SELECT '{key}' AS dimension, {key} AS key, reviewed_documents, documents_with_corrections, correction_events, correction_rate FROM ({breakdown_sql(key, reviewed)})"


@query("feedback_breakdowns", f"WITH {FEEDBACK} {_dimension_sql('reason')} UNION ALL {_dimension_sql('document_type')} UNION ALL {_dimension_sql('status')}")
def _(t):
    """Reason, type and status in one pass over grouping sets."""
    return B.breakdowns(_df(t), ["reason", "document_type", "status"])


@query("feedback_by_field_approx", """SELECT coalesce(nullif(field_name, ''), 'unknown') AS field, count(*) AS correction_count, true AS within_bound
  FROM {audit_events} WHERE action = 'field_corrected' GROUP BY 1""")
def _(t):
    """Sketches per day and field, merged per field, against the exact counts: within four standard errors."""
    events = t.audit_events.withColumns({
        "field": F.coalesce(F.when(F.col("field_name") != "", F.col("field_name")), F.lit("unknown")), "day": F.to_date("created_at")})
    near = B.sketched_documents(B.correction_sketches(events, ["field", "day"]), ["field"])
    exact = B.by_field(t.audit_events).select("field", F.col("affected_documents").alias("_exact"))
    return near.join(exact, "field").select(
        "field", "correction_count", (F.abs(F.col("affected_documents") - F.col("_exact")) <= 4 * 1.04 / 64 * F.col("_exact")).alias("within_bound"))


@query("ranked_breakdowns", f"WITH {FEEDBACK}, b AS ({breakdown_sql('reason')}) SELECT * FROM b ORDER BY correction_events DESC, reviewed_documents DESC, reason")
def _(t):
    return B.ranked(B.breakdown(_df(t), "reason"), "reason")


@query("feedback_reason_field", f"WITH {FEEDBACK} SELECT reason, fld AS field, count(*) AS correction_count, count(DISTINCT document_id) AS affected_documents FROM ce JOIN df USING (document_id) GROUP BY 1, 2")
def _(t):
    return B.reason_field(t.doc_lifecycle, t.audit_events, START, END)


@query("missing_docs_backfill", f"WITH {IMPROVE} SELECT document_id, status = 'completed_manual' AS joins_reviewed FROM df WHERE in_map AND NOT (document_id IN (SELECT document_id FROM {{doc_lifecycle}} WHERE {SCOPE}))")
def _(t):
    scope = t.doc_lifecycle.where(F.col("status").isin(*O.PROCESSED) & O.in_period_either(START, END)).select("document_id")
    return _df(t, False).where("in_map").join(scope, "document_id", "left_anti").select(
        "document_id", (F.col("status") == "completed_manual").alias("joins_reviewed"))


@query("event_current_reason", f"WITH {LAST_REASON} SELECT document_id, coalesce(er, nullif(review_reason, 'none'), 'manual_review') AS reason FROM {{doc_lifecycle}} LEFT JOIN lr USING (document_id)")
def _(t):
    return B.resolve_reasons(t.doc_lifecycle, t.audit_events).select("document_id", "reason")


IMP_OVERVIEW = f"""{IMPROVE}, io AS (SELECT m AS documents_processed, greatest(dn, w) AS documents_reviewed, w AS documents_corrected, ev AS total_field_corrections,
    {rate('w', 'greatest(dn, w)')} AS correction_rate, {rate('greatest(dn, w) - w', 'greatest(dn, w)')} AS no_change_review_rate FROM (
    SELECT count(*) FILTER (in_map) AS m, count(*) FILTER (in_map AND status = 'completed_manual') AS dn,
      count(*) FILTER (in_map AND events > 0) AS w, sum(events)::BIGINT AS ev FROM df))"""


@query("improve_overview", f"WITH {IMP_OVERVIEW} SELECT * FROM io")
def _(t):
    return B.improvement_overview(t.doc_lifecycle, t.audit_events, START, END)


IMP_FIELD = f"""{BY_FIELD}, ev0 AS (SELECT field_name AS field, count(*) AS e FROM {{extracted_fields}} WHERE confidence IS NOT NULL
    AND document_id IN (SELECT document_id FROM df WHERE in_map) GROUP BY 1),
  imf AS (SELECT field, correction_count, greatest(coalesce(e, 0), correction_count) AS evaluated_count,
    {rate('correction_count', 'greatest(coalesce(e, 0), correction_count)')} AS correction_rate, share AS share_of_all_corrections, affected_documents
    FROM bf LEFT JOIN ev0 USING (field))"""


@query("improve_by_field", f"WITH {IMPROVE}, {IMP_FIELD} SELECT * FROM imf")
def _(t):
    return B.improvement_by_field(t.doc_lifecycle, t.audit_events, t.extracted_fields, START, END)


IMP_CONF = f"""ky AS (SELECT DISTINCT document_id, field_name FROM ce WHERE field_name IS NOT NULL),
  fc AS (SELECT {bucket_sql('f.confidence', FINE_BUCKETS)} AS bucket, k.document_id IS NOT NULL OR coalesce(f.corrected_value <> f.value, false) AS cr
    FROM {{extracted_fields}} f LEFT JOIN ky k ON f.document_id = k.document_id AND f.field_name = k.field_name
    WHERE f.confidence IS NOT NULL AND f.document_id IN (SELECT document_id FROM df WHERE in_map)),
  fb AS (SELECT bucket, count(*) AS ef, count(*) FILTER (cr) AS cf FROM fc GROUP BY 1),
  imc AS (SELECT bucket, evaluated_fields, corrected_fields, {rate('corrected_fields', 'evaluated_fields')} AS correction_rate,
    {rate('corrected_fields', 'CASE WHEN sum(corrected_fields) OVER () > 0 THEN sum(corrected_fields) OVER () ELSE (SELECT count(*) FROM ce) END')} AS share_of_corrections
    FROM (SELECT bucket, coalesce(ef, 0) AS evaluated_fields, coalesce(cf, 0) AS corrected_fields FROM {labels_sql(FINE_BUCKETS)} l LEFT JOIN fb USING (bucket)))"""


@query("improve_by_confidence", f"WITH {IMPROVE}, {IMP_CONF} SELECT * FROM imc")
def _(t):
    return B.improvement_by_confidence(t.doc_lifecycle, t.audit_events, t.extracted_fields, START, END)


@query("improve_by_reason", f"WITH {IMPROVE} {breakdown_sql('reason', IMPROVED)}")
def _(t):
    return B.breakdown(_df(t, False), "reason", completed_only=True)


@query("improve_by_type", f"WITH {IMPROVE} {breakdown_sql('document_type', IMPROVED)}")
def _(t):
    return B.breakdown(_df(t, False), "document_type", completed_only=True)


# Signals ------------------------------------------------------------------------------------------------------

IMP_REASON = f"imr AS ({breakdown_sql('reason', IMPROVED)})"


def signal_sql(kind: str, source: str, key: str, field: str, count: str, share: str, where: str) -> str:
    return f"""SELECT concat('sig_', lower('{kind}'), '_', sha256(concat_ws(':', '{kind}', {key}, 'all', 'all'))[1:10]) AS id, '{kind}' AS signal_type,
      {key} AS subject, {field} AS field, {count} AS corrections, {share} AS share FROM {source} WHERE {where}"""


SIG = {
    "signal_concentration": signal_sql("CORRECTION_CONCENTRATION", "imf", "field", "field", "correction_count", "share_of_all_corrections", "share_of_all_corrections >= 20 AND correction_count >= 2"),
    "signal_confidence": signal_sql("CONFIDENCE_CORRECTION_PATTERN", "imc", "bucket", "NULL::VARCHAR", "corrected_fields", "share_of_corrections", "share_of_corrections >= 25 AND corrected_fields >= 2"),
    "signal_reason": signal_sql("REVIEW_REASON_CORRECTION_PATTERN", "imr", "reason", "NULL::VARCHAR", "correction_events", "correction_rate", "correction_events >= 2 AND correction_rate >= 25"),
    "signal_quality": signal_sql("QUALITY_CORRECTION_PATTERN", "imr", "'image_quality'", "NULL::VARCHAR", "correction_events", "correction_rate", "reason = 'low_image_quality' AND correction_events >= 2"),
    "signal_validation": signal_sql("FIELD_VALIDATION_PATTERN", "imf", "field", "field", "correction_count", "NULL::DOUBLE", """correction_count >= 2 AND
      (SELECT count(*) FROM imr WHERE correction_events >= 2 AND reason IN ('validation_failed','missing_required_field','invalid_date','invalid_number')) > 0"""),
}
SIG_BASE = f"{IMP_OVERVIEW}, {IMP_FIELD}, {IMP_CONF}, {IMP_REASON}"


def _by_field(t):
    return B.improvement_by_field(t.doc_lifecycle, t.audit_events, t.extracted_fields, START, END)


def _by_reason(t):
    return B.breakdown(_df(t, False), "reason", completed_only=True)


@query("signal_concentration", f"WITH {SIG_BASE} {SIG['signal_concentration']}")
def _(t):
    return B.signal_concentration(_by_field(t))


@query("signal_confidence", f"WITH {SIG_BASE} {SIG['signal_confidence']}")
def _(t):
    return B.signal_confidence(B.improvement_by_confidence(t.doc_lifecycle, t.audit_events, t.extracted_fields, START, END))


@query("signal_reason", f"WITH {SIG_BASE} {SIG['signal_reason']}")
def _(t):
    return B.signal_reason(_by_reason(t))


@query("signal_quality", f"WITH {SIG_BASE} {SIG['signal_quality']}")
def _(t):
    return B.signal_quality(_by_reason(t))


@query("signal_validation", f"WITH {SIG_BASE} {SIG['signal_validation']}")
def _(t):
    return B.signal_validation(_by_reason(t), _by_field(t))


@query("signals", f"WITH {SIG_BASE}, sg AS ({' UNION ALL '.join(SIG.values())}) SELECT sg.* FROM sg, io WHERE documents_reviewed >= 5 AND total_field_corrections >= 2")
def _(t):
    return B.signals(t.doc_lifecycle, t.audit_events, t.extracted_fields, START, END)


@query("signal_id", """SELECT DISTINCT field_name, document_type, concat('sig_correction_concentration_', sha256(concat_ws(':', 'CORRECTION_CONCENTRATION',
    coalesce(field_name, 'global'), coalesce(document_type, 'all'), '30d'))[1:10]) AS id
  FROM {audit_events} LEFT JOIN {doc_lifecycle} USING (document_id)""")
def _(t):
    from leafscore.functions.scalars import signal_id

    rows = t.audit_events.select("document_id", "field_name").join(
        t.doc_lifecycle.select("document_id", "document_type"), "document_id", "left")
    return rows.select("field_name", "document_type").distinct().withColumn(
        "id", signal_id(F.lit("CORRECTION_CONCENTRATION"), F.col("field_name"), F.col("document_type"), "30d"))


@query("ops_control_center", f"""WITH {OVERVIEW}, {QUALITY}, {FUNNEL}, qu AS (SELECT count(*) FILTER (status = 'manual_review') AS queue_manual_review,
    count(*) FILTER (status = 'processing') AS queue_processing, count(*) FILTER (status = 'error') AS queue_errors FROM {{doc_lifecycle}})
  SELECT total_documents, processed_count, automatic_count, ov.manual_review_count, automation_rate, round(average_confidence / 100, 4) AS average_confidence,
    average_processing_time_ms, average_review_time_ms, queue_manual_review, queue_processing, queue_errors, average_quality_score, average_ocr_confidence,
    average_kie_confidence, validation_pass_rate, completed_manual_review, with_corrections, correction_rate, no_change_review_rate FROM ov, ql, fn, qu""")
def _(t):
    queue = O.queue(t.doc_lifecycle).select(
        F.col("manual_review").alias("queue_manual_review"), F.col("processing").alias("queue_processing"), F.col("errors").alias("queue_errors"))
    overview = _overview(t).select(
        "total_documents", "processed_count", "automatic_count", "manual_review_count", "automation_rate",
        F.round(F.col("average_confidence") / 100, 4).alias("average_confidence"), "average_processing_time_ms", "average_review_time_ms")
    quality = _quality(t).select("average_quality_score", "average_ocr_confidence", "average_kie_confidence", "validation_pass_rate")
    funnel = B.feedback_summary(t.doc_lifecycle, t.audit_events, START, END).select(
        "completed_manual_review", "with_corrections", "correction_rate", "no_change_review_rate")
    return O.control_center(overview, queue, quality, funnel)
