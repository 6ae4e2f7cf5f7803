"""Queries over confidence, validation, decisions, explanations and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.functions.scalars import is_date_text, parse_amount
from leafscore.operators import decision as D
from leafscore.operators import issues as I
from leafscore.operators import matrix as M
from leafscore.plans.ops_queries import CATEGORY
from leafscore.plans.registry import query, strip_sql


def codes(column: str):
    return F.array_join(F.transform(column, lambda e: e["code"]), ",")


def round_sql(x: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds doubles."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits})::DOUBLE"


def clamp_sql(x: str) -> str:
    return f"greatest(0.0E0, least(1.0E0, {x}))"


QS = f"""qs AS (SELECT *, CASE WHEN quality_score >= 0.75 THEN 'High Quality' WHEN quality_score >= 0.5 THEN 'Acceptable' ELSE 'Degraded / Review Recommended' END AS profile_summary,
    abs(rotation_angle) >= 2.0 AS needs_deskew, contrast_score < 30.0 AS needs_clahe, noise_score > 12.0 AS needs_denoise FROM (
    SELECT *, {clamp_sql(round_sql(f"0.4E0 * {clamp_sql('(blur_score - 20.0E0) / 180.0E0')} + 0.3E0 * {clamp_sql('(contrast_score - 15.0E0) / 45.0E0')} + 0.2E0 * {clamp_sql('1.0E0 - abs(rotation_angle) / 10.0E0')} + 0.1E0 * {clamp_sql('1.0E0 - (noise_score - 5.0E0) / 20.0E0')}", 2))} AS quality_score
    FROM {{quality_measures}}))"""


@query("quality_score", f"WITH {QS} SELECT * FROM qs")
def _(t):
    return D.quality_score(t.quality_measures)


PLAN = "list_filter([CASE WHEN abs(rotation_angle) >= 1.5 THEN 'deskew' END, CASE WHEN contrast_score < 32.0 THEN 'clahe' END, CASE WHEN noise_score > 10.0 THEN 'denoise_median' END], lambda x: x IS NOT NULL)"


@query("plan_preprocessing", f"""WITH p AS (SELECT document_id, rotation_angle, {PLAN} AS ops FROM {{quality_measures}}),
  u AS (SELECT document_id, rotation_angle, unnest(range(len(ops))) AS i, ops FROM p)
  SELECT document_id, i + 2 AS step_order, ops[i + 1] AS operation, CASE ops[i + 1] WHEN 'deskew' THEN rotation_angle WHEN 'clahe' THEN 2.0E0 ELSE 3.0E0 END AS parameter FROM u""")
def _(t):
    return D.plan_preprocessing(t.quality_measures)


@query("step_order", f"""WITH p AS (SELECT document_id, {PLAN} AS ops FROM {{quality_measures}}),
  a AS (SELECT document_id, list_concat(list_concat(['quality_analysis'], CASE WHEN len(ops) > 0 THEN ops ELSE ['preprocessing_evaluation'] END),
    ['ocr_recognition', 'kie_extraction', 'decision_engine']) AS st FROM p)
  SELECT document_id, unnest(range(1, len(st) + 1)) AS step_order, unnest(st) AS operation FROM a""")
def _(t):
    return D.step_order(t.quality_measures)


EVID = f"""{QS}, ev AS (SELECT document_id, list_filter([CASE WHEN abs(rotation_angle) >= 2.0 THEN 'rotation' END, CASE WHEN noise_score > 12.0 THEN 'noise' END,
    CASE WHEN blur_score > 0 AND blur_score < 30 THEN 'blur' END], lambda x: x IS NOT NULL) AS sg, rotation_angle, noise_score, blur_score FROM qs),
  er AS (SELECT document_id, position, sg[position + 1] AS signal, round(CASE sg[position + 1] WHEN 'rotation' THEN rotation_angle WHEN 'noise' THEN noise_score ELSE blur_score END, 2) AS observed_value,
    CASE sg[position + 1] WHEN 'rotation' THEN 'degrees' WHEN 'noise' THEN 'intensity delta' ELSE 'laplacian variance' END AS unit,
    CASE sg[position + 1] WHEN 'rotation' THEN 'D6' WHEN 'noise' THEN 'D3' ELSE 'D1' END AS condition_code FROM (SELECT *, unnest(range(len(sg))) AS position FROM ev))"""
RESEARCH = "rs AS (SELECT concat('D', d::VARCHAR) AS condition_code, count(*) AS conditions, max(cer) AS worst_cer FROM {condition_means} WHERE p = 0 AND s > 0 GROUP BY d)"


def _research(t, key="condition_code"):
    return M.curve_extents(t.condition_means).join(
        t.condition_means.where("p = 0 AND s > 0").groupBy("d").agg(F.count("*").alias("conditions")), "d"
    ).select(F.concat(F.lit("D"), F.col("d").cast("string")).alias(key), "conditions", F.col("max_cer").alias("worst_cer"))


@query("evidence_lookup", f"WITH {EVID}, {RESEARCH} SELECT * FROM er LEFT JOIN rs USING (condition_code)")
def _(t):
    return D.evidence_lookup(D.quality_score(t.quality_measures), _research(t))


OCR_CONF = "oc AS (SELECT document_id, coalesce(round(avg(TRY_CAST(confidence AS DOUBLE)), 4), 0.0E0) AS ocr_confidence FROM {page_tokens} GROUP BY 1)"


@query("ocr_confidence", f"WITH {OCR_CONF} SELECT * FROM oc")
def _(t):
    return D.ocr_confidence(t.page_tokens)


@query("document_confidence", f"""WITH {OCR_CONF}, fc AS (SELECT document_id, sum(CAST(round({clamp_sql('coalesce(confidence, 0)')} * 10000) AS BIGINT)) / count(*)::DOUBLE / 10000.0E0 AS f FROM {{review_fields}} GROUP BY 1)
  SELECT d.document_id, CASE WHEN f IS NULL THEN 0.0E0 WHEN quality_score IS NOT NULL THEN
      {round_sql(clamp_sql('0.6E0 * f + 0.25E0 * coalesce(ocr_confidence, f) + 0.15E0 * quality_score'), 4)}
    ELSE {round_sql(clamp_sql('0.7E0 * f + 0.3E0 * coalesce(ocr_confidence, f)'), 4)} END AS document_confidence
  FROM {{doc_lifecycle}} d LEFT JOIN fc USING (document_id) LEFT JOIN oc USING (document_id) LEFT JOIN {{document_quality}} USING (document_id)""")
def _(t):
    return D.document_confidence(t.doc_lifecycle, t.review_fields, t.page_tokens, t.document_quality)


AMOUNT = """TRY_CAST(CASE WHEN regexp_matches({0}, '^\\d+(\\.\\d+)?$') THEN {0} END AS DOUBLE)"""
CLEAN = """(CASE WHEN contains(am, ',') AND NOT contains(am, '.') THEN replace(am, ',', '.') WHEN contains(am, ',') THEN replace(am, ',', '') ELSE am END)"""


def unmarked(x: str) -> str:
    """An amount without currency marks."""
    front = strip_sql(f"regexp_replace({strip_sql(x)}, '^([$€£]|RM|USD|EUR)\\s*', '', 'i')")
    return strip_sql(f"regexp_replace({front}, '\\s*([$€£]|RM|USD|EUR)$', '', 'i')")


DATE_OK = "(length({0}) >= 4 AND (regexp_matches({0}, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}$') OR regexp_matches({0}, '^\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{2,4}}$') OR regexp_matches({0}, '^\\d{{1,2}}\\s+[A-Za-z]{{3,9}}\\s+\\d{{2,4}}$') OR regexp_matches({0}, '^[A-Za-z]{{3,9}}\\s+\\d{{1,2}},?\\s+\\d{{2,4}}$')))"


def validation_sql(fields: str, docs: str = "{doc_lifecycle}") -> str:
    return f"""pv AS (SELECT document_id, document_type, coalesce(co, '') AS co, coalesce(da, '') AS da, coalesce(tt, '') AS tt, {unmarked("coalesce(tt, '')")} AS am
    FROM {docs} LEFT JOIN (SELECT document_id, max(v) FILTER (field_name = 'company') AS co, max(v) FILTER (field_name = 'date') AS da,
      max(v) FILTER (field_name = 'total') AS tt FROM (SELECT document_id, field_name, {strip_sql("coalesce(corrected_value, value, '')")} AS v FROM {fields}) GROUP BY 1) USING (document_id)),
  pw AS (SELECT *, {AMOUNT.format(CLEAN)} AS n FROM pv),
  er0 AS (SELECT document_id, document_type, da, tt, list_filter([CASE WHEN co = '' THEN 'company|missing_required_field' END, CASE WHEN da = '' THEN 'date|missing_required_field' END,
      CASE WHEN tt = '' AND document_type NOT IN ('act', 'contract') THEN 'total|missing_required_field' END, CASE WHEN length(co) = 1 THEN 'company|empty_value' END,
      CASE WHEN tt <> '' AND n IS NULL THEN 'total|invalid_number' END, CASE WHEN tt <> '' AND n <= 0 THEN 'total|document_integrity' END,
      CASE WHEN da <> '' AND NOT {DATE_OK.format('da')} THEN 'date|invalid_date' END], lambda x: x IS NOT NULL) AS er FROM pw),
  vd AS (SELECT document_id, document_type, da, tt, er, array_to_string(list_transform(er, lambda x: split_part(x, '|', 2)), ',') AS errors,
    len(er) = 0 AS is_valid, split_part(er[1], '|', 2) AS failed_reason FROM er0)"""


@query("validate_document", f"WITH {validation_sql('{review_fields}')} SELECT document_id, document_type, errors, is_valid, failed_reason FROM vd")
def _(t):
    return D.validate_document(t.doc_lifecycle, t.review_fields).withColumn("errors", codes("errors"))


@query("revalidate_fields", f"""WITH {validation_sql('{review_fields}')}, b AS (SELECT DISTINCT document_id, split_part(e, '|', 1) AS field_name FROM (SELECT document_id, unnest(er) AS e FROM vd))
  SELECT f.document_id, f.field_name, f.value, CASE WHEN b.field_name IS NULL THEN 'VALID' ELSE 'INVALID' END AS validation_status
  FROM {{review_fields}} f LEFT JOIN b ON f.document_id = b.document_id AND f.field_name = b.field_name""")
def _(t):
    return D.revalidate_fields(t.doc_lifecycle, t.review_fields).select("document_id", "field_name", "value", "validation_status")


@query("decide", f"""WITH {QS}, {validation_sql('{review_fields}')},
  th AS (SELECT document_id, field_name, confidence, CASE field_name WHEN 'company' THEN 0.9E0 WHEN 'date' THEN 0.9E0 WHEN 'address' THEN 0.85E0 WHEN 'total' THEN 0.95E0 ELSE 0.85E0 END AS threshold
    FROM (SELECT document_id, field_name, min(confidence) AS confidence FROM {{review_fields}} GROUP BY 1, 2)),
  lo AS (SELECT document_id, count(*) AS n, string_agg(concat('''', field_name, ''''), ', ' ORDER BY field_name) AS names,
    min(printf('Field ''%s'' confidence (%.2f) below threshold (%.2f).', field_name, confidence, threshold)) AS msg FROM th WHERE confidence < threshold GROUP BY 1),
  j AS (SELECT vd.*, n, names, msg, quality_score, profile_summary, coalesce(quality_score < 0.5, false) AS poor FROM vd LEFT JOIN lo USING (document_id)
    LEFT JOIN (SELECT document_id, quality_score, profile_summary FROM qs) USING (document_id))
  SELECT document_id, CASE WHEN poor OR NOT is_valid OR n > 0 THEN 'manual_review' ELSE 'automatic' END AS decision,
    CASE WHEN poor THEN 'low_image_quality' WHEN NOT is_valid THEN failed_reason WHEN n > 0 THEN 'low_confidence' ELSE 'none' END AS reason,
    CASE WHEN poor THEN printf('Image quality score (%.2f) below threshold (0.50). Profile: %s', quality_score, profile_summary)
      WHEN NOT is_valid THEN CASE failed_reason WHEN 'missing_required_field' THEN concat('Mandatory field ''', split_part(er[1], '|', 1), ''' is missing or empty.')
        WHEN 'empty_value' THEN 'Company name must contain at least 2 characters.' WHEN 'invalid_number' THEN concat('Total amount ''', tt, ''' is not a valid numeric value.')
        WHEN 'document_integrity' THEN concat('Total amount ''', tt, ''' must be greater than zero.') ELSE concat('Date ''', da, ''' does not match a recognizable date format.') END
      WHEN n = 1 THEN msg WHEN n > 1 THEN concat('Fields ', names, ' confidence below required threshold.')
      ELSE 'All required fields present, confidence thresholds satisfied, quality gate passed.' END AS explanation FROM j""")
def _(t):
    return D.decide(t.doc_lifecycle, t.review_fields, D.quality_score(t.quality_measures)).drop(
        "validation_errors", "low_fields", "field_details", "quality_score")


@query("decision_details", f"""WITH {QS}, {validation_sql('{review_fields}')},
  th AS (SELECT document_id, field_name, round(min(confidence), 4) AS c, CASE field_name WHEN 'company' THEN 0.9E0 WHEN 'date' THEN 0.9E0 WHEN 'address' THEN 0.85E0 WHEN 'total' THEN 0.95E0 ELSE 0.85E0 END AS t
    FROM {{review_fields}} GROUP BY 1, 2),
  lo AS (SELECT document_id, string_agg(concat('low_confidence|', field_name, '|', c::VARCHAR, '|', t::VARCHAR), ';' ORDER BY field_name) AS low,
    string_agg(field_name, ';' ORDER BY field_name) AS names FROM th WHERE c < t GROUP BY 1),
  j AS (SELECT vd.document_id, er, is_valid, low, names, coalesce(quality_score < 0.5, false) AS poor, round(quality_score, 4) AS q FROM vd LEFT JOIN lo USING (document_id)
    LEFT JOIN (SELECT document_id, quality_score FROM qs) USING (document_id))
  SELECT document_id, CASE WHEN poor THEN concat('low_image_quality|-|', q::VARCHAR, '|0.5')
      WHEN NOT is_valid THEN array_to_string(list_transform(er, lambda e: concat(split_part(e, '|', 2), '|', split_part(e, '|', 1), '|-|-')), ';') ELSE low END AS reasons,
    CASE WHEN NOT poor AND is_valid THEN names END AS fields FROM j""")
def _(t):
    """What the details of a manual review hold, read back from their JSON."""
    found = D.review_details(D.decide(t.doc_lifecycle, t.review_fields, D.quality_score(t.quality_measures)))
    shape = "reasons array<struct<code:string,field:string,confidence:double,threshold:double>>, fields map<string,struct<status:string,confidence:double,threshold:double>>"
    read = found.select("document_id", F.from_json("review_details_json", shape).alias("d"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    each = F.transform("d.reasons", lambda r: F.concat_ws("|", r["code"], text(r["field"]), text(r["confidence"]), text(r["threshold"])))
    return read.select("document_id", F.array_join(each, ";").alias("reasons"), F.array_join(F.array_sort(F.map_keys("d.fields")), ";").alias("fields"))


@query("parse_amount", f"SELECT document_id, field_name, {AMOUNT.format(CLEAN)} AS amount FROM (SELECT *, {unmarked('pred')} AS am FROM {{kie_pairs}})")
def _(t):
    return t.kie_pairs.select("document_id", "field_name", parse_amount(F.col("pred")).alias("amount"))


@query("is_date_text", f"SELECT document_id, field_name, {DATE_OK.format(strip_sql('pred'))} AS is_date FROM {{kie_pairs}}")
def _(t):
    return t.kie_pairs.select("document_id", "field_name", is_date_text(F.col("pred")).alias("is_date"))


@query("event_first_decision", """SELECT document_id, arg_min(metadata_json, {'a': created_at, 'b': event_id}) AS decision_metadata, count(*) AS decision_events
  FROM {audit_events} WHERE action = 'decision_evaluated' GROUP BY 1""")
def _(t):
    return D.first_decision(t.audit_events)


STAMP = """(SELECT d.document_id, coalesce(h, a, processing_finished_at, d.created_at) AS event_at FROM {{doc_lifecycle}} d LEFT JOIN (SELECT document_id,
    min(created_at) FILTER (action = '{0}') AS h, min(created_at) AS a FROM {{audit_events}} GROUP BY 1) e USING (document_id))"""


@query("event_timestamp", f"SELECT * FROM {STAMP.format('decision_evaluated')}")
def _(t):
    return D.event_timestamp(t.doc_lifecycle, t.audit_events, "decision_evaluated")


JOB = """(SELECT document_id, j.job_id, j.status, j.error_message FROM (SELECT document_id, arg_max({'job_id': job_id, 'status': status, 'error_message': error_message},
    {'a': created_at, 'b': job_id}) AS j FROM {processing_jobs} GROUP BY 1))"""


@query("latest_job", f"SELECT * FROM {JOB}")
def _(t):
    return D.latest_job(t.processing_jobs)


@query("corrections_replay", """WITH b AS (SELECT document_id, field_name, max(coalesce(corrected_value, value)) AS st FROM {extracted_fields} GROUP BY 1, 2)
  SELECT e.document_id, e.field_name, event_id, coalesce(lag(new_value) OVER (PARTITION BY e.document_id, e.field_name ORDER BY created_at, event_id), st) AS old_value, new_value
  FROM {audit_events} e LEFT JOIN b ON e.document_id = b.document_id AND e.field_name = b.field_name WHERE action = 'field_corrected' AND e.field_name IS NOT NULL""")
def _(t):
    return D.corrections_replay(t.extracted_fields, t.audit_events)


CURRENT = """cf AS (SELECT coalesce(b.document_id, n.document_id) AS document_id, coalesce(b.field_name, n.field_name) AS field_name, coalesce(v, nv) AS value,
    coalesce(nv, cv) AS corrected_value, CASE WHEN b.document_id IS NULL THEN 1.0E0 ELSE c END AS confidence
  FROM (SELECT document_id, field_name, max(value) AS v, max(corrected_value) AS cv, max(confidence) AS c FROM {review_fields} GROUP BY 1, 2) b
  FULL JOIN (SELECT document_id, field_name, arg_max(new_value, {'a': created_at, 'b': event_id}) AS nv FROM {audit_events}
    WHERE action = 'field_corrected' AND field_name IS NOT NULL GROUP BY 1, 2) n ON b.document_id = n.document_id AND b.field_name = n.field_name)"""


@query("current_fields", f"WITH {CURRENT} SELECT * FROM cf")
def _(t):
    return D.current_fields(t.review_fields, t.audit_events)


@query("review_durations", """SELECT document_id, round(date_diff('microsecond', coalesce(review_started_at, processing_finished_at, created_at), review_finished_at) / 1000.0E0, 2) AS review_duration_ms
  FROM {doc_lifecycle} WHERE review_finished_at IS NOT NULL""")
def _(t):
    return D.review_durations(t.doc_lifecycle)


@query("review_gate", f"""WITH {CURRENT}, pd AS (SELECT * FROM {{doc_lifecycle}} WHERE status = 'manual_review'), {validation_sql('cf', 'pd')}
  SELECT document_id, CASE WHEN is_valid THEN 'completed_manual' ELSE 'manual_review' END AS status, CASE WHEN is_valid THEN 'none' ELSE failed_reason END AS review_reason FROM vd""")
def _(t):
    return D.review_gate(t.doc_lifecycle, t.review_fields, t.audit_events)


QUESTIONS = """qn AS (SELECT question_id, arg_max(status, seq) AS status, arg_max(title, seq) FILTER (title IS NOT NULL) AS title,
    arg_max(refs_json, seq) FILTER (refs_json IS NOT NULL) AS refs_json, max(field) AS field, max(seq) AS updates FROM {question_updates} GROUP BY 1)"""


@query("question_lifecycle", f"WITH {QUESTIONS} SELECT * FROM qn")
def _(t):
    return D.question_lifecycle(t.question_updates)


@query("list_questions", f"WITH {QUESTIONS}, f AS (SELECT question_id, status, field FROM qn WHERE field = 'date') SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY question_id DESC LIMIT 10 OFFSET 5")
def _(t):
    return D.list_questions(D.question_lifecycle(t.question_updates).select("question_id", "status", "field"), field="date", limit=10, offset=5)


@query("question_enrich", f"""WITH {QUESTIONS}, {RESEARCH}, rf AS (SELECT question_id, unnest(CASE WHEN refs_json IS NULL THEN [NULL]::JSON[] ELSE CAST(json(refs_json) AS JSON[]) END) AS r FROM qn),
  k AS (SELECT question_id, coalesce(json_extract_string(r, '$.experiment_id'), json_extract_string(r, '$.b1_experiment_id')) AS experiment_id FROM rf)
  SELECT question_id, experiment_id, conditions, worst_cer FROM k LEFT JOIN rs ON k.experiment_id = rs.condition_code""")
def _(t):
    return D.question_enrich(D.question_lifecycle(t.question_updates), _research(t, "experiment_id"))


# Explanations and issues ----------------------------------------------------------------------------------------

EXPLAIN = """fd AS (SELECT document_id, arg_min(metadata_json, {'a': created_at, 'b': event_id}) AS j FROM {audit_events} WHERE action = 'decision_evaluated' GROUP BY 1),
  x0 AS (SELECT d.*, fd.document_id IS NOT NULL AS has, nullif(json_extract_string(j, '$.reason'), 'none') AS er, nullif(review_reason, 'none') AS ow,
      coalesce(decision, CASE WHEN status = 'completed_automatic' THEN 'automatic' WHEN status IN ('manual_review','completed_manual') THEN 'manual_review'
        WHEN status IN ('uploaded','processing') THEN 'pending' ELSE 'rejected' END) AS dec, json_extract(j, '$.review_details.reasons') AS rs, json_extract_string(j, '$.explanation') AS tx
    FROM {doc_lifecycle} d LEFT JOIN fd USING (document_id)),
  x1 AS (SELECT *, dec NOT IN ('automatic','pending') AS ex, status = 'completed_manual' AND has AS cm FROM x0),
  x2 AS (SELECT *, CASE WHEN NOT ex THEN NULL WHEN cm THEN er ELSE coalesce(ow, er) END AS primary_reason, ex AND (cm OR ow IS NULL) AS rd FROM x1),
  rr AS (SELECT document_id, primary_reason, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS r FROM (SELECT document_id, primary_reason, CAST(rs AS JSON[]) AS l FROM x2 WHERE rd AND rs IS NOT NULL)),
  rp AS (SELECT document_id, position, CASE WHEN o THEN json_extract_string(r, '$.code') WHEN split_part(s, ':', 1) = 'low_field_confidence' THEN 'low_confidence' ELSE split_part(s, ':', 1) END AS code,
      CASE WHEN o THEN json_extract_string(r, '$.field') WHEN contains(s, ':') THEN split_part(s, ':', 2) END AS field, json_extract_string(r, '$.message') AS msg,
      CASE WHEN o THEN CAST(json_extract_string(r, '$.confidence') AS DOUBLE) END AS ob, CASE WHEN o THEN CAST(json_extract_string(r, '$.threshold') AS DOUBLE) END AS li, o
    FROM (SELECT *, json_type(r) = 'OBJECT' AS o, json_extract_string(r, '$') AS s FROM rr)),
  xr AS (SELECT document_id, position, code, field, ob, li, CASE WHEN o THEN coalesce(msg, concat(upper(code[1]), replace(code[2:], '_', ' '), '.'))
      ELSE concat('Condition ', replace(code, '_', ' '), ' triggered', CASE WHEN field IS NULL THEN '.' ELSE concat(' on field ''', field, '''.') END) END AS message FROM rp
    UNION ALL SELECT document_id, 0, primary_reason, NULL, NULL, NULL, coalesce(CASE WHEN rd THEN tx END, concat('Document routed to manual review: ', replace(primary_reason, '_', ' '), '.'))
    FROM x2 WHERE primary_reason IS NOT NULL AND NOT (rd AND rs IS NOT NULL)),
  xn AS (SELECT document_id, count(*) AS n, string_agg(code, ',' ORDER BY position) AS codes FROM xr GROUP BY 1),
  xe AS (SELECT document_id, status, dec AS decision, primary_reason, coalesce(codes, '') AS codes, dec = 'automatic' AS automatic_eligible,
      CASE WHEN dec = 'automatic' THEN 'Document met all criteria for automatic straight-through processing.' WHEN dec = 'pending' THEN 'Document processing in progress; automation decision pending.'
        WHEN n > 0 AND primary_reason IS NOT NULL THEN concat('Manual review required due to ', replace(primary_reason, '_', ' '), ' (', n, ' blocking condition(s)).')
        WHEN n > 0 THEN concat('Manual review required (', n, ' blocking condition(s)).') ELSE 'Manual review required by operational policy.' END AS summary
    FROM x2 LEFT JOIN xn USING (document_id))"""


@query("explain_decision", f"WITH {EXPLAIN} SELECT * FROM xe")
def _(t):
    out = I.explain_decision(t.doc_lifecycle, t.audit_events)
    return out.withColumn("codes", codes("reasons")).drop("reasons")


@query("explanation_reasons", f"WITH {EXPLAIN} SELECT document_id, position, code, field, message FROM xr")
def _(t):
    out = I.explain_decision(t.doc_lifecycle, t.audit_events)
    return out.select("document_id", F.posexplode("reasons").alias("position", "r")).select(
        "document_id", "position", "r.code", "r.field", "r.message")


RESOLUTION = """CASE WHEN status IN ('completed_automatic','completed_manual') OR review_finished_at IS NOT NULL THEN 'resolved'
  WHEN status = 'manual_review' AND review_started_at IS NOT NULL THEN 'in_review' ELSE 'open' END"""


@query("resolution_status", f"SELECT document_id, {RESOLUTION} AS resolution FROM {{doc_lifecycle}}")
def _(t):
    return t.doc_lifecycle.select("document_id", I.resolution_status().alias("resolution"))


SIMILAR = """sm AS (SELECT document_id, review_reason AS code, concat(n - 1, ' similar manual review(s) recorded: ', k - h, ' contained correction(s), ', n - 1 - (k - h), ' had no changes.') AS historical
  FROM (SELECT document_id, review_reason, h, count(*) OVER (PARTITION BY review_reason) AS n, sum(h) OVER (PARTITION BY review_reason)::BIGINT AS k FROM (SELECT document_id, review_reason,
    (document_id IN (SELECT document_id FROM {audit_events} WHERE action = 'field_corrected'))::INT AS h FROM {doc_lifecycle} WHERE review_reason <> 'none')) WHERE n > 1)"""
ISSUES = f"""{EXPLAIN}, {EVID}, {SIMILAR}, dr AS (SELECT *, {RESOLUTION} AS rez FROM {{doc_lifecycle}}),
  i0 AS (SELECT xr.*, rez, dr.status, st.event_at, replace(replace({CATEGORY.format('xr.code')}, 'pipeline', 'processing'), 'none', 'manual_review') AS category, historical, sg1.condition_code AS cond
    FROM xr JOIN dr USING (document_id) LEFT JOIN {STAMP.format('decision_evaluated')} st USING (document_id)
      LEFT JOIN (SELECT document_id, condition_code FROM er WHERE position = 0) sg1 USING (document_id) LEFT JOIN sm ON sm.document_id = xr.document_id AND sm.code = xr.code),
  iss AS (SELECT document_id, concat('iss-', document_id, '-', position) AS issue_id, category, CASE WHEN rez = 'resolved' THEN 'info' WHEN category = 'processing' THEN 'critical'
      WHEN category IN ('validation','confidence') THEN 'high' ELSE 'medium' END AS severity, code, field,
      concat(CASE category WHEN 'confidence' THEN 'Low Field Extraction Confidence' WHEN 'validation' THEN 'Domain Validation Rule Violation' WHEN 'quality' THEN 'Image Quality Degradation Detected'
        WHEN 'processing' THEN 'Pipeline Execution Issue' ELSE 'Manual Review Routing Reason' END, CASE WHEN field IS NOT NULL THEN concat(': ', field) ELSE '' END) AS title,
      CASE category WHEN 'confidence' THEN 'confidence_engine' WHEN 'validation' THEN 'document_validator' WHEN 'quality' THEN 'quality_analyzer' ELSE 'decision_engine' END AS source,
      rez AS issue_status, CASE WHEN ob IS NOT NULL AND li IS NOT NULL THEN concat('Observed value (', ob, ') failed configured policy threshold (', li, ').') ELSE message END AS production,
      historical, CASE WHEN category = 'quality' THEN cond END AS condition_code, event_at AS created_at, status = 'manual_review' AS can_review, status IN ('error','manual_review') AS can_retry,
      message AS description, ob::DOUBLE AS observed_value, li::DOUBLE AS threshold, CASE WHEN category = 'quality' AND cond IS NOT NULL THEN concat('Research evidence available: ',
        CASE cond WHEN 'D1' THEN 'Gaussian Blur Robustness' WHEN 'D3' THEN 'Gaussian Noise Robustness' ELSE 'Rotation & Skew Robustness' END, ' (', cond,
        '). B1 degradation curves and B2 preprocessing benchmarks are available for operator inspection.') END AS research FROM i0
    UNION ALL SELECT dr.document_id, concat('iss-', dr.document_id, '-proc'), 'processing', 'critical', coalesce(nullif(review_reason, 'none'), 'pipeline_failure'), NULL,
      'Document Processing Pipeline Failure', 'processing_pipeline', rez, coalesce(jb.error_message, concat('Processing failed with error code: ', coalesce(nullif(review_reason, 'none'), 'pipeline_failure'))),
      NULL, NULL, st.event_at, false, true, coalesce(jb.error_message, concat('Processing terminated due to pipeline failure (', coalesce(nullif(review_reason, 'none'), 'pipeline_failure'), ').')),
      NULL, NULL, NULL FROM dr LEFT JOIN {JOB} jb USING (document_id) LEFT JOIN {STAMP.format('processing_failed')} st USING (document_id) WHERE dr.status = 'error')"""


def _issues(t):
    return I.derive_issues(t.doc_lifecycle, t.audit_events, t.processing_jobs, D.quality_score(t.quality_measures))


@query("derive_issues", f"WITH {ISSUES} SELECT * FROM iss")
def _(t):
    return _issues(t)


@query("issue_summary", f"""WITH {ISSUES}, k AS (SELECT document_id, count(*) AS ti, count(*) FILTER (severity IN ('critical','high') AND issue_status <> 'resolved') AS bi FROM iss GROUP BY 1)
  SELECT document_id, rez AS overall_status, coalesce(ti, 0) AS total_issues, coalesce(bi, 0) AS blocking_issues,
    CASE WHEN coalesce(ti, 0) = 0 THEN 'Zero operational issues detected. Document processed straight-through.' WHEN rez = 'resolved' THEN 'Document processing completed and resolved. Operational review is satisfied.'
      WHEN bi > 0 THEN concat(bi, ' blocking operational issue(s) require manual operator review and resolution.') ELSE concat(ti, ' non-blocking operational advisory issue(s) identified.') END AS summary
  FROM dr LEFT JOIN k USING (document_id)""")
def _(t):
    return I.issue_summary(t.doc_lifecycle, _issues(t))


ACTIONS = f"""{ISSUES}, ac AS (SELECT document_id, issue_id, list_filter([CASE WHEN field IS NOT NULL THEN concat('act-field-', field, '|open_field|fields') END,
    CASE WHEN category = 'validation' THEN 'act-validation|open_validation|fields' END, CASE WHEN category = 'quality' THEN 'act-quality|open_quality_evidence|quality' END,
    CASE WHEN condition_code IS NOT NULL THEN concat('act-research-', lower(condition_code), '|open_research_evidence|research') END,
    CASE WHEN can_review AND issue_status <> 'resolved' THEN 'act-review|open_review|review' END,
    CASE WHEN can_retry AND (category = 'processing' OR code IN ('pipeline_failure','ocr_error','kie_error','system_error')) THEN 'act-retry|retry_processing|pipeline' END,
    'act-document|open_document|document'], lambda x: x IS NOT NULL) AS l FROM iss),
  al AS (SELECT document_id, issue_id, position, split_part(a, '|', 1) AS action_id, split_part(a, '|', 2) AS type, split_part(a, '|', 3) AS target
    FROM (SELECT document_id, issue_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS a FROM ac))"""


@query("issue_actions", f"WITH {ACTIONS} SELECT * FROM al")
def _(t):
    return I.issue_actions(_issues(t))


@query("unique_actions", f"""WITH {ACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, action_id
    ORDER BY CASE WHEN issue_id LIKE '%proc' THEN -1 ELSE split_part(issue_id, '-', 3)::INT END, position) AS rn FROM al)
  SELECT document_id, action_id, issue_id, type, target FROM r WHERE rn = 1""")
def _(t):
    return I.unique_actions(I.issue_actions(_issues(t)))
