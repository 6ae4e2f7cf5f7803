"""Confidence, validation, automation decisions, preprocessing plans and review replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.functions.scalars import clamp01, is_date_text, parse_amount
from leafscore.functions.text import strip
from leafscore.operators.slices import carried, same, sliced, within

# Required fields by document type (receipt rules for unknown types) and confidence thresholds.
REQUIRED = {
    "receipt": ["company", "date", "total"],
    "invoice": ["company", "date", "total"],
    "act": ["company", "date"],
    "contract": ["company", "date"],
}
THRESHOLD = {"company": 0.90, "date": 0.90, "address": 0.85, "total": 0.95}
OTHER_THRESHOLD = 0.85
MIN_QUALITY = 0.50

ERROR_TYPE = "array<struct<field:string,code:string,message:string>>"


# Quality ----------------------------------------------------------------------------------------------------


def quality_score(measures: DataFrame) -> DataFrame:
    """Weighted quality score from measured blur, contrast, rotation and noise, with profile and advice flags."""
    blur = clamp01((F.col("blur_score") - 20.0) / 180.0)
    contrast = clamp01((F.col("contrast_score") - 15.0) / 45.0)
    skew = clamp01(1.0 - F.abs("rotation_angle") / 10.0)
    noise = clamp01(1.0 - (F.col("noise_score") - 5.0) / 20.0)
    score = F.round(0.4 * blur + 0.3 * contrast + 0.2 * skew + 0.1 * noise, 2)
    return measures.withColumn("quality_score", clamp01(score)).withColumns(
        {
            "profile_summary": F.when(F.col("quality_score") >= 0.75, "High Quality")
            .when(F.col("quality_score") >= 0.50, "Acceptable")
            .otherwise("Degraded / Review Recommended"),
            "needs_deskew": F.abs("rotation_angle") >= 2.0,
            "needs_clahe": F.col("contrast_score") < 30.0,
            "needs_denoise": F.col("noise_score") > 12.0,
        }
    )


def plan_preprocessing(measures: DataFrame) -> DataFrame:
    """Ordered clean-up operations per document: ``(document_id, step_order, operation, parameter)``."""
    steps = F.array_compact(
        F.array(
            F.when(
                F.abs("rotation_angle") >= 1.5,
                F.struct(F.lit("deskew").alias("operation"), F.col("rotation_angle").cast("double").alias("parameter")),
            ),
            F.when(
                F.col("contrast_score") < 32.0,
                F.struct(F.lit("clahe").alias("operation"), F.lit(2.0).alias("parameter")),
            ),
            F.when(
                F.col("noise_score") > 10.0,
                F.struct(F.lit("denoise_median").alias("operation"), F.lit(3.0).alias("parameter")),
            ),
        )
    )
    return measures.select("document_id", F.posexplode(steps).alias("_i", "s")).select(
        "document_id", (F.col("_i") + 2).alias("step_order"), "s.operation", "s.parameter"
    )


def step_order(measures: DataFrame) -> DataFrame:
    """All processing steps in order: quality, planned operations (or their evaluation), recognition, extraction,
    decision."""
    planned = F.array_compact(
        F.array(
            F.when(F.abs("rotation_angle") >= 1.5, F.lit("deskew")),
            F.when(F.col("contrast_score") < 32.0, F.lit("clahe")),
            F.when(F.col("noise_score") > 10.0, F.lit("denoise_median")),
        )
    )
    middle = F.when(F.size(planned) > 0, planned).otherwise(F.array(F.lit("preprocessing_evaluation")))
    last = F.array(F.lit("ocr_recognition"), F.lit("kie_extraction"), F.lit("decision_engine"))
    steps = F.concat(F.array(F.lit("quality_analysis")), middle, last)
    return measures.select("document_id", F.posexplode(steps).alias("_i", "operation")).select(
        "document_id", (F.col("_i") + 1).alias("step_order"), "operation"
    )


def evidence_rows(measures: DataFrame) -> DataFrame:
    """Quality signals with a research counterpart: rotation, noise, blur, in that order, 0..3 rows each."""
    rotated = F.coalesce("needs_deskew", F.lit(False)) | (F.abs("rotation_angle") >= 2.0)
    noisy = F.coalesce("needs_denoise", F.lit(False)) | (F.col("noise_score") > 12.0)
    blurred = (F.col("blur_score") > 0.0) & (F.col("blur_score") < 30.0)

    def entry(signal: str, value: str, unit: str, code: str) -> Column:
        return F.struct(
            F.lit(signal).alias("signal"),
            F.round(F.col(value).cast("double"), 2).alias("observed_value"),
            F.lit(unit).alias("unit"),
            F.lit(code).alias("condition_code"),
        )

    rows = F.array_compact(
        F.array(
            F.when(rotated, entry("rotation", "rotation_angle", "degrees", "D6")),
            F.when(noisy, entry("noise", "noise_score", "intensity delta", "D3")),
            F.when(blurred, entry("blur", "blur_score", "laplacian variance", "D1")),
        )
    )
    return measures.select("document_id", F.posexplode(rows).alias("position", "e")).select(
        "document_id", "position", "e.*"
    )


def evidence_lookup(measures: DataFrame, research: DataFrame) -> DataFrame:
    """Evidence rows joined to per-degradation research summaries keyed by ``condition_code``."""
    return evidence_rows(measures).join(research, "condition_code", "left")


# Confidence -------------------------------------------------------------------------------------------------


def ocr_confidence(tokens: DataFrame) -> DataFrame:
    """Mean of the numeric token confidences per document, 0 when there is none."""
    value = F.col("confidence").try_cast("double")
    return tokens.groupBy("document_id").agg(F.coalesce(F.round(F.avg(value), 4), F.lit(0.0)).alias("ocr_confidence"))


def document_confidence(
    docs: DataFrame, fields: DataFrame, tokens: DataFrame, quality: DataFrame, required: list[str] | None = None
) -> DataFrame:
    """Weighted mean of field, token and quality confidence; missing parts hand their weight on.

    Documents without fields score 0.
    """
    value = F.round(clamp01(F.coalesce("confidence", F.lit(0.0))) * 10_000).cast("long")
    counted = value if not required else F.when(F.col("field_name").isin(*required), value)
    # Four-decimal confidences are summed as integers, so that row order cannot tip a rounding.
    mean = F.sum(counted) / F.count(counted) / 10_000
    f = fields.groupBy("document_id").agg(F.coalesce(mean, F.lit(0.0)).alias("_f"))
    out = (
        docs.select("document_id")
        .join(f, "document_id", "left")
        .join(ocr_confidence(tokens), "document_id", "left")
        .join(quality.select("document_id", "quality_score"), "document_id", "left")
    )
    field, token, q = F.col("_f"), F.coalesce("ocr_confidence", "_f"), F.col("quality_score")
    score = F.when(q.isNotNull(), 0.60 * field + 0.25 * token + 0.15 * q).otherwise(0.70 * field + 0.30 * token)
    return out.select(
        "document_id",
        F.when(field.isNull(), 0.0).otherwise(F.round(clamp01(score), 4)).alias("document_confidence"),
    )


# Validation -------------------------------------------------------------------------------------------------


def validate_document(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Business validation of the active field values per document.

    Adds ``errors`` in fixed order, ``is_valid`` and ``failed_reason`` (the first error). When a field occurs more
    than once in a document the greatest value stands for it.
    """
    active = strip(F.coalesce("corrected_value", "value", F.lit("")))
    names = ["company", "date", "total"]
    pivoted = fields.groupBy("document_id").agg(
        *[F.max(F.when(F.col("field_name") == n, active)).alias(n) for n in names]
    )
    out = docs.select("document_id", "document_type").join(pivoted, "document_id", "left")
    company, date, total = (F.coalesce(n, F.lit("")) for n in names)
    needs_total = ~F.col("document_type").isin(*[k for k, v in REQUIRED.items() if "total" not in v])
    needs_total = F.coalesce(needs_total, F.lit(True))
    amount = parse_amount(total)

    def error(when: Column, field: str, code: str, message: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), message.alias("message"))
        )

    def missing(field: str, value: Column, when: Column) -> Column:
        text = F.lit(f"Mandatory field '{field}' is missing or empty.")
        return error(when & (value == ""), field, "missing_required_field", text)

    always = F.lit(True)
    errors = F.array_compact(
        F.array(
            missing("company", company, always),
            missing("date", date, always),
            missing("total", total, needs_total),
            error(
                F.char_length(company) == 1, "company", "empty_value",
                F.lit("Company name must contain at least 2 characters."),
            ),
            error(
                (total != "") & amount.isNull(), "total", "invalid_number",
                F.concat(F.lit("Total amount '"), total, F.lit("' is not a valid numeric value.")),
            ),
            error(
                (total != "") & (amount <= 0.0), "total", "document_integrity",
                F.concat(F.lit("Total amount '"), total, F.lit("' must be greater than zero.")),
            ),
            error(
                (date != "") & ~is_date_text(date), "date", "invalid_date",
                F.concat(F.lit("Date '"), date, F.lit("' does not match a recognizable date format.")),
            ),
        )
    ).cast(ERROR_TYPE)
    return out.withColumn("errors", errors).select(
        "document_id",
        "document_type",
        "errors",
        (F.size("errors") == 0).alias("is_valid"),
        F.try_element_at("errors", F.lit(1))["code"].alias("failed_reason"),
    )


def revalidate_fields(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Every field row with its validation status; a field named in an error is invalid."""
    bad = validate_document(docs, fields).select(
        "document_id", F.explode(F.array_distinct(F.transform("errors", lambda e: e["field"]))).alias("field_name"),
        F.lit("INVALID").alias("_bad"),
    )
    return fields.join(bad, ["document_id", "field_name"], "left").withColumn(
        "validation_status", F.coalesce("_bad", F.lit("VALID"))
    ).drop("_bad")


def decide(docs: DataFrame, fields: DataFrame, quality: DataFrame) -> DataFrame:
    """Automation decision through ordered gates: quality, validation, field confidence.

    Low-confidence fields are first reduced to one row per (document, field), so the list per document is no longer
    than the number of field names.
    """
    table = F.create_map(*[F.lit(x) for pair in THRESHOLD.items() for x in pair])
    per_field = fields.groupBy("document_id", "field_name").agg(F.min("confidence").alias("confidence")).withColumn(
        "threshold", F.coalesce(F.try_element_at(table, F.col("field_name")), F.lit(OTHER_THRESHOLD))
    )
    message = F.format_string(
        "Field '%s' confidence (%.2f) below threshold (%.2f).", "field_name", "confidence", "threshold"
    )
    low = (
        per_field.where(F.col("confidence") < F.col("threshold"))
        .groupBy("document_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("field_name").alias("field"), F.round("confidence", 4).alias("confidence"), "threshold",
                        message.alias("message"),
                    )
                )
            ).alias("low_fields")
        )
    )
    rows = (
        validate_document(docs, fields)
        .join(low, "document_id", "left")
        .join(quality.select("document_id", "quality_score", "profile_summary"), "document_id", "left")
    )
    poor = F.coalesce(F.col("quality_score") < MIN_QUALITY, F.lit(False))
    invalid, weak = ~F.col("is_valid"), F.col("low_fields").isNotNull()
    listed = F.array_join(F.transform("low_fields", lambda r: F.concat(F.lit("'"), r["field"], F.lit("'"))), ", ")
    return rows.select(
        "document_id",
        F.when(poor | invalid | weak, "manual_review").otherwise("automatic").alias("decision"),
        F.when(poor, "low_image_quality")
        .when(invalid, F.col("failed_reason"))
        .when(weak, "low_confidence")
        .otherwise("none")
        .alias("reason"),
        F.when(
            poor,
            F.format_string(
                "Image quality score (%.2f) below threshold (%.2f). Profile: %s", "quality_score", F.lit(MIN_QUALITY),
                "profile_summary",
            ),
        )
        .when(invalid, F.try_element_at("errors", F.lit(1))["message"])
        .when(weak & (F.size("low_fields") == 1), F.try_element_at("low_fields", F.lit(1))["message"])
        .when(weak, F.concat(F.lit("Fields "), listed, F.lit(" confidence below required threshold.")))
        .otherwise("All required fields present, confidence thresholds satisfied, quality gate passed.")
        .alias("explanation"),
        F.when(~poor & invalid, F.col("errors")).otherwise(F.array().cast(ERROR_TYPE)).alias("validation_errors"),
        F.when(~poor & ~invalid & weak, F.col("low_fields")).alias("low_fields"),
        F.when(~poor & ~invalid & weak, F.map_from_entries(F.transform("low_fields", lambda r: F.struct(
            r["field"], F.struct(F.lit("review").alias("status"), r["confidence"], r["threshold"]))))).alias("field_details"),
        F.round("quality_score", 4).alias("quality_score"),
    )


def review_details(decided: DataFrame) -> DataFrame:
    """``decided`` plus ``review_details_json``: the reasons with their measurements, null for automatic decisions.

    ``reasons`` holds one entry for poor quality, one per validation error or one per weak field; ``fields`` the status,
    confidence and threshold of the weak ones.
    """
    reason = "code string, field string, confidence double, threshold double, message string"
    entry = lambda code, field, confidence, threshold, message: F.struct(
        code.alias("code"), field.alias("field"), confidence.alias("confidence"), threshold.alias("threshold"), message.alias("message"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    reasons = (
        F.when(F.col("reason") == "low_image_quality", F.array(
            entry(F.col("reason"), none, F.col("quality_score"), F.lit(MIN_QUALITY), F.col("explanation"))))
        .when(F.size("validation_errors") > 0, F.transform(
            "validation_errors", lambda e: entry(e["code"], e["field"], number, number, e["message"])))
        .when(F.col("low_fields").isNotNull(), F.transform(
            "low_fields", lambda r: entry(F.lit("low_confidence"), r["field"], r["confidence"], r["threshold"], r["message"])))
    ).cast(f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in reason.split(', '))}>>")
    details = F.to_json(F.struct(reasons.alias("reasons"), "validation_errors", F.col("field_details").alias("fields")))
    return decided.withColumn("review_details_json", F.when(F.col("decision") == "manual_review", details))


# Events and review ------------------------------------------------------------------------------------------


def first_decision(events: DataFrame) -> DataFrame:
    """Metadata of the first decision event per document."""
    rows = events.where("action = 'decision_evaluated'")
    return rows.groupBy("document_id").agg(
        F.min_by("metadata_json", F.struct("created_at", "event_id")).alias("decision_metadata"),
        F.count("*").alias("decision_events"),
    )


def event_timestamp(docs: DataFrame, events: DataFrame, action: str) -> DataFrame:
    """Time of the first event of an action, else of the first event, else finish, else creation."""
    hit = F.col("action") == action
    seen = events.groupBy("document_id").agg(
        F.min(F.when(hit, F.col("created_at"))).alias("_hit"), F.min("created_at").alias("_any")
    )
    return docs.join(seen, "document_id", "left").select(
        "document_id", F.coalesce("_hit", "_any", "processing_finished_at", "created_at").alias("event_at")
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    """Newest job per document with its error."""
    newest = F.max_by(F.struct("job_id", "status", "error_message"), F.struct("created_at", "job_id"))
    return jobs.groupBy("document_id").agg(newest.alias("j")).select("document_id", "j.*")


def corrections_replay(fields: DataFrame, events: DataFrame, slices: int | None = None) -> DataFrame:
    """Every correction with the value it replaced, in event order per (document, field).

    The first correction replaces the extracted active value; a field created by a correction had none. Events are
    ordered by slices, so a field with very many corrections spreads over tasks.
    """
    group, order = ["document_id", "field_name"], ["created_at", "event_id"]
    base = fields.groupBy(*group).agg(F.max(F.coalesce("corrected_value", "value")).alias("_start"))
    rows = events.where("action = 'field_corrected' AND field_name IS NOT NULL").select(*group, *order, "new_value")
    cut = sliced(rows, group, order, "corrections", slices)
    at = F.struct(*order)
    cut = carried(cut, group, [F.max(at).alias("at"), F.max_by(F.struct("new_value"), at).alias("last")], {"_before": F.max_by("last", "at")})
    own = within(group, order)
    before = F.when(F.row_number().over(own) == 1, F.col("_before.new_value")).otherwise(F.lag("new_value").over(own))
    met = cut.withColumn("_prev", before).alias("e").join(base.alias("b"), same("e", "b", group), "left")
    return met.select(*[f"e.{c}" for c in group], "event_id", F.coalesce("_prev", "_start").alias("old_value"), "new_value")


def current_fields(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Field values after all corrections; a field that only a correction created has confidence 1."""
    last = (
        events.where("action = 'field_corrected' AND field_name IS NOT NULL")
        .groupBy("document_id", "field_name")
        .agg(F.max_by("new_value", F.struct("created_at", "event_id")).alias("_new"))
    )
    base = fields.groupBy("document_id", "field_name").agg(
        F.max("value").alias("value"), F.max("corrected_value").alias("corrected_value"),
        F.max("confidence").alias("confidence"), F.lit(True).alias("_known"),
    )
    out = base.join(last, ["document_id", "field_name"], "full")
    return out.select(
        "document_id",
        "field_name",
        F.coalesce("value", "_new").alias("value"),
        F.coalesce("_new", "corrected_value").alias("corrected_value"),
        F.when(F.col("_known").isNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def review_durations(docs: DataFrame) -> DataFrame:
    """Milliseconds from review start (else finish of processing, else creation) to review finish."""
    start = F.coalesce("review_started_at", "processing_finished_at", "created_at")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("review_finished_at"))
    return docs.where("review_finished_at IS NOT NULL").select(
        "document_id", F.round(micros / 1000.0, 2).alias("review_duration_ms")
    )


def review_gate(docs: DataFrame, fields: DataFrame, events: DataFrame) -> DataFrame:
    """Outcome of completing every pending review now: completed when the current values validate."""
    pending = docs.where("status = 'manual_review'")
    checked = validate_document(pending, current_fields(fields, events))
    return checked.select(
        "document_id",
        F.when(F.col("is_valid"), "completed_manual").otherwise("manual_review").alias("status"),
        F.when(F.col("is_valid"), "none").otherwise(F.col("failed_reason")).alias("review_reason"),
    )


# Research questions -----------------------------------------------------------------------------------------


def question_lifecycle(updates: DataFrame) -> DataFrame:
    """Latest status, title and references per question; nulls in an update leave the value unchanged."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return updates.groupBy("question_id").agg(
        latest("status"), latest("title"), latest("refs_json"), F.max("field").alias("field"),
        F.max("seq").alias("updates"),
    )


def list_questions(questions: DataFrame, status=None, field=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of questions, newest first, with the total before paging."""
    rows = questions
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if field is not None:
        rows = rows.where(F.col("field") == field)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("question_id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def question_enrich(questions: DataFrame, research: DataFrame) -> DataFrame:
    """Evidence references exploded and joined to the research summaries that exist."""
    refs = F.from_json("refs_json", "array<struct<track:string,experiment_id:string,b1_experiment_id:string>>")
    rows = questions.select("question_id", F.explode_outer(refs).alias("r"))
    key = F.coalesce(
        F.when(F.col("r.experiment_id") != "", F.col("r.experiment_id")), F.col("r.b1_experiment_id")
    )
    return rows.select("question_id", key.alias("experiment_id")).join(research, "experiment_id", "left")
