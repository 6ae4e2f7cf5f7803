"""Decision explanations, derived operational issues and the actions offered for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.functions.scalars import reason_category
from leafscore.functions.text import humanize
from leafscore.operators.decision import evidence_rows, event_timestamp, first_decision, latest_job
from leafscore.operators.ops import DETAILS, MANUAL_STATUS, metadata, similar_documents

REASON_TYPE = "struct<code:string,field:string,confidence:double,threshold:double,message:string>"
PIPELINE_CODES = ("pipeline_failure", "ocr_error", "kie_error", "system_error")

# Issue titles and sources by category.
TITLES = {
    "confidence": "Low Field Extraction Confidence",
    "validation": "Domain Validation Rule Violation",
    "quality": "Image Quality Degradation Detected",
    "processing": "Pipeline Execution Issue",
    "manual_review": "Manual Review Routing Reason",
}
SOURCES = {"confidence": "confidence_engine", "validation": "document_validator", "quality": "quality_analyzer"}


def effective_decision() -> Column:
    """Stored decision, else the one the status implies."""
    st = F.col("status")
    return F.coalesce(
        "decision",
        F.when(st == "completed_automatic", "automatic")
        .when(st.isin(*MANUAL_STATUS), "manual_review")
        .when(st.isin("uploaded", "processing"), "pending")
        .otherwise("rejected"),
    )


def _named(code: Column) -> Column:
    return F.when((code != "") & (code != "none"), code)


def _spaced(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def _parse_reason(text: Column, primary: Column, fields: Column) -> Column:
    """One entry of ``reasons``: an object, or a ``code:field`` string looked up in the per-field details."""
    obj = F.from_json(text, REASON_TYPE)
    code = F.coalesce(F.when(obj["code"] != "", obj["code"]), primary, F.lit("validation_failed"))
    from_object = F.struct(
        code.alias("code"),
        obj["field"].alias("field"),
        obj["confidence"].alias("confidence"),
        obj["threshold"].alias("threshold"),
        F.coalesce(F.when(obj["message"] != "", obj["message"]), F.concat(humanize(code), F.lit("."))).alias("message"),
    )
    parts = F.split(text, ":")
    raw, field = parts[0], F.try_element_at(parts, F.lit(2))
    plain = F.when(raw == "low_field_confidence", "low_confidence").otherwise(raw)
    detail = F.try_element_at(fields, F.coalesce(field, F.lit("")))
    said = F.concat(F.lit("Condition "), _spaced(plain), F.lit(" triggered"))
    from_text = F.struct(
        plain.alias("code"),
        field.alias("field"),
        detail["confidence"].alias("confidence"),
        detail["threshold"].alias("threshold"),
        F.when(detail["reason"] != "", detail["reason"])
        .when(field.isNull() | (field == ""), F.concat(said, F.lit(".")))
        .otherwise(F.concat(said, F.lit(" on field '"), field, F.lit("'.")))
        .alias("message"),
    )
    return F.when(text.startswith("{"), from_object).otherwise(from_text)


def explain_decision(docs: DataFrame, events: DataFrame) -> DataFrame:
    """One row per document: decision, primary reason, structured reasons and summary.

    A completed review reads its first decision event, because the document's own reason has been reset; other
    documents read their own reason first and the event after it.
    """
    d = effective_decision()
    rows = docs.join(first_decision(events), "document_id", "left").withColumns(
        {"decision": d, "_m": metadata("decision_metadata")}
    )
    own, event = _named(F.col("review_reason")), _named(F.col("_m.reason"))
    completed = (F.col("status") == "completed_manual") & F.col("decision_events").isNotNull()
    read_event = completed | own.isNull()
    explained = ~F.col("decision").isin("automatic", "pending")
    primary = F.when(completed, event).otherwise(F.coalesce(own, event))
    details = F.when(read_event, F.col("_m.review_details"))
    if "review_details_json" in docs.columns:
        own_details = F.from_json("review_details_json", DETAILS)
        details = F.coalesce(own_details, details)
    rows = rows.withColumns(
        {
            "primary_reason": F.when(explained, primary),
            "_details": F.when(explained, details),
            "_text": F.when(explained & read_event, F.col("_m.explanation")),
        }
    )
    none = F.array().cast(f"array<{REASON_TYPE}>")
    p, per_field = F.col("primary_reason"), F.col("_details.fields")
    strings = F.array().cast("array<string>")
    listed = F.transform(F.coalesce("_details.reasons", strings), lambda r: _parse_reason(r, p, per_field))
    invalid = F.transform(
        F.filter(F.coalesce("_details.validation_errors", strings), lambda r: r.startswith("{")),
        lambda r: _parse_reason(r, F.lit("validation_failed"), per_field),
    )
    single = F.array(
        F.struct(
            p.alias("code"),
            F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("double").alias("threshold"),
            F.coalesce(
                F.when(F.col("_text") != "", F.col("_text")),
                F.concat(F.lit("Document routed to manual review: "), _spaced(p), F.lit(".")),
            ).alias("message"),
        )
    )
    reasons = (
        F.when(F.size(listed) > 0, listed)
        .when(F.size(invalid) > 0, invalid)
        .when(p.isNotNull(), single)
        .otherwise(none)
    )
    rows = rows.withColumn("reasons", F.when(explained, reasons).otherwise(none).cast(f"array<{REASON_TYPE}>"))
    n = F.size("reasons")
    count = F.concat(F.lit("("), n.cast("string"), F.lit(" blocking condition(s))."))
    summary = (
        F.when(F.col("decision") == "automatic", "Document met all criteria for automatic straight-through processing.")
        .when(F.col("decision") == "pending", "Document processing in progress; automation decision pending.")
        .when((n > 0) & p.isNotNull(), F.concat(F.lit("Manual review required due to "), _spaced(p), F.lit(" "), count))
        .when(n > 0, F.concat(F.lit("Manual review required "), count))
        .otherwise("Manual review required by operational policy.")
    )
    return rows.select(
        "document_id",
        "status",
        "decision",
        "primary_reason",
        "reasons",
        (F.col("decision") == "automatic").alias("automatic_eligible"),
        summary.alias("summary"),
    )


def resolution_status() -> Column:
    """Resolved, in review or open, from status and review times."""
    st = F.col("status")
    return (
        F.when(st.isin("completed_automatic", "completed_manual") | F.col("review_finished_at").isNotNull(), "resolved")
        .when((st == "manual_review") & F.col("review_started_at").isNotNull(), "in_review")
        .otherwise("open")
    )


def issue_category(code: Column) -> Column:
    c = reason_category(code)
    return F.when(c == "pipeline", "processing").when(c == "none", "manual_review").otherwise(c)


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


# Names of the degradations that quality signals correspond to, and the sentence that points to them.
RESEARCH_NAMES = {"D1": "Gaussian Blur Robustness", "D3": "Gaussian Noise Robustness", "D6": "Rotation & Skew Robustness"}
RESEARCH_SENTENCE = (
    "Research evidence available: %s (%s). B1 degradation curves and B2 preprocessing benchmarks are available for operator "
    "inspection.")


def derive_issues(docs: DataFrame, events: DataFrame, jobs: DataFrame, quality: DataFrame) -> DataFrame:
    """Issue rows per document: one for a pipeline failure, then one per decision reason, with what was observed against
    which threshold, and the production, historical and research evidence.

    Research evidence names the first matching quality signal; further ones are in ``evidence_rows``.
    """
    base = docs.withColumn("resolution", resolution_status())
    failed = (
        base.where("status = 'error'")
        .join(latest_job(jobs).select("document_id", "error_message"), "document_id", "left")
        .join(event_timestamp(docs, events, "processing_failed"), "document_id", "left")
    )
    code = F.coalesce(_named(F.col("review_reason")), F.lit("pipeline_failure"))
    missing = F.lit(None).cast("string")
    pipeline = failed.select(
        "document_id",
        F.concat_ws("-", F.lit("iss"), F.col("document_id").cast("string"), F.lit("proc")).alias("issue_id"),
        F.lit("processing").alias("category"),
        F.lit("critical").alias("severity"),
        code.alias("code"),
        missing.alias("field"),
        F.lit("Document Processing Pipeline Failure").alias("title"),
        F.lit("processing_pipeline").alias("source"),
        F.col("resolution").alias("issue_status"),
        F.coalesce("error_message", F.concat(F.lit("Processing failed with error code: "), code)).alias("production"),
        missing.alias("historical"),
        missing.alias("condition_code"),
        F.col("event_at").alias("created_at"),
        F.lit(False).alias("can_review"),
        F.lit(True).alias("can_retry"),
        F.coalesce(
            "error_message", F.concat(F.lit("Processing terminated due to pipeline failure ("), code, F.lit(")."))
        ).alias("description"),
        F.lit(None).cast("double").alias("observed_value"),
        F.lit(None).cast("double").alias("threshold"),
        missing.alias("research"),
    )
    explained = explain_decision(docs, events).select("document_id", F.posexplode("reasons").alias("position", "r"))
    reasons = explained.select(
        "document_id", "position", "r.code", "r.field", F.col("r.confidence").alias("observed"),
        F.col("r.threshold").alias("limit"), "r.message",
    )
    signal = evidence_rows(quality).where("position = 0").select("document_id", "condition_code")
    similar = similar_documents(docs, events).select(
        "document_id",
        F.col("review_reason").alias("code"),
        F.format_string(
            "%d similar manual review(s) recorded: %d contained correction(s), %d had no changes.",
            "total", "corrections", "no_corrections",
        ).alias("historical"),
    )
    rows = (
        reasons.join(base, "document_id")
        .join(event_timestamp(docs, events, "decision_evaluated"), "document_id", "left")
        .join(signal, "document_id", "left")
        .join(similar, ["document_id", "code"], "left")
    )
    cat = issue_category(F.col("code"))
    severity = (
        F.when(F.col("resolution") == "resolved", "info")
        .when(cat == "processing", "critical")
        .when(cat.isin("validation", "confidence"), "high")
        .otherwise("medium")
    )
    title = _lookup(TITLES, cat, "Operational Issue")
    measured = F.concat(
        F.lit("Observed value ("), F.col("observed").cast("string"), F.lit(") failed configured policy threshold ("),
        F.col("limit").cast("string"), F.lit(")."),
    )
    return pipeline.unionByName(
        rows.select(
            "document_id",
            F.concat_ws("-", F.lit("iss"), F.col("document_id").cast("string"), F.col("position").cast("string")).alias(
                "issue_id"
            ),
            cat.alias("category"),
            severity.alias("severity"),
            "code",
            "field",
            F.when(F.coalesce("field", F.lit("")) != "", F.concat(title, F.lit(": "), F.col("field")))
            .otherwise(title)
            .alias("title"),
            _lookup(SOURCES, cat, "decision_engine").alias("source"),
            F.col("resolution").alias("issue_status"),
            F.coalesce(measured, "message").alias("production"),
            "historical",
            F.when(cat == "quality", F.col("condition_code")).alias("condition_code"),
            F.col("event_at").alias("created_at"),
            (F.col("status") == "manual_review").alias("can_review"),
            F.col("status").isin("error", "manual_review").alias("can_retry"),
            F.col("message").alias("description"),
            F.col("observed").cast("double").alias("observed_value"),
            F.col("limit").cast("double").alias("threshold"),
            F.when((cat == "quality") & F.col("condition_code").isNotNull(), F.format_string(
                RESEARCH_SENTENCE, _lookup(RESEARCH_NAMES, F.col("condition_code"), ""), F.col("condition_code"))).alias("research"),
        )
    )


def issue_summary(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Per document: issue totals, unresolved blocking issues and the summary sentence."""
    counted = issues.groupBy("document_id").agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("severity").isin("critical", "high") & (F.col("issue_status") != "resolved")).alias(
            "blocking_issues"
        ),
    )
    out = docs.select("document_id", resolution_status().alias("overall_status")).join(
        counted, "document_id", "left"
    ).na.fill(0, ["total_issues", "blocking_issues"])
    total, blocking = F.col("total_issues"), F.col("blocking_issues")
    summary = (
        F.when(total == 0, "Zero operational issues detected. Document processed straight-through.")
        .when(
            F.col("overall_status") == "resolved",
            "Document processing completed and resolved. Operational review is satisfied.",
        )
        .when(
            blocking > 0,
            F.concat(
                blocking.cast("string"),
                F.lit(" blocking operational issue(s) require manual operator review and resolution."),
            ),
        )
        .otherwise(F.concat(total.cast("string"), F.lit(" non-blocking operational advisory issue(s) identified.")))
    )
    return out.withColumn("summary", summary)


def issue_actions(issues: DataFrame) -> DataFrame:
    """Actions offered for each issue in order: field, validation, quality, research, review, retry, document."""
    field, cat, cond = F.col("field"), F.col("category"), F.col("condition_code")

    def action(when: Column, ident: Column, kind: str, target: str) -> Column:
        return F.when(when, F.struct(ident.alias("action_id"), F.lit(kind).alias("type"), F.lit(target).alias("target")))

    retry = F.col("can_retry") & ((cat == "processing") | F.col("code").isin(*PIPELINE_CODES))
    actions = F.array_compact(
        F.array(
            action(F.coalesce(field, F.lit("")) != "", F.concat(F.lit("act-field-"), field), "open_field", "fields"),
            action(cat == "validation", F.lit("act-validation"), "open_validation", "fields"),
            action(cat == "quality", F.lit("act-quality"), "open_quality_evidence", "quality"),
            action(
                cond.isNotNull(), F.concat(F.lit("act-research-"), F.lower(cond)), "open_research_evidence", "research"
            ),
            action(
                F.col("can_review") & (F.col("issue_status") != "resolved"), F.lit("act-review"), "open_review", "review"
            ),
            action(retry, F.lit("act-retry"), "retry_processing", "pipeline"),
            action(F.lit(True), F.lit("act-document"), "open_document", "document"),
        )
    )
    return issues.select("document_id", "issue_id", F.posexplode(actions).alias("position", "a")).select(
        "document_id", "issue_id", "position", "a.*"
    )


def unique_actions(actions: DataFrame) -> DataFrame:
    """Each action once per document, from the first issue that offers it (the pipeline failure comes first)."""
    tail = F.element_at(F.split("issue_id", "-"), -1)
    rank = F.struct(F.when(tail == "proc", -1).otherwise(tail.try_cast("int")), F.col("position"))
    first = F.min_by(F.struct("issue_id", "type", "target"), rank)
    return actions.groupBy("document_id", "action_id").agg(first.alias("a")).select("document_id", "action_id", "a.*")
