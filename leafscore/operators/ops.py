"""Operations analytics over documents, audit events, fields, pages, quality measures and jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.functions.scalars import COARSE_BUCKETS, bucket, reason_category, safe_rate
from leafscore.functions.text import humanize

PROCESSED = ("completed_automatic", "completed_manual", "manual_review", "error")
MANUAL_STATUS = ("manual_review", "completed_manual")
# Reasons that count as a validation failure.
VALIDATION_REASONS = (
    "validation_failed",
    "missing_required_field",
    "invalid_date",
    "invalid_number",
    "empty_value",
    "document_integrity",
)
# Days before today's midnight at which each preset starts.
PRESET_DAYS = {"today": 0, "7d": 6, "30d": 29, "90d": 89}

DETAILS = (
    "struct<reasons: array<string>, validation_errors: array<string>, "
    "fields: map<string, struct<confidence: double, threshold: double, reason: string>>>"
)
METADATA = f"decision string, reason string, explanation string, review_details {DETAILS}"


def period_bounds(
    period: str | None, now: datetime, date_from: datetime | None = None, date_to: datetime | None = None
) -> tuple[datetime | None, datetime | None]:
    """Resolve a preset or explicit bounds; explicit ones win, unknown presets are unbounded."""
    if date_from or date_to:
        return date_from, date_to
    days = PRESET_DAYS.get((period or "all").strip().lower())
    if days is None:
        return None, None
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight - timedelta(days=days), now


def instant(value: datetime | str) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def in_period(ts: Column, start=None, end=None) -> Column:
    """Inclusive bounds on one column; the filter reaches the scan."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= instant(start))
    if end is not None:
        keep = keep & (ts <= instant(end))
    return keep


def in_period_either(start=None, end=None) -> Column:
    """Each bound may be met by the finish time or by the creation time, independently."""
    done, made = F.col("processing_finished_at"), F.col("created_at")
    keep = F.lit(True)
    if start is not None:
        keep = keep & ((done >= instant(start)) | (made >= instant(start)))
    if end is not None:
        keep = keep & ((done <= instant(end)) | (made <= instant(end)))
    return keep


def is_manual() -> Column:
    """Waiting for or finished manual review, or so decided."""
    return F.coalesce(F.col("status").isin(*MANUAL_STATUS) | (F.col("decision") == "manual_review"), F.lit(False))


def metadata(column: str = "metadata_json") -> Column:
    """Event metadata as a struct; it may be an object or a JSON string holding one, bad JSON is null."""
    raw = F.col(column)
    text = F.when(raw.startswith('"'), F.get_json_object(raw, "$")).otherwise(raw)
    return F.from_json(text, METADATA)


def list_documents(
    docs: DataFrame, status=None, decision=None, document_type=None, search=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of matching documents, newest first, with the total before paging."""
    rows = docs
    for name, value in (("status", status), ("decision", decision), ("document_type", document_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if search:
        rows = rows.where(F.contains(F.lower("filename"), F.lit(search.lower())))
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("created_at"), F.desc("document_id")).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def recent_documents(docs: DataFrame, k: int = 10) -> DataFrame:
    """The most recently updated documents."""
    return docs.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("document_id")).limit(k)


def next_jobs(jobs: DataFrame, k: int = 1) -> DataFrame:
    """Jobs to run next: highest priority, then oldest."""
    ready = jobs.where(F.col("status").isin("pending", "retrying"))
    return ready.orderBy(F.desc("priority"), "created_at", "job_id").limit(k)


def overview(docs: DataFrame, events: DataFrame, fields: DataFrame, jobs: DataFrame, start=None, end=None) -> DataFrame:
    """One row of counts, rates, averages and queue depth; each table is aggregated in a single pass.

    Corrections fall back to the all-time count of corrected fields when the period holds no correction event.
    """
    made, done = in_period(F.col("created_at"), start, end), in_period(F.col("processing_finished_at"), start, end)
    reviewed = in_period(F.col("review_finished_at"), start, end)
    st = F.col("status")
    scored = done & F.col("confidence").isNotNull()
    facts = docs.agg(
        F.count_if(made).alias("total_documents"),
        *[F.count_if(done & (st == s)).alias(s) for s in PROCESSED],
        F.avg(F.when(scored, F.col("confidence"))).alias("_conf"),
        F.avg(F.when(scored, F.col("processing_duration_ms"))).alias("_proc"),
        F.avg(F.when(reviewed, F.col("review_duration_ms"))).alias("_rev"),
    )
    corrected = events.where((F.col("action") == "field_corrected") & in_period(F.col("created_at"), start, end)).agg(
        F.count("*").alias("_events")
    )
    ever = fields.agg(F.count("corrected_value").alias("_fields"))
    queue = jobs.agg(F.count_if(F.col("status").isin("pending", "running", "retrying")).alias("queue_pending_count"))
    processed = sum((F.col(s) for s in PROCESSED[1:]), F.col(PROCESSED[0]))
    row = facts.crossJoin(corrected).crossJoin(ever).crossJoin(queue)
    return row.select(
        "total_documents",
        processed.alias("processed_count"),
        F.col("completed_automatic").alias("automatic_count"),
        F.col("manual_review").alias("manual_review_count"),
        F.col("completed_manual").alias("completed_manual_count"),
        F.col("error").alias("error_count"),
        safe_rate(F.col("completed_automatic"), processed).alias("automation_rate"),
        safe_rate(F.col("manual_review") + F.col("completed_manual"), processed).alias("manual_review_rate"),
        safe_rate(F.col("error"), processed).alias("failure_rate"),
        F.when(F.col("_events") > 0, F.col("_events")).otherwise(F.col("_fields")).alias("corrections_total"),
        F.when(F.col("_events") > 0, "events").otherwise("fields").alias("corrections_source"),
        F.round(F.coalesce("_conf", F.lit(0.0)) * 100.0, 1).alias("average_confidence"),
        F.round(F.coalesce("_proc", F.lit(0.0)), 1).alias("average_processing_time_ms"),
        F.round(F.coalesce("_rev", F.lit(0.0)), 1).alias("average_review_time_ms"),
        "queue_pending_count",
    )


def with_share(counted: DataFrame, name: str = "percentage", by: list[str] | None = None) -> DataFrame:
    """Add each row's share of the summed counts. The input is an aggregate of few rows."""
    whole = F.sum("count").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counted.withColumn(name, safe_rate(F.col("count"), whole))


def review_reasons(docs: DataFrame, start=None, end=None) -> DataFrame:
    """Documents per review reason other than none, with shares; null reasons are left out."""
    rows = docs.where((F.col("review_reason") != "none") & in_period(F.col("created_at"), start, end))
    return with_share(rows.groupBy("review_reason").agg(F.count("*").alias("count")))


def type_distribution(docs: DataFrame, start=None, end=None) -> DataFrame:
    """Created documents per type with shares."""
    rows = docs.where(in_period(F.col("created_at"), start, end))
    return with_share(rows.groupBy("document_type").agg(F.count("*").alias("count")))


def status_distribution(docs: DataFrame, start=None, end=None) -> DataFrame:
    """Processed documents per terminal status with shares."""
    rows = docs.where(F.col("status").isin(*PROCESSED) & in_period(F.col("processing_finished_at"), start, end))
    return with_share(rows.groupBy("status").agg(F.count("*").alias("count")))


def document_types(docs: DataFrame, start=None, end=None) -> DataFrame:
    """Volume, rates and averages for every type that exists, also with nothing in the period."""
    done = F.col("processing_finished_at").isNotNull() & in_period(F.col("processing_finished_at"), start, end)
    st = F.col("status")
    mean = lambda c: F.avg(F.when(done, F.col(c)))
    counted = docs.groupBy("document_type").agg(
        F.count_if(in_period(F.col("created_at"), start, end)).alias("total_documents"),
        F.count_if(done).alias("processed_documents"),
        F.count_if(done & (st == "completed_automatic")).alias("automatic_count"),
        F.count_if(done & is_manual()).alias("manual_review_count"),
        F.count_if(done & (st == "error")).alias("error_count"),
        F.round(F.coalesce(mean("confidence"), F.lit(0.0)) * 100.0, 1).alias("average_confidence"),
        F.round(F.coalesce(mean("processing_duration_ms"), F.lit(0.0)), 1).alias("average_processing_time_ms"),
        F.round(F.coalesce(mean("review_duration_ms"), F.lit(0.0)), 1).alias("average_review_time_ms"),
    )
    n = F.col("processed_documents")
    return counted.withColumns(
        {
            "automation_rate": safe_rate(F.col("automatic_count"), n),
            "manual_review_rate": safe_rate(F.col("manual_review_count"), n),
            "failure_rate": safe_rate(F.col("error_count"), n),
        }
    )


def trends(docs: DataFrame, start: datetime | None, end: datetime | None, now: datetime) -> DataFrame:
    """One row per calendar day, zero filled. The rate is a fraction with three decimals.

    Without a start the range is the six days before the end at the same time of day, so its first day is partial.
    """
    end = end or now
    start = start or end - timedelta(days=6)
    made, done = F.col("created_at"), F.col("processing_finished_at")
    st = F.col("status")
    marks = docs.select(
        F.explode(
            F.array(
                F.struct(made.alias("ts"), F.lit(True).alias("made"), st.alias("status")),
                F.struct(done.alias("ts"), F.lit(False).alias("made"), st.alias("status")),
            )
        ).alias("m")
    ).select("m.*")
    daily = (
        marks.where(in_period(F.col("ts"), start, end))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count_if("made").alias("total_documents"),
            F.count_if(~F.col("made")).alias("processed_count"),
            F.count_if(~F.col("made") & (st == "completed_automatic")).alias("automatic_count"),
            F.count_if(~F.col("made") & st.isin(*MANUAL_STATUS)).alias("manual_review_count"),
            F.count_if(~F.col("made") & (st == "error")).alias("error_count"),
        )
    )
    bounds = F.sequence(F.to_date(instant(start)), F.to_date(instant(end)), F.expr("interval 1 day"))
    days = docs.sparkSession.range(1).select(F.explode(bounds).alias("day"))
    names = [c for c in daily.columns if c != "day"]
    out = days.join(daily, "day", "left").na.fill(0, names)
    rate = F.when(
        F.col("processed_count") > 0, F.round(F.col("automatic_count") / F.col("processed_count"), 3)
    ).otherwise(0.0)
    return out.withColumns({"automation_rate": rate, "day": F.date_format("day", "yyyy-MM-dd")})


def queue(docs: DataFrame) -> DataFrame:
    """Documents waiting, in processing and in error now."""
    st = F.col("status")
    return docs.agg(
        F.count_if(st == "manual_review").alias("manual_review"),
        F.count_if(st == "processing").alias("processing"),
        F.count_if(st == "error").alias("errors"),
    )


def field_corrections(fields: DataFrame, docs: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Occurrences and corrections per field. All-time unless ``docs`` and bounds ask for a period."""
    if docs is not None:
        keep = docs.where(in_period(F.col("created_at"), start, end)).select("document_id")
        fields = fields.join(keep, "document_id", "left_semi")
    return (
        fields.groupBy("field_name")
        .agg(F.count("*").alias("total_occurrences"), F.count("corrected_value").alias("corrected_count"))
        .withColumn("correction_rate", safe_rate(F.col("corrected_count"), F.col("total_occurrences")))
    )


def bucket_frame(frame: DataFrame, edges: list[tuple[str, float, float]]) -> DataFrame:
    """The bucket labels as a small frame, so empty buckets appear."""
    labels = F.array(*[F.lit(name) for name, _, _ in edges])
    return frame.sparkSession.range(1).select(F.explode(labels).alias("bucket"))


def confidence_distribution(docs: DataFrame, fields: DataFrame, start=None, end=None) -> DataFrame:
    """Documents, manual reviews and corrected documents per coarse confidence bucket; all buckets present."""
    corrected = fields.where("corrected_value IS NOT NULL").groupBy("document_id").agg(F.lit(True).alias("has"))
    rows = docs.where(F.col("confidence").isNotNull() & in_period(F.col("created_at"), start, end)).join(
        corrected, "document_id", "left"
    )
    counted = rows.groupBy(bucket(F.col("confidence"), COARSE_BUCKETS).alias("bucket")).agg(
        F.count("*").alias("total_count"),
        F.count_if(is_manual()).alias("manual_review_count"),
        F.count_if("has").alias("corrected_count"),
    )
    out = bucket_frame(docs, COARSE_BUCKETS).join(counted, "bucket", "left").na.fill(0)
    return out.withColumn("review_rate", safe_rate(F.col("manual_review_count"), F.col("total_count")))


def decision_reasons(events: DataFrame, start=None, end=None) -> DataFrame:
    """(dimension, key, count, share) over reason codes, categories and fields of decision events.

    Structured reasons count one by one; events without them fall back to their single reason.
    """
    rows = events.where(
        (F.col("action") == "decision_evaluated") & in_period(F.col("created_at"), start, end)
    ).select(metadata().alias("m"))
    manual = rows.where(F.lower(F.coalesce("m.decision", F.lit(""))) != "automatic")
    listed = F.size(F.coalesce("m.review_details.reasons", F.array().cast("array<string>"))) > 0
    shape = "code string, field string"
    fallback = F.coalesce(F.when(F.col("m.reason") != "", F.col("m.reason")), F.lit("unknown"))
    structured = (
        manual.where(listed)
        .select(fallback.alias("fallback"), F.explode("m.review_details.reasons").alias("r"))
        .where(F.col("r").startswith("{"))
        .select("fallback", F.from_json("r", shape).alias("r"))
        .select(
            F.coalesce(F.when(F.col("r.code") != "", F.col("r.code")), F.col("fallback")).alias("code"),
            F.when(F.col("r.field") != "", F.col("r.field")).alias("field"),
        )
    )
    legacy = manual.where(~listed & (F.col("m.reason") != "") & (F.col("m.reason") != "none")).select(
        F.col("m.reason").alias("code"), F.lit(None).cast("string").alias("field")
    )
    keys = F.array(
        F.struct(F.lit("reason").alias("dimension"), F.col("code").alias("key")),
        F.struct(F.lit("category").alias("dimension"), reason_category(F.col("code")).alias("key")),
        F.struct(F.lit("field").alias("dimension"), F.col("field").alias("key")),
    )
    long = structured.unionByName(legacy).select(F.explode(keys).alias("k")).select("k.*").where("key IS NOT NULL")
    counted = long.groupBy("dimension", "key").agg(F.count("*").alias("count"))
    return with_share(counted, by=["dimension"]).withColumn(
        "description", F.when(F.col("dimension") == "reason", humanize(F.col("key")))
    )


def decision_totals(events: DataFrame, start=None, end=None) -> DataFrame:
    """Automatic and manual decision events with rates."""
    rows = events.where(
        (F.col("action") == "decision_evaluated") & in_period(F.col("created_at"), start, end)
    ).select((F.lower(F.coalesce(metadata()["decision"], F.lit(""))) == "automatic").alias("auto"))
    out = rows.agg(F.count("*").alias("total_decisions"), F.count_if("auto").alias("automatic_count"))
    n, a = F.col("total_decisions"), F.col("automatic_count")
    return out.withColumns(
        {
            "manual_review_count": n - a,
            "automation_rate": safe_rate(a, n),
            "manual_review_rate": safe_rate(n - a, n),
        }
    )


def quality_summary(
    docs: DataFrame, quality: DataFrame, fields: DataFrame, tokens: DataFrame, start=None, end=None
) -> DataFrame:
    """Average quality, document, field and token confidence and the validation pass rate, four decimals.

    Token confidences that are not numbers are ignored; averages are null when no row qualifies.
    """
    scope = docs.where(in_period_either(start, end))
    ids = scope.select("document_id")
    q = quality.join(ids, "document_id").agg(F.round(F.avg("quality_score"), 4).alias("average_quality_score"))
    f = fields.join(ids, "document_id").agg(F.round(F.avg("confidence"), 4).alias("average_kie_confidence"))
    t = tokens.join(ids, "document_id").agg(
        F.round(F.avg(F.col("confidence").try_cast("double")), 4).alias("average_ocr_confidence")
    )
    decided = F.col("decision").isNotNull()
    failed = decided & (F.col("decision") == "manual_review") & F.coalesce(
        F.col("review_reason").isin(*VALIDATION_REASONS), F.lit(False)
    )
    if "review_details_json" in docs.columns:
        errors = F.from_json("review_details_json", "validation_errors array<string>")["validation_errors"]
        failed = failed | (
            decided & (F.col("decision") == "manual_review") & (F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0)
        )
    d = scope.agg(
        F.round(F.avg("confidence"), 4).alias("average_document_confidence"),
        F.count_if(decided).alias("total_documents_validated"),
        F.count_if(failed).alias("failed_validation_count"),
    )
    n, bad = F.col("total_documents_validated"), F.col("failed_validation_count")
    return (
        q.crossJoin(f)
        .crossJoin(t)
        .crossJoin(d)
        .withColumns(
            {
                "passed_validation_count": n - bad,
                "validation_pass_rate": F.when(n > 0, F.round((n - bad) / n, 4)),
            }
        )
    )


def backlog(docs: DataFrame) -> DataFrame:
    """(section, key, count): open, in review, and waiting documents by reason and by category."""
    waiting = docs.where("status = 'manual_review'")
    reason = F.col("review_reason")
    opened = F.col("review_started_at").isNull()
    busy = ~opened & F.col("review_finished_at").isNull()
    named = reason != "none"
    totals = waiting.agg(F.count_if(opened).alias("open"), F.count_if(busy).alias("in_review")).select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("section"), F.lit("open").alias("key"), F.col("open").alias("count")),
                F.struct(F.lit("total").alias("section"), F.lit("in_review").alias("key"), F.col("in_review").alias("count")),
            )
        ).alias("r")
    ).select("r.*")
    by_reason = waiting.where(named).groupBy(reason.alias("key")).agg(F.count("*").alias("count"))
    by_category = by_reason.groupBy(reason_category(F.col("key")).alias("key")).agg(F.sum("count").alias("count"))
    return totals.unionByName(by_reason.select(F.lit("reason").alias("section"), "key", "count")).unionByName(
        by_category.select(F.lit("category").alias("section"), "key", "count")
    )


def similar_documents(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Per document: other documents of the same review reason, with and without correction events.

    Counted once per reason and the document itself taken off, so no pair of documents is ever formed.
    """
    corrected = (
        events.where("action = 'field_corrected'").groupBy("document_id").agg(F.lit(1).alias("corrected"))
    )
    rows = (
        docs.where("review_reason IS NOT NULL AND review_reason <> '' AND review_reason <> 'none'")
        .join(corrected, "document_id", "left")
        .select("document_id", "review_reason", F.coalesce("corrected", F.lit(0)).alias("corrected"))
    )
    totals = rows.groupBy("review_reason").agg(F.count("*").alias("_n"), F.sum("corrected").alias("_c"))
    total, with_c = F.col("_n") - 1, F.col("_c") - F.col("corrected")
    return (
        rows.join(totals, "review_reason")
        .where(total > 0)
        .select(
            "document_id",
            "review_reason",
            total.alias("total"),
            with_c.alias("corrections"),
            (total - with_c).alias("no_corrections"),
        )
    )


def historical_similar(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Per review reason: documents, and how many of them carry a correction event."""
    corrected = events.where("action = 'field_corrected'").select("document_id").distinct()
    flagged = corrected.withColumn("has", F.lit(True))
    rows = docs.where("review_reason <> 'none'").join(flagged, "document_id", "left")
    return (
        rows.groupBy("review_reason")
        .agg(F.count("*").alias("total"), F.count_if("has").alias("corrections"))
        .withColumn("no_corrections", F.col("total") - F.col("corrections"))
    )


def document_sections(docs: DataFrame, children: dict[str, tuple[DataFrame, str]], document_id=None) -> DataFrame:
    """A document with its children as (document_id, section, position, content JSON) rows.

    ``children``: section -> (frame, ordering column). Kept as rows so that one document with very many child rows
    is never gathered into a single cell; ``document_id`` narrows every scan to one document.
    """
    pick = (lambda df: df) if document_id is None else (lambda df: df.where(F.col("document_id") == document_id))
    head = pick(docs)
    out = head.select(
        "document_id",
        F.lit("document").alias("section"),
        F.lit("").alias("position"),
        F.to_json(F.struct(*[c for c in docs.columns if c != "document_id"])).alias("content"),
    )
    keys = head.select("document_id")
    for section, (frame, order) in children.items():
        rows = pick(frame).join(keys, "document_id", "left_semi").select(
            "document_id",
            F.lit(section).alias("section"),
            F.col(order).cast("string").alias("position"),
            F.to_json(F.struct(*[c for c in frame.columns if c != "document_id"])).alias("content"),
        )
        out = out.unionByName(rows)
    return out


def control_center(*parts: DataFrame) -> DataFrame:
    """One row joining one-row summaries (overview, queue, funnel, quality, decision totals)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out
