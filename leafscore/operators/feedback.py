"""Correction feedback: funnel, breakdowns and improvement metrics, joined on pre-aggregated events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.functions.scalars import FINE_BUCKETS, bucket, safe_rate, signal_id
from leafscore.operators.layout import written
from leafscore.operators.ops import PROCESSED, bucket_frame, in_period, in_period_either, is_manual, metadata

# Least sample sizes and shares (percent) for a signal.
MIN_REVIEWED = 5
MIN_CORRECTIONS = 2
MIN_BUCKET_SHARE = 25.0
MIN_FIELD_SHARE = 20.0
MIN_REASON_RATE = 25.0
SIGNAL_VALIDATION_REASONS = ("validation_failed", "missing_required_field", "invalid_date", "invalid_number")


def corrections(events: DataFrame, start=None, end=None) -> DataFrame:
    """Correction events of the period counted per (document, field); a missing field is ``unknown``.

    Every breakdown starts from these counts, so a document with very many events meets a join as a few rows.
    """
    rows = events.where((F.col("action") == "field_corrected") & in_period(F.col("created_at"), start, end))
    field = F.coalesce(F.when(F.col("field_name") != "", F.col("field_name")), F.lit("unknown"))
    return rows.groupBy("document_id", field.alias("field")).agg(F.count("*").alias("n"))


def last_decision_reason(events: DataFrame) -> DataFrame:
    """Reason of the last decision event that names one, per document; ties go to the later event id."""
    reason = metadata()["reason"]
    rows = events.where("action = 'decision_evaluated'").select("document_id", "created_at", "event_id", reason.alias("r"))
    return (
        rows.where("r <> '' AND r <> 'none'")
        .groupBy("document_id")
        .agg(F.max_by("r", F.struct("created_at", "event_id")).alias("event_reason"))
    )


def resolve_reasons(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Documents plus ``reason``: last decision event, else the document's own, else ``manual_review``."""
    own = F.when((F.col("review_reason") != "") & (F.col("review_reason") != "none"), F.col("review_reason"))
    out = docs.join(last_decision_reason(events), "document_id", "left")
    return out.withColumn("reason", F.coalesce("event_reason", own, F.lit("manual_review"))).drop("event_reason")


def document_feedback(
    docs: DataFrame, events: DataFrame, start=None, end=None, reviewed_scope: bool = True, counted: DataFrame | None = None
) -> DataFrame:
    """One row per document that is in the map or has corrections, with its reason and correction counts.

    ``counted`` are the period's ``corrections`` if the caller has them.

    The map holds the in-period completed-manual documents (``reviewed_scope``) or all processed ones, plus every
    existing document the period's corrections refer to. Corrections of unknown documents stay, outside the map.
    """
    counted = corrections(events, start, end) if counted is None else counted
    counts = counted.groupBy("document_id").agg(F.sum("n").alias("events"))
    scope = F.col("status").isin(*PROCESSED) & in_period_either(start, end)
    if reviewed_scope:
        scope = scope & (F.col("status") == "completed_manual")
    base = docs.select(
        "document_id",
        "document_type",
        "status",
        "review_reason",
        F.lit(True).alias("_known"),
        F.coalesce(scope, F.lit(False)).alias("_scope"),
    )
    joined = base.join(counts, "document_id", "full")
    in_map = F.coalesce(F.col("_known") & (F.col("_scope") | F.col("events").isNotNull()), F.lit(False))
    rows = joined.withColumn("in_map", in_map).where(F.col("in_map") | F.col("events").isNotNull())
    resolved = resolve_reasons(rows, events)
    if not reviewed_scope:
        resolved = resolved.withColumn(
            "reason", F.when(F.col("in_map"), F.col("reason")).otherwise(F.lit("manual_review"))
        )
    kind = F.when(F.col("in_map"), F.coalesce("document_type", F.lit("unknown"))).otherwise(F.lit("unknown"))
    return resolved.select(
        "document_id",
        kind.alias("document_type"),
        "status",
        "reason",
        "in_map",
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def _counts(rows: DataFrame) -> DataFrame:
    done, hit = F.col("status") == "completed_manual", F.col("events") > 0
    return rows.agg(
        F.count_if("in_map").alias("_map"),
        F.count_if(F.col("in_map") & done).alias("_done"),
        F.count_if(F.col("in_map") & hit).alias("_in"),
        F.count_if(hit).alias("_all"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("_events"),
    )


def feedback_summary(docs: DataFrame, events: DataFrame, start=None, end=None) -> DataFrame:
    """One row: the review funnel and correction rates of the period."""
    proc = docs.where(F.col("status").isin(*PROCESSED) & in_period_either(start, end)).agg(
        F.count("*").alias("processed"),
        F.count_if((F.col("status") == "completed_automatic") | (F.coalesce("decision", F.lit("")) == "automatic")).alias(
            "automatic"
        ),
        F.count_if(is_manual()).alias("manual_review"),
    )
    row = proc.crossJoin(_counts(document_feedback(docs, events, start, end)))
    hits = F.when(F.col("_map") > 0, F.col("_in")).otherwise(F.col("_all"))
    reviewed = F.greatest(F.col("_done"), hits)
    out = row.withColumns({"with_corrections": hits, "completed_manual_review": reviewed, "total_correction_events": F.col("_events")})
    w, r, n = F.col("with_corrections"), F.col("completed_manual_review"), F.col("processed")
    return out.select(
        "processed",
        "automatic",
        "manual_review",
        "completed_manual_review",
        "with_corrections",
        (r - w).alias("without_corrections"),
        safe_rate(F.col("automatic"), n).alias("automatic_rate"),
        safe_rate(F.col("manual_review"), n).alias("manual_review_rate"),
        safe_rate(w, r).alias("correction_rate"),
        safe_rate(r - w, r).alias("no_change_review_rate"),
        "total_correction_events",
        F.when(w > 0, F.round(F.col("total_correction_events") / w, 2)).otherwise(0.0).alias("avg_corrections"),
    )


def by_field(events: DataFrame, start=None, end=None) -> DataFrame:
    """Correction events, affected documents and share per field."""
    return field_shares(corrections(events, start, end))


def field_shares(counted: DataFrame) -> DataFrame:
    """What ``by_field`` gives, from ``corrections``."""
    out = counted.groupBy("field").agg(F.sum("n").alias("correction_count"), F.count("*").alias("affected_documents"))
    whole = F.sum("correction_count").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("share", safe_rate(F.col("correction_count"), whole))


def correction_sketches(events: DataFrame, keys: list[str], lg: int = 12) -> DataFrame:
    """Per key: correction events, and a HyperLogLog state of the corrected documents in ``2 ** lg`` registers.

    States of different days or tables merge (``sketched_documents``), and a key is one state of fixed size, where the
    exact count needs a row per (document, key).
    """
    rows = events.where("action = 'field_corrected' AND document_id IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count("*").alias("correction_count"), F.hll_sketch_agg("document_id", F.lit(lg)).alias("documents"))


def sketched_documents(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """States merged over everything but ``keys``: exact events and about how many documents they concern.

    The relative error has a standard deviation of about ``1.04 / sqrt(2 ** lg)``: 1.6% with 4,096 registers.
    """
    return sketches.groupBy(*keys).agg(
        F.sum("correction_count").alias("correction_count"),
        F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("affected_documents"))


def breakdown(rows: DataFrame, key: str, completed_only: bool = False) -> DataFrame:
    """Reviewed and corrected documents, events and rate per reason or type; only keys with a reviewed document.

    ``completed_only`` counts as reviewed the completed-manual and the corrected documents of a wider map.
    """
    out = breakdowns(rows, [key], completed_only)
    return out.select(F.col("key").alias(key), *[c for c in out.columns if c not in ("dimension", "key")])


def breakdowns(rows: DataFrame, keys: list[str], completed_only: bool = False) -> DataFrame:
    """``breakdown`` by each of the keys in one pass: ``(dimension, key, …)``, one grouping set per key.

    The rows are read and expanded once, and combined before one exchange for all dimensions.
    """
    hit = F.col("events") > 0
    reviewed = F.col("in_map")
    if completed_only:
        reviewed = reviewed & ((F.col("status") == "completed_manual") | hit)
    sets = rows if len(keys) == 1 else None
    grouped = sets.groupBy(keys[0]) if sets is not None else rows.groupingSets([[F.col(k)] for k in keys], *keys)
    which = F.lit(keys[0]) if sets is not None else F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    key = F.col(keys[0]) if sets is not None else F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in keys])
    out = grouped.agg(
        which.alias("dimension"), key.alias("key"),
        F.count_if(reviewed).alias("reviewed_documents"),
        F.count_if(hit).alias("documents_with_corrections"),
        F.sum("events").alias("correction_events"),
    ).drop(*keys)
    return out.where("reviewed_documents > 0").withColumn(
        "correction_rate", safe_rate(F.col("documents_with_corrections"), F.col("reviewed_documents"))
    )


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Report order: most events, most reviewed, key."""
    return rows.orderBy(F.desc("correction_events"), F.desc("reviewed_documents"), key)


def reason_field(docs: DataFrame, events: DataFrame, start=None, end=None) -> DataFrame:
    """Correction events and distinct documents per (reason, field)."""
    reasons = document_feedback(docs, events, start, end).select("document_id", "reason")
    rows = corrections(events, start, end).join(reasons, "document_id")
    return rows.groupBy("reason", "field").agg(
        F.sum("n").alias("correction_count"), F.count("*").alias("affected_documents")
    )


# Improvement view -------------------------------------------------------------------------------------------


class Base(NamedTuple):
    """What the improvement reports share: documents with feedback, correction counts, evaluated fields.

    ``evaluated`` counts the fields with a confidence of the documents in the map, and the corrected ones among them,
    per field name and fine confidence bucket. A field is corrected when an event names it or its corrected value
    differs.
    """

    documents: DataFrame
    corrections: DataFrame
    evaluated: DataFrame | None


def improvement_base(docs: DataFrame, events: DataFrame, fields: DataFrame | None = None, start=None, end=None, keep: bool = False) -> Base:
    """The base of one period. With ``keep`` each part is written once, for reports that use several of them."""
    once = written if keep else lambda df, label: df
    counted = once(corrections(events, start, end), "corrections")
    rows = once(document_feedback(docs, events, start, end, reviewed_scope=False, counted=counted), "feedback")
    if fields is None:
        return Base(rows, counted, None)
    named = counted.where("field <> 'unknown'").select("document_id", F.col("field").alias("field_name"), F.lit(True).alias("_event"))
    met = (
        fields.where("confidence IS NOT NULL")
        .join(rows.where("in_map").select("document_id"), "document_id", "left_semi")
        .join(named, ["document_id", "field_name"], "left")
    )
    changed = F.coalesce("_event", F.lit(False)) | F.coalesce(
        F.col("corrected_value").isNotNull() & ~F.col("corrected_value").eqNullSafe(F.col("value")), F.lit(False)
    )
    evaluated = met.groupBy("field_name", bucket(F.col("confidence"), FINE_BUCKETS).alias("bucket")).agg(
        F.count("*").alias("evaluated_fields"), F.count_if(changed).alias("corrected_fields"))
    return Base(rows, counted, once(evaluated, "evaluated"))


def improvement_overview(docs: DataFrame, events: DataFrame, start=None, end=None) -> DataFrame:
    """One row: processed, reviewed and corrected documents with rates, over the back-filled map."""
    return overview_of(improvement_base(docs, events, None, start, end))


def overview_of(base: Base) -> DataFrame:
    row = _counts(base.documents)
    corrected, reviewed = F.col("_in"), F.greatest("_done", "_in")
    return row.select(
        F.col("_map").alias("documents_processed"),
        reviewed.alias("documents_reviewed"),
        corrected.alias("documents_corrected"),
        F.col("_events").alias("total_field_corrections"),
        safe_rate(corrected, reviewed).alias("correction_rate"),
        safe_rate(reviewed - corrected, reviewed).alias("no_change_review_rate"),
    )


def improvement_by_field(docs: DataFrame, events: DataFrame, fields: DataFrame, start=None, end=None) -> DataFrame:
    """Correction rate over evaluated fields and share of all corrections, per field."""
    return fields_of(improvement_base(docs, events, fields, start, end))


def fields_of(base: Base) -> DataFrame:
    evaluated = base.evaluated.groupBy(F.col("field_name").alias("field")).agg(F.sum("evaluated_fields").alias("_e"))
    out = field_shares(base.corrections).join(evaluated, "field", "left")
    count = F.greatest(F.coalesce("_e", F.lit(0)), F.col("correction_count"))
    return out.select(
        "field",
        "correction_count",
        count.alias("evaluated_count"),
        safe_rate(F.col("correction_count"), count).alias("correction_rate"),
        F.col("share").alias("share_of_all_corrections"),
        "affected_documents",
    )


def improvement_by_confidence(docs: DataFrame, events: DataFrame, fields: DataFrame, start=None, end=None) -> DataFrame:
    """Evaluated and corrected fields per fine confidence bucket; all buckets present.

    Shares are of the corrected fields in buckets, or of the events when no bucket holds one.
    """
    return buckets_of(improvement_base(docs, events, fields, start, end))


def buckets_of(base: Base) -> DataFrame:
    counted = base.evaluated.groupBy("bucket").agg(
        F.sum("evaluated_fields").alias("evaluated_fields"), F.sum("corrected_fields").alias("corrected_fields"))
    total = base.corrections.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"))
    out = bucket_frame(base.evaluated, FINE_BUCKETS).join(counted, "bucket", "left").na.fill(0).crossJoin(total)
    inside = F.sum("corrected_fields").over(Window.partitionBy(F.lit(0)))
    return out.select(
        "bucket",
        "evaluated_fields",
        "corrected_fields",
        safe_rate(F.col("corrected_fields"), F.col("evaluated_fields")).alias("correction_rate"),
        safe_rate(F.col("corrected_fields"), F.when(inside > 0, inside).otherwise(F.col("_n"))).alias("share_of_corrections"),
    )


# Signals ----------------------------------------------------------------------------------------------------


def _signal(kind: str, rows: DataFrame, key: Column, field: Column, count: str, share: Column, period: str) -> DataFrame:
    name = F.lit(kind)
    return rows.select(
        signal_id(name, key, F.lit(None).cast("string"), period).alias("id"),
        name.alias("signal_type"),
        key.alias("subject"),
        field.alias("field"),
        F.col(count).alias("corrections"),
        share.alias("share"),
    )


def signal_concentration(fields: DataFrame, period: str = "all") -> DataFrame:
    """Fields holding at least a fifth of all corrections."""
    rows = fields.where((F.col("share_of_all_corrections") >= MIN_FIELD_SHARE) & (F.col("correction_count") >= MIN_CORRECTIONS))
    return _signal(
        "CORRECTION_CONCENTRATION", rows, F.col("field"), F.col("field"), "correction_count",
        F.col("share_of_all_corrections"), period,
    )


def signal_confidence(buckets: DataFrame, period: str = "all") -> DataFrame:
    """Confidence buckets holding at least a quarter of the corrected fields."""
    rows = buckets.where((F.col("share_of_corrections") >= MIN_BUCKET_SHARE) & (F.col("corrected_fields") >= MIN_CORRECTIONS))
    return _signal(
        "CONFIDENCE_CORRECTION_PATTERN", rows, F.col("bucket"), F.lit(None).cast("string"), "corrected_fields",
        F.col("share_of_corrections"), period,
    )


def signal_reason(reasons: DataFrame, period: str = "all") -> DataFrame:
    """Review reasons whose documents are corrected in at least a quarter of cases."""
    rows = reasons.where((F.col("correction_events") >= MIN_CORRECTIONS) & (F.col("correction_rate") >= MIN_REASON_RATE))
    return _signal(
        "REVIEW_REASON_CORRECTION_PATTERN", rows, F.col("reason"), F.lit(None).cast("string"), "correction_events",
        F.col("correction_rate"), period,
    )


def signal_quality(reasons: DataFrame, period: str = "all") -> DataFrame:
    """Corrections on documents routed for low image quality."""
    rows = reasons.where((F.col("reason") == "low_image_quality") & (F.col("correction_events") >= MIN_CORRECTIONS))
    return _signal(
        "QUALITY_CORRECTION_PATTERN", rows, F.lit("image_quality"), F.lit(None).cast("string"), "correction_events",
        F.col("correction_rate"), period,
    )


def signal_validation(reasons: DataFrame, fields: DataFrame, period: str = "all") -> DataFrame:
    """Repeatedly corrected fields, provided some validation reason saw at least two correction events."""
    trigger = reasons.where(
        F.col("reason").isin(*SIGNAL_VALIDATION_REASONS) & (F.col("correction_events") >= MIN_CORRECTIONS)
    ).agg(F.count("*").alias("_t"))
    rows = fields.where(F.col("correction_count") >= MIN_CORRECTIONS).crossJoin(F.broadcast(trigger)).where("_t > 0")
    return _signal(
        "FIELD_VALIDATION_PATTERN", rows, F.col("field"), F.col("field"), "correction_count",
        F.lit(None).cast("double"), period,
    )


def signals(docs: DataFrame, events: DataFrame, fields: DataFrame, start=None, end=None, period: str = "all") -> DataFrame:
    """All signal kinds; nothing when fewer than five documents were reviewed or two corrections made.

    The tables are read for the shared base only, which is written; the reports come from it.
    """
    base = improvement_base(docs, events, fields, start, end, keep=True)
    per_field, per_bucket = fields_of(base), buckets_of(base)
    per_reason = breakdown(base.documents, "reason", completed_only=True)
    out = (
        signal_concentration(per_field, period)
        .unionByName(signal_confidence(per_bucket, period))
        .unionByName(signal_reason(per_reason, period))
        .unionByName(signal_quality(per_reason, period))
        .unionByName(signal_validation(per_reason, per_field, period))
    )
    enough = overview_of(base).where(
        (F.col("documents_reviewed") >= MIN_REVIEWED) & (F.col("total_field_corrections") >= MIN_CORRECTIONS)
    ).select(F.lit(True).alias("_ok"))
    return out.crossJoin(F.broadcast(enough)).drop("_ok")
