"""Windowed streaming aggregates over the audit log, each with a batch twin that uses the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.functions.scalars import safe_rate


def read_audit_stream(events):
    """Audit events from a streaming read of the raw event table (same mapping as the batch view)."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "field_corrected")
        .when(kind == "view", "decision_evaluated")
        .when(kind == "purchase", "review_completed")
        .when(kind == "signup", "document_uploaded")
        .otherwise("processing_failed")
    )
    n = F.col("event_id") % 7
    field = F.when((kind != "click") | (F.col("event_id") % 17 == 0), F.lit(None)).otherwise(
        F.when(n.isin(0, 1, 2), "total").when(n.isin(3, 4), "company").when(n == 5, "date").otherwise("address")
    )
    return events.select(
        "event_id",
        (F.col("event_id") % 3000).alias("document_id"),
        action.alias("action"),
        field.alias("field_name"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def daily_kpis(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Events per day and action; with a ``delay`` late events within it still count."""
    rows = events.withWatermark("created_at", delay) if delay else events
    out = rows.groupBy(F.window("created_at", "1 day"), "action").agg(F.count("*").alias("events"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "action", "events")


def dedup(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event id once; state is kept only for the delay."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def correction_rate(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Share of correction events per field over seven-day windows sliding by a day.

    The share is over all correction events of the window, so both counts come from one aggregate per window with a
    small map of field counts.
    """
    rows = events.where("action = 'field_corrected'")
    rows = rows.withWatermark("created_at", delay) if delay else rows
    names = ["total", "company", "date", "address"]
    out = rows.groupBy(F.window("created_at", "7 days", "1 day")).agg(
        F.count("*").alias("corrections"), *[F.count_if(F.col("field_name") == n).alias(n) for n in names]
    )
    return out.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "corrections",
        *[safe_rate(F.col(n), F.col("corrections")).alias(f"{n}_share") for n in names],
    )


def review_sessions(events: DataFrame, delay: str | None = None, gap: str = "6 hours") -> DataFrame:
    """Per document: bursts of review activity separated by more than the gap."""
    rows = events.where(F.col("action").isin("field_corrected", "review_completed"))
    rows = rows.withWatermark("created_at", delay) if delay else rows
    out = rows.groupBy("document_id", F.session_window("created_at", gap)).agg(F.count("*").alias("events"))
    return out.select(
        "document_id",
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        "events",
    )
