"""Streaming queries over the event table, their batch twins, and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.functions.scalars import mean4
from leafscore.operators import matrix as M
from leafscore.operators import stats as X
from leafscore.plans.registry import query
from leafscore.plans.scoring_queries import mean_sql
from leafscore.session import shared_dir
from leafscore.sources import runs
from leafscore.streaming import kpis as K
from leafscore.streaming import lifecycle as L
from leafscore.streaming.run import Arrivals, run_available

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CLOSING = -1


def _stream(t):
    files = t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return K.read_audit_stream(files)


def _replayed(t, build, label, **options):
    """The stream that ``build(events, delay)`` makes of the event table, which arrives in seven parts and a closing one.

    One event in thirteen arrives a part late, about every part is a micro-batch, and the query is stopped after three parts
    and resumed from its checkpoint. All rows come from the stream: the closing event, a correction of a document of
    its own, lets the watermark pass everything before it and is itself in no result.
    """
    base = shared_dir(t.spark, label)
    feed = Arrivals(t.events.select(*[c.split()[0] for c in EVENTS.split(", ")]), f"{base}/input", "ts", F.col("event_id") % 13 == 0)

    def run():
        files = t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", feed.files).parquet(feed.folder)
        return run_available(build(K.read_audit_stream(files), feed.delay), label, location=f"{base}/sink", **options)

    for part in range(3):
        feed.send(part)
    run()
    for part in range(3, feed.parts + 1):
        feed.send(part)
    feed.close(event_id=F.lit(CLOSING), event_type=F.lit("click"))
    return run()


def _batch(t):
    return K.read_audit_stream(t.events)


def _naive(df):
    return df.select(*[F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(c) if k == "timestamp" else F.col(c)
                       for c, k in df.dtypes])


DAILY = """SELECT date_trunc('day', created_at) AS window_start, date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end, action, count(*) AS events
  FROM {audit_events} GROUP BY 1, 2, 3"""


@query("stream_daily_kpis", DAILY)
def _(t):
    return _naive(_replayed(t, K.daily_kpis, "daily"))


@query("batch_daily_kpis", DAILY)
def _(t):
    return _naive(K.daily_kpis(_batch(t)))


@query("stream_dedup", "SELECT event_id, document_id, action FROM {audit_events}")
def _(t):
    """At-least-once delivery: the table is streamed twice over."""
    twice = _stream(t).unionByName(_stream(t))
    return run_available(K.dedup(twice, "1 day"), "dedup").select("event_id", "document_id", "action")


def share(n: str) -> str:
    return f"round(count(*) FILTER (field_name = '{n}') / count(*)::DOUBLE * 100, 1) AS {n}_share"


SLIDING = f"""WITH c AS (SELECT created_at, field_name, date_trunc('day', created_at) AS d FROM {{audit_events}} WHERE action = 'field_corrected'),
  w AS (SELECT d - k * INTERVAL 1 DAY AS window_start, d - k * INTERVAL 1 DAY + INTERVAL 7 DAY AS window_end, field_name FROM c CROSS JOIN (SELECT unnest(range(7)) AS k))
  SELECT window_start, window_end, count(*) AS corrections, {share('total')}, {share('company')}, {share('date')}, {share('address')} FROM w"""


@query("stream_correction_rate", f"{SLIDING} GROUP BY 1, 2")
def _(t):
    return _naive(_replayed(t, K.correction_rate, "rate"))


@query("batch_correction_rate", f"{SLIDING} GROUP BY 1, 2")
def _(t):
    return _naive(K.correction_rate(_batch(t)))


SESSIONS = """(WITH r AS (SELECT document_id, created_at, event_id FROM {audit_events} WHERE action IN ('field_corrected', 'review_completed')),
  g AS (SELECT *, (created_at - lag(created_at) OVER w >= INTERVAL 6 HOUR)::INT AS cut FROM r WINDOW w AS (PARTITION BY document_id ORDER BY created_at, event_id)),
  s AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY document_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT document_id, min(created_at) AS session_start, max(created_at) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s GROUP BY document_id, sid)"""


@query("stream_review_sessions", f"SELECT * FROM {SESSIONS}")
def _(t):
    return _naive(_replayed(t, K.review_sessions, "sessions"))


@query("batch_review_sessions", f"SELECT * FROM {SESSIONS}")
def _(t):
    return _naive(K.review_sessions(_batch(t)))


LIFE = """WITH a AS (SELECT *, coalesce(max((action = 'review_completed')::INT) OVER (PARTITION BY document_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM {audit_events}),
  b AS (SELECT *, sum((NOT late AND action = 'processing_failed')::INT) OVER w AS retries, sum((NOT late AND action = 'field_corrected')::INT) OVER w AS corrections, min(created_at) OVER w AS opened FROM a
    WINDOW w AS (PARTITION BY document_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, CASE WHEN late THEN NULL WHEN action = 'processing_failed' THEN CASE WHEN retries >= 3 THEN 4 ELSE 0 END WHEN action = 'document_uploaded' THEN 1
    WHEN action = 'decision_evaluated' THEN 2 WHEN action = 'field_corrected' THEN 3 ELSE 5 END AS place FROM b)
  SELECT document_id, event_id, action, ['', 'uploaded', 'decided', 'corrected', 'failed', 'completed'][coalesce(max(place) OVER (PARTITION BY document_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING), 0) + 1] AS state,
    retries::INT AS retries, corrections::INT AS corrections, CASE WHEN NOT late AND action = 'review_completed' THEN date_diff('microsecond', opened, created_at) / 1000.0E0 END AS wait_ms, late FROM c"""


@query("stream_lifecycle", LIFE)
def _(t):
    return _replayed(t, L.lifecycle, "lifecycle", rocksdb=True).withColumn("wait_ms", F.round("wait_ms", 3))


@query("batch_lifecycle", LIFE)
def _(t):
    return L.lifecycle_batch(_batch(t))


# File round trips: written from the tables to the shared folder and read back with explicit schemas ------------


@query("read_run_records", f"SELECT condition_id, count(*) AS records, count(*) FILTER (status <> 'success') AS failures, {mean_sql('cer')} AS mean_cer FROM {{run_records}} GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "records")
    rows = t.run_records.select("condition_id", F.col("document_id").cast("string").alias("document_id"), F.col("s").alias("severity"), "status",
                                F.struct(F.col("cer").alias("cer_normalized")).alias("ocr_metrics"))
    runs.write_run_records(rows, path)
    back = runs.read_run_records(t.spark, path)
    return back.groupBy("condition_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("status") != "success").alias("failures"), mean4("ocr_metrics.cer_normalized").alias("mean_cer"))


@query("read_summary", """SELECT condition_id, requested, successful, cer FROM (SELECT condition_id, count(*) AS requested, count(*) FILTER (status = 'success') AS successful FROM {run_records} GROUP BY 1)
  JOIN (SELECT condition_id, cer FROM {condition_means}) USING (condition_id)""")
def _(t):
    path = shared_dir(t.spark, "summary")
    counts = X.condition_counts(t.run_records)
    means = t.condition_means.select("condition_id", F.struct(F.struct(F.col("cer").alias("mean")).alias("cer_normalized")).alias("ocr"))
    nested = counts.select("condition_id", "status", F.struct("requested", "successful", "failed", "failure_rate").alias("document_counts")).join(means, "condition_id")
    runs.write_summary(nested, path, experiment_id="matrix", config_hash="none", split="validation")
    back = runs.read_summary(t.spark, path)
    return back.select("condition_id", "document_counts.requested", "document_counts.successful", F.col("ocr.cer_normalized.mean").alias("cer"))


@query("write_manifest", "SELECT 'matrix' AS experiment_id, count(DISTINCT condition_id) AS conditions, count(*) AS total_requested, count(*) FILTER (status <> 'success') AS total_failed FROM {run_records}")
def _(t):
    path = shared_dir(t.spark, "manifest")
    runs.write_manifest(X.run_totals(X.condition_counts(t.run_records)), path, experiment_id="matrix")
    return t.spark.read.schema("experiment_id string, conditions bigint, total_requested bigint, total_failed bigint").json(path)


@query("read_condition_csv", """SELECT condition_id, s AS severity, preprocessing, cer AS cer_norm_mean, 0.0E0 AS entity_hmean FROM {named_conditions}""")
def _(t):
    path = shared_dir(t.spark, "csv")
    names = [c.split()[0] for c in runs.B2_COLUMNS.split(", ")]
    have = {"condition_id": "condition_id", "baseline_type": "baseline_type", "degradation": "degradation", "severity": "s", "preprocessing": "preprocessing",
            "sample_size": "n", "cer_norm_mean": "cer", "wer_norm_mean": "wer", "ned_norm_mean": "ned", "macro_f1_norm_mean": "f1"}
    table = t.named_conditions.select(*[(F.col(have[n]) if n in have else F.lit(None).cast("string")).alias(n) for n in names])
    runs.write_condition_csv(table, path)
    back = runs.read_condition_csv(t.spark, path, runs.B2_COLUMNS, {"entity_hmean": 0.0})
    return back.select("condition_id", "severity", "preprocessing", "cer_norm_mean", "entity_hmean")


@query("matrix_config", "SELECT 'B0' AS baseline_type, 1::BIGINT AS conditions, count(*) AS evaluations FROM {documents} UNION ALL SELECT 'B1', 32, 32 * count(*) FROM {documents} UNION ALL SELECT 'B2', 128, 128 * count(*) FROM {documents}")
def _(t):
    """The survey's ``read_matrix_config``: a configuration turned into conditions, then evaluations over the documents."""
    from leafscore.sources.tables import matrix_frames

    config = {"matrix": {"severities": [0, 1, 2, 3, 4], "preprocessing_pipelines": {
        "p_minimal_cleanup": {}, "p_contrast_enhancement": {}, "p_standard_receipt_enhancement": {}, "p_aggressive_binarization": {}, "none": {}}}}
    conditions = M.condition_matrix(*matrix_frames(t.spark, config))
    docs = t.documents.agg(F.count("*").alias("_n"))
    return conditions.groupBy("baseline_type").agg(F.count("*").alias("conditions")).crossJoin(docs).select(
        "baseline_type", "conditions", (F.col("conditions") * F.col("_n")).alias("evaluations"))


@query("write_run_records", "SELECT condition_id, document_id::VARCHAR AS document_id, s AS severity, status, cer FROM {run_records}")
def _(t):
    """Every written record read back as plain rows of the partitioned JSON table."""
    path = shared_dir(t.spark, "written-records")
    rows = t.run_records.select("condition_id", F.col("document_id").cast("string").alias("document_id"), F.col("s").alias("severity"), "status", "cer")
    runs.write_run_records(rows, path)
    return t.spark.read.schema("condition_id string, document_id string, severity int, status string, cer double").json(path)


@query("write_summary", """SELECT condition_id, requested, failed, status FROM (SELECT condition_id, requested, requested - successful AS failed,
    CASE WHEN successful = 0 THEN 'ALL_FAILED' WHEN requested > successful THEN 'PARTIAL_FAILURE' ELSE 'SUCCESS' END AS status
  FROM (SELECT condition_id, count(*) AS requested, count(*) FILTER (status = 'success') AS successful FROM {run_records} GROUP BY 1))""")
def _(t):
    """The written document parsed as text, apart from the reader."""
    path = shared_dir(t.spark, "written-summary")
    runs.write_summary(X.condition_counts(t.run_records).select("condition_id", "requested", "failed", "status"), path, experiment_id="matrix")
    body = F.from_json("value", "struct<conditions: map<string, struct<requested: long, failed: long, status: string>>>")
    return t.spark.read.text(path).select(F.explode(body["conditions"]).alias("condition_id", "c")).select("condition_id", "c.*")


@query("write_condition_csv", "SELECT condition_id, degradation, s AS severity, n AS sample_size, cer, wer FROM {named_conditions}")
def _(t):
    path = shared_dir(t.spark, "written-csv")
    runs.write_condition_csv(t.named_conditions.select("condition_id", "degradation", F.col("s").alias("severity"), F.col("n").alias("sample_size"), "cer", "wer"), path)
    return t.spark.read.schema("condition_id string, degradation string, severity int, sample_size bigint, cer double, wer double").option("header", "true").csv(path)


@query("read_ops_tables", """SELECT d.document_id, d.status, coalesce(f.fields, 0) AS fields, coalesce(a.events, 0) AS events FROM {doc_lifecycle} d
  LEFT JOIN (SELECT document_id, count(*) AS fields FROM {extracted_fields} GROUP BY 1) f ON d.document_id = f.document_id
  LEFT JOIN (SELECT document_id, count(*) AS events FROM {audit_events} GROUP BY 1) a ON d.document_id = a.document_id""")
def _(t):
    """The operational tables as an export leaves them: one parquet table each, read by name."""
    from leafscore.sources.tables import read_ops_tables

    folder = shared_dir(t.spark, "ops")
    for name, rows in {"documents": t.doc_lifecycle, "extracted_fields": t.extracted_fields, "audit_events": t.audit_events}.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    tables = read_ops_tables(t.spark, folder, ("documents", "extracted_fields", "audit_events"))
    count = lambda name, as_: tables[name].groupBy("document_id").agg(F.count("*").alias(as_))
    out = tables["documents"].select("document_id", "status").join(count("extracted_fields", "fields"), "document_id", "left")
    return out.join(count("audit_events", "events"), "document_id", "left").na.fill(0, ["fields", "events"])
