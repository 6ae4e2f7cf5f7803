"""Run records, summaries, manifests and condition tables: readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_RECORD = (
    "experiment_id string, condition_id string, document_id string, baseline_type string, degradation string, "
    "severity int, preprocessing string, derived_seed bigint, status string, error_type string, error_message string, "
    "ocr_metrics struct<cer_raw: double, wer_raw: double, char_ned_raw: double, cer_normalized: double, "
    "wer_normalized: double, char_ned_normalized: double, char_edit_distance_raw: int, "
    "char_edit_distance_normalized: int>, "
    "kie_metrics struct<raw_predictions: map<string,string>, raw_ground_truth: map<string,string>, "
    "normalized_predictions: map<string,string>, normalized_ground_truth: map<string,string>, "
    "field_matches_raw: map<string,boolean>, field_matches_normalized: map<string,boolean>, raw_doc_em: boolean, "
    "normalized_doc_em: boolean>, predicted_fields map<string,string>"
)
# Key names as they stand in run summary files.
_STAT = "struct<mean: double, median: double, std: double, ci_95: array<double>>"
SUMMARY = (
    "experiment_id string, config_hash string, split string, conditions map<string, struct<"
    "status: string, document_counts: struct<requested: bigint, successful: bigint, failed: bigint, failure_rate: double>, "
    f"ocr: struct<cer_normalized: {_STAT}, wer_normalized: {_STAT}, char_ned_normalized: {_STAT}>, "
    "kie: struct<macro_f1_normalized: double, normalized_doc_em_rate: double, "
    "sroie_official_compatible: struct<entity_hmean: double>>, "
    "delta_from_b0: map<string,string>>>"
)
# Columns of the two flat condition tables.
B1_COLUMNS = (
    "cond string, deg string, name string, sev string, cer double, cer_ci_lower double, cer_ci_upper double, "
    "d_cer double, wer double, d_wer double, ned double, d_ned double, f1 double, f1_ci_lower double, "
    "f1_ci_upper double, d_f1 double, hmean double, d_hmean double, f_comp double, f_date double, f_addr double, "
    "f_tot double"
)
B2_COLUMNS = (
    "condition_id string, baseline_type string, degradation string, severity int, preprocessing string, "
    "sample_size bigint, cer_norm_mean double, cer_norm_ci_lower double, cer_norm_ci_upper double, "
    "wer_norm_mean double, ned_norm_mean double, macro_f1_norm_mean double, macro_f1_ci_lower double, "
    "macro_f1_ci_upper double, entity_hmean double, doc_em_norm double, delta_cer_from_b0 double, "
    "delta_wer_from_b0 double, delta_ned_from_b0 double, delta_macro_f1_from_b0 double, "
    "delta_entity_hmean_from_b0 double, delta_doc_em_from_b0 double, ref_b1_condition_id string, "
    "delta_cer_recovery_b1 double, delta_wer_recovery_b1 double, delta_ned_recovery_b1 double, "
    "delta_macro_f1_recovery_b1 double, delta_entity_hmean_recovery_b1 double, delta_doc_em_recovery_b1 double"
)


def read_run_records(spark: SparkSession, path: str, schema: str = RUN_RECORD) -> DataFrame:
    """JSON-lines run records; blank lines are skipped and unparsable ones dropped with their document id null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("document_id IS NOT NULL")


def last_per_document(records: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """The last record per document (and condition) by an ordering column."""
    keys = keys or ["condition_id", "document_id"]
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def write_run_records(records: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """One object per (condition, document), failures included, laid out by condition.

    The rebalance gives each condition few, evenly sized files: it splits a condition with very many rows and joins
    small ones, instead of every task writing a file into every condition.
    """
    records.hint("rebalance", "condition_id").write.mode(mode).partitionBy("condition_id").format(fmt).save(path)


def read_summary(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    """A run summary document as one row per condition."""
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    return docs.select("experiment_id", "config_hash", F.explode("conditions").alias("condition_id", "c")).select(
        "experiment_id", "config_hash", "condition_id", "c.*"
    )


def write_summary(conditions: DataFrame, path: str, mode: str = "errorifexists", **header: str) -> None:
    """One nested document per run: header values and a map of condition id to its statistics.

    The map has one entry per condition (hundreds), which bounds the gathered value.
    """
    body = F.struct(*[c for c in conditions.columns if c != "condition_id"])
    nested = conditions.agg(F.map_from_entries(F.collect_list(F.struct("condition_id", body))).alias("conditions"))
    head = [F.lit(v).alias(k) for k, v in header.items()]
    nested.select(F.to_json(F.struct(*head, "conditions")).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_manifest(totals: DataFrame, path: str, mode: str = "errorifexists", **provenance: str) -> None:
    """Provenance values next to the run totals, as one JSON document."""
    head = [F.lit(v).alias(k) for k, v in provenance.items()]
    totals.select(F.to_json(F.struct(*head, *totals.columns)).alias("value")).write.mode(mode).text(path)


def read_condition_csv(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """A flat condition table with a header; cells that are not numbers become null or the given default."""
    rows = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return rows.na.fill(defaults) if defaults else rows


def write_condition_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A flat condition table (hundreds of rows) as one CSV file with a header."""
    table.coalesce(1).write.mode(mode).option("header", "true").csv(path)
