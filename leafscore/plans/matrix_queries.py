"""Queries over experiment statistics and the robustness matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.functions.scalars import array_distortion
from leafscore.operators import matrix as M
from leafscore.operators import scoring as S
from leafscore.operators import stats as X
from leafscore.plans.registry import query
from leafscore.plans.scoring_queries import ENTITY, MATCHES, PRF_COUNTS, harmonic_sql, mean_sql, prf_sql, ratio_sql
from leafscore.sources.tables import matrix_frames

POLICIES = [1, 2, 3, 4]

COUNTS = """SELECT condition_id, requested, successful, requested - successful AS failed,
  CASE WHEN requested > 0 THEN round((requested - successful) / requested::DOUBLE, 4) ELSE 0.0E0 END AS failure_rate,
  CASE WHEN requested = 0 THEN 'EMPTY' WHEN successful = 0 THEN 'ALL_FAILED'
       WHEN requested > successful THEN 'PARTIAL_FAILURE' ELSE 'SUCCESS' END AS status
  FROM (SELECT condition_id, count(*) AS requested, count(*) FILTER (status = 'success') AS successful
        FROM {run_records} GROUP BY condition_id)"""


@query("condition_counts", COUNTS)
def _(t):
    return X.condition_counts(t.run_records)


@query("condition_text_stats", f"""SELECT condition_id, count(*) AS sample_size,
  {mean_sql('cer')} AS cer_mean, round(median(cer), 4) AS cer_median, round(coalesce(stddev_samp(cer), 0), 4) AS cer_std,
  {mean_sql('macro_match')} AS macro_match_mean, round(median(macro_match), 4) AS macro_match_median,
  round(coalesce(stddev_samp(macro_match), 0), 4) AS macro_match_std
  FROM {{run_records}} WHERE status = 'success' GROUP BY condition_id""")
def _(t):
    return X.condition_text_stats(t.run_records, ["cer", "macro_match"])


# At most three decimals, so that no median of two values ends in the half that the engines round apart.
SIX = {"cer": "cer", "wer": "round(cer * 1.5E0, 4)", "ned": "round(1 - cer, 4)", "cer_normalized": "round(cer * 0.5E0, 4)",
       "wer_normalized": "round(cer * 0.6E0, 4)", "macro_match": "macro_match"}


@query("metric_summary", " UNION ALL ".join(f"""SELECT condition_id, '{m}' AS metric, count(*) AS sample_size, {mean_sql('v')} AS mean, round(median(v), 4) AS median,
    round(coalesce(stddev_samp(v), 0), 4) AS std, true AS covers, true AS narrow FROM (SELECT condition_id, {e} AS v FROM {{run_records}} WHERE status = 'success') GROUP BY condition_id""" for m, e in SIX.items()))
def _(t):
    """Six metrics with intervals: each holds the sample's mean and is as narrow as its standard error allows."""
    rows = t.run_records.select("condition_id", "status", *[F.expr(e).alias(m) for m, e in SIX.items()])
    found = X.metric_summary(rows, list(SIX))
    error = F.col("std") / F.sqrt("sample_size")
    return found.select(
        "condition_id", "metric", "sample_size", "mean", "median", "std",
        F.col("mean").between(F.col("ci_lower"), F.col("ci_upper")).alias("covers"),
        (F.col("ci_upper") - F.col("ci_lower") <= 5 * error + 0.0002).alias("narrow"))


@query("scored_documents")
def _(t):
    """Flagship: whole documents scored in their own characters, then summarized per language."""
    from leafscore.plans.scoring_queries import document_pairs

    scored = S.score_text(document_pairs(t)).withColumn("status", F.lit("success"))
    return X.condition_text_stats(
        scored, ["cer_raw", "wer_raw", "char_ned_raw", "cer_normalized", "wer_normalized", "char_ned_normalized"], ["lang"])


_CUTS = X.poisson_thresholds()
_LANE = ", ".join(
    f"sum(x * ({w})) AS s{i}, sum({w}) AS w{i}"
    for i in range(4)
    for w in [" + ".join(f"(h[{1 + 8 * i}:{8 + 8 * i}] >= '{c}')::INT" for c in _CUTS)]
)


@query("bootstrap_ci", f"""WITH r AS (SELECT condition_id, document_id, CAST(round(cer * 10000) AS BIGINT) AS x
    FROM {{run_records}} WHERE status = 'success'),
  b AS (SELECT condition_id, b, x, md5(concat('42:', b::VARCHAR, ':', document_id::VARCHAR)) AS h
    FROM r, (SELECT unnest(range(250)) AS b)),
  l AS (SELECT condition_id, b, {_LANE} FROM b GROUP BY condition_id, b),
  m AS (SELECT condition_id, unnest([s0/w0::DOUBLE/10000, s1/w1::DOUBLE/10000, s2/w2::DOUBLE/10000, s3/w3::DOUBLE/10000]) AS m FROM l),
  q AS (SELECT condition_id, round(quantile_cont(m, 0.025), 4) AS ci_lower, round(quantile_cont(m, 0.975), 4) AS ci_upper
    FROM m GROUP BY condition_id)
  SELECT condition_id, n, ci_lower, ci_upper FROM q JOIN (SELECT condition_id, count(*) AS n FROM r GROUP BY condition_id) USING (condition_id)""")
def _(t):
    return X.bootstrap_ci(t.run_records.where("status = 'success'"), "cer", ["condition_id"])


@query("bootstrap_ci_counts")
def _(t):
    """Multinomial over value counts; compared with plain resampling in the tests."""
    return X.bootstrap_ci_counts(t.run_records.where("status = 'success'"), ["cer", "macro_match"], ["condition_id"])


COND_MATCHES = MATCHES.replace("SELECT document_id, field_name", "SELECT condition_id, document_id, field_name").replace(
    "{kie_pairs}", "{condition_fields}")
COND_PRF = COND_MATCHES + f""", c AS (SELECT condition_id, field_name, {PRF_COUNTS} FROM f GROUP BY condition_id, field_name),
 prf AS (SELECT *, {prf_sql('raw', True)}, {prf_sql('normalized', True)} FROM c)"""


@query("condition_field_stats", COND_PRF + """, r AS (SELECT condition_id, field_name, round(avg(mr::INT), 4) AS match_rate_raw,
    round(avg(mn::INT), 4) AS match_rate_normalized FROM f GROUP BY condition_id, field_name)
  SELECT * FROM r JOIN prf USING (condition_id, field_name)""")
def _(t):
    return X.condition_field_stats(S.field_matches(t.condition_fields))


_MACRO = ", ".join(
    f"{mean_sql(f'{m}_{k}')} AS macro_{m}_{k}" for k in ("raw", "normalized") for m in ("precision", "recall", "f1"))


@query("condition_kie_summary", COND_PRF + f""", dd AS (SELECT condition_id, document_id, bool_and(mr) AS r, bool_and(mn) AS n,
    avg(mn::INT) AS fr FROM f GROUP BY condition_id, document_id),
  a AS (SELECT condition_id, count(*) AS sample_size, round(avg(r::INT), 4) AS raw_doc_em_rate,
    round(avg(n::INT), 4) AS normalized_doc_em_rate, round(avg(fr), 4) AS mean_match_fraction FROM dd GROUP BY condition_id),
  mm AS (SELECT condition_id, {_MACRO} FROM prf GROUP BY condition_id),
  hh AS (SELECT *, {harmonic_sql('entity_precision', 'entity_recall')} AS entity_hmean FROM (
    SELECT *, {ratio_sql('total_matched_entities', 'total_pred_entities')} AS entity_precision,
      {ratio_sql('total_matched_entities', 'total_gt_entities')} AS entity_recall FROM (
      SELECT condition_id, count(*) FILTER (hgn) AS total_gt_entities, count(*) FILTER (hpn) AS total_pred_entities,
        count(*) FILTER (hpn AND hgn AND mn) AS total_matched_entities FROM f GROUP BY condition_id)))
  SELECT * FROM a JOIN mm USING (condition_id) JOIN hh USING (condition_id)""")
def _(t):
    return X.condition_kie_summary(S.field_matches(t.condition_fields))


@query("run_totals", f"""WITH c AS ({COUNTS}) SELECT *, round(total_failed / total_requested::DOUBLE, 4) AS failure_rate FROM (
  SELECT count(*) AS conditions, sum(requested)::BIGINT AS total_requested, sum(successful)::BIGINT AS total_successful,
    sum(failed)::BIGINT AS total_failed FROM c)""")
def _(t):
    return X.run_totals(X.condition_counts(t.run_records))


DELTAS = """dl AS (SELECT m.*, round(m.cer - c.cer, 4) AS delta_cer, round(m.wer - c.wer, 4) AS delta_wer,
    round(m.ned - c.ned, 4) AS delta_ned, round(m.f1 - c.f1, 4) AS delta_f1
  FROM {condition_means} m CROSS JOIN (SELECT * FROM {condition_means} WHERE condition_id = 'D0_S0_P0') c)"""
RECOVERED = """rc AS (SELECT m.*, r.condition_id AS reference_condition_id, round(m.cer - r.cer, 4) AS delta_cer,
    round(m.wer - r.wer, 4) AS delta_wer, round(m.ned - r.ned, 4) AS delta_ned, round(m.f1 - r.f1, 4) AS delta_f1
  FROM {condition_means} m JOIN {condition_means} r ON m.d = r.d AND m.s = r.s AND r.p = 0)"""


@query("delta_from_control", f"WITH {DELTAS} SELECT * FROM dl")
def _(t):
    return M.delta_from_control(t.condition_means)


@query("recovery_from_degraded", f"WITH {RECOVERED} SELECT * FROM rc")
def _(t):
    return M.recovery_from_degraded(t.condition_means, t.condition_means)


@query("run_integrity", f"""WITH {DELTAS}, {RECOVERED}, ck AS (
  SELECT 'rows_per_condition' AS "check", (SELECT count(*) FROM {{documents}})::DOUBLE AS expected,
    (SELECT min(n) FROM (SELECT count(*) AS n FROM {{run_records}} GROUP BY condition_id))::DOUBLE AS actual
  UNION ALL SELECT 'control_delta', 0.0E0, (SELECT sum(abs(delta_cer) + abs(delta_f1)) FROM dl WHERE condition_id = 'D0_S0_P0')
  UNION ALL SELECT 'recovery_coverage', (SELECT count(*) FROM {{condition_means}} WHERE p > 0)::DOUBLE,
    (SELECT count(*) FROM rc WHERE p > 0)::DOUBLE)
  SELECT *, expected = actual AS ok FROM ck""")
def _(t):
    means = t.condition_means
    deltas = M.delta_from_control(means).where(F.col("condition_id") == M.CONTROL)
    recovered = M.recovery_from_degraded(means, means).where("p > 0")
    rows = t.run_records.groupBy("condition_id").count()
    return X.run_integrity({
        "rows_per_condition": (t.documents.agg(F.count("*")), rows.agg(F.min("count"))),
        "control_delta": (t.documents.agg(F.lit(0.0)), deltas.agg(F.sum(F.abs("delta_cer") + F.abs("delta_f1")))),
        "recovery_coverage": (means.where("p > 0").agg(F.count("*")), recovered.agg(F.count("*"))),
    })


NAMED_DELTA = "JOIN {named_conditions} n USING (condition_id)"


@query("condition_table_b1", f"""WITH {DELTAS} SELECT dl.condition_id AS cond, split_part(dl.condition_id, '_', 1) AS deg,
    degradation AS name, split_part(dl.condition_id, '_', 2) AS sev, dl.cer, delta_cer AS d_cer, dl.wer, delta_wer AS d_wer,
    dl.ned, delta_ned AS d_ned, dl.f1, delta_f1 AS d_f1 FROM dl {NAMED_DELTA} WHERE dl.p = 0 AND dl.s > 0""")
def _(t):
    names = t.named_conditions.select("condition_id", "degradation")
    rows = M.delta_from_control(t.condition_means).where("p = 0 AND s > 0").join(names, "condition_id")
    part = F.split("condition_id", "_")
    return rows.select(
        F.col("condition_id").alias("cond"), part[0].alias("deg"), F.col("degradation").alias("name"), part[1].alias("sev"),
        "cer", F.col("delta_cer").alias("d_cer"), "wer", F.col("delta_wer").alias("d_wer"), "ned",
        F.col("delta_ned").alias("d_ned"), "f1", F.col("delta_f1").alias("d_f1"))


@query("condition_table_b2", f"""WITH {DELTAS}, {RECOVERED} SELECT dl.condition_id, baseline_type, degradation, n.s AS severity,
    preprocessing, n.n AS sample_size, n.cer AS cer_norm_mean, n.f1 AS macro_f1_norm_mean, dl.delta_cer AS delta_cer_from_b0,
    dl.delta_f1 AS delta_macro_f1_from_b0, reference_condition_id AS ref_b1_condition_id,
    rc.delta_cer AS delta_cer_recovery_b1, rc.delta_f1 AS delta_macro_f1_recovery_b1
  FROM dl {NAMED_DELTA} LEFT JOIN rc USING (condition_id)""")
def _(t):
    means = t.condition_means
    recovered = M.recovery_from_degraded(means, means).select(
        "condition_id", F.col("reference_condition_id").alias("ref_b1_condition_id"),
        F.col("delta_cer").alias("delta_cer_recovery_b1"), F.col("delta_f1").alias("delta_macro_f1_recovery_b1"))
    named = t.named_conditions.select("condition_id", "baseline_type", "degradation", "preprocessing")
    return (M.delta_from_control(means).join(named, "condition_id").join(recovered, "condition_id", "left").select(
        "condition_id", "baseline_type", "degradation", F.col("s").alias("severity"), "preprocessing",
        F.col("n").alias("sample_size"), F.col("cer").alias("cer_norm_mean"), F.col("f1").alias("macro_f1_norm_mean"),
        F.col("delta_cer").alias("delta_cer_from_b0"), F.col("delta_f1").alias("delta_macro_f1_from_b0"),
        "ref_b1_condition_id", "delta_cer_recovery_b1", "delta_macro_f1_recovery_b1"))


@query("policy_summary", f"""WITH {RECOVERED} SELECT p, count(*) AS conditions, {mean_sql('delta_cer')} AS mean_delta_cer,
    round(median(delta_cer), 4) AS median_delta_cer, count(*) FILTER (delta_cer < 0) AS cer_improved,
    count(*) FILTER (delta_cer > 0) AS cer_degraded, count(*) FILTER (delta_cer = 0) AS cer_unchanged,
    {mean_sql('delta_f1')} AS mean_delta_f1, round(median(delta_f1), 4) AS median_delta_f1,
    count(*) FILTER (delta_f1 > 0) AS f1_improved, count(*) FILTER (delta_f1 < 0) AS f1_degraded,
    count(*) FILTER (delta_f1 = 0) AS f1_unchanged FROM rc WHERE p > 0 GROUP BY p""")
def _(t):
    """The survey's ``pipeline_summary``."""
    return M.policy_summary(M.recovery_from_degraded(t.condition_means, t.condition_means).where("p > 0"))


@query("recovery_pivot", f"""WITH {RECOVERED} SELECT d, {', '.join(
    f"{mean_sql(f'CASE WHEN p = {p} THEN delta_cer END')} AS p{p}" for p in POLICIES)} FROM rc WHERE p > 0 GROUP BY d""")
def _(t):
    return M.recovery_pivot(M.recovery_from_degraded(t.condition_means, t.condition_means).where("p > 0"), POLICIES)


@query("hypothesis_slices", f"""WITH {RECOVERED} SELECT CASE WHEN d = 6 AND p = 3 THEN 'rotation_standard'
    WHEN d = 8 AND p = 2 THEN 'shadow_contrast' ELSE 'binarization' END AS slice, condition_id, delta_cer, delta_f1
  FROM rc WHERE (d = 6 AND p = 3) OR (d = 8 AND p = 2) OR p = 4""")
def _(t):
    recovered = M.recovery_from_degraded(t.condition_means, t.condition_means)
    return recovered.where("(d = 6 AND p = 3) OR (d = 8 AND p = 2) OR p = 4").select(
        F.when(F.expr("d = 6 AND p = 3"), "rotation_standard").when(F.expr("d = 8 AND p = 2"), "shadow_contrast")
        .otherwise("binarization").alias("slice"), "condition_id", "delta_cer", "delta_f1")


GRID = f"""WITH {RECOVERED}, g AS (SELECT rc.*, round(rc.cer - c.cer, 4) AS delta_cer_clean, round(rc.f1 - c.f1, 4) AS delta_f1_clean,
    CASE WHEN abs(round(rc.cer - delta_cer, 4) - c.cer) > 0.005
      THEN round((round(rc.cer - delta_cer, 4) - rc.cer) / (round(rc.cer - delta_cer, 4) - c.cer), 4) END AS relative_recovery
  FROM rc CROSS JOIN (SELECT cer, f1 FROM {{condition_means}} WHERE condition_id = 'D0_S0_P0') c WHERE rc.p > 0)"""


@query("recovery_grid", GRID + " SELECT * FROM g")
def _(t):
    return M.recovery_grid(t.condition_means)


@query("relative_recovery", GRID + " SELECT condition_id, relative_recovery FROM g WHERE d = 6")
def _(t):
    return M.recovery_grid(t.condition_means, degradation=6).select("condition_id", "relative_recovery")


@query("recovery_extremes", f"""WITH {RECOVERED}, x AS (SELECT * FROM rc WHERE p > 0) SELECT d, s,
    arg_min(p, {{{{'a': delta_cer, 'b': p}}}}) FILTER (delta_cer < 0) AS best_cer_policy,
    arg_min(p, {{{{'a': -delta_cer, 'b': p}}}}) FILTER (delta_cer > 0) AS worst_cer_policy,
    arg_min(p, {{{{'a': -delta_f1, 'b': p}}}}) FILTER (delta_f1 > 0) AS best_f1_policy,
    arg_min(p, {{{{'a': delta_f1, 'b': p}}}}) FILTER (delta_f1 < 0) AS worst_f1_policy
  FROM x GROUP BY d, s""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return M.recovery_extremes(M.recovery_from_degraded(t.condition_means, t.condition_means).where("p > 0"))


@query("policy_extremes", f"""WITH {RECOVERED}, x AS (SELECT * FROM rc WHERE p > 0) SELECT p, count(*) AS conditions,
    count(*) FILTER (delta_cer < -0.01) AS positive, count(*) FILTER (delta_cer > 0.01) AS negative,
    arg_min(condition_id, {{{{'a': delta_cer, 'b': condition_id}}}}) FILTER (delta_cer < -0.01) AS best_condition,
    arg_min(condition_id, {{{{'a': -delta_cer, 'b': condition_id}}}}) FILTER (delta_cer > 0.01) AS worst_condition
  FROM x GROUP BY p""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return M.policy_extremes(M.recovery_from_degraded(t.condition_means, t.condition_means).where("p > 0"))


@query("severity_rank", f"""WITH {DELTAS} SELECT condition_id, delta_cer, delta_f1,
    row_number() OVER (ORDER BY delta_cer DESC, condition_id) AS cer_rank,
    row_number() OVER (ORDER BY delta_f1, condition_id) AS f1_rank FROM dl WHERE s = 4 AND p = 0""")
def _(t):
    return M.severity_rank(M.delta_from_control(t.condition_means))


CURVE = """cv AS (SELECT d, s, cer, f1, ned FROM {condition_means} WHERE p = 0 AND s > 0 UNION ALL
  SELECT x.d, 0, c.cer, c.f1, c.ned FROM (SELECT DISTINCT d FROM {condition_means} WHERE p = 0 AND s > 0) x
    CROSS JOIN (SELECT * FROM {condition_means} WHERE condition_id = 'D0_S0_P0') c),
  st AS (SELECT *, lag(s) OVER w AS ps, cer - lag(cer) OVER w AS dc, f1 - lag(f1) OVER w AS df, ned - lag(ned) OVER w AS dn
    FROM cv WINDOW w AS (PARTITION BY d ORDER BY s))"""


@query("curve_jump", f"""WITH {CURVE}, j AS (SELECT d, max(round(dc, 4)) AS mj FROM st WHERE s > 1 GROUP BY d)
  SELECT d, greatest(mj, 0.0E0) AS max_jump, CASE WHEN mj > 0.05 THEN
    (SELECT min(s) FROM st WHERE st.d = j.d AND st.s > 1 AND round(st.dc, 4) = mj) END AS inflection_severity FROM j""")
def _(t):
    return M.curve_jump(t.condition_means)


@query("curve_jump_abs", f"""WITH {CURVE}, k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY abs(round(dc, 4)) DESC, s) AS rn
    FROM st WHERE ps IS NOT NULL)
  SELECT d, ps AS from_severity, s AS to_severity, round(dc, 4) AS cer_change, round(df, 4) AS f1_change, round(dn, 4) AS ned_change
  FROM k WHERE rn = 1""")
def _(t):
    return M.curve_jump_abs(t.condition_means)


@query("curve_monotonic", f"""WITH {CURVE} SELECT d, bool_and(coalesce(dc >= 0, true)) AS cer_monotonic,
    bool_and(coalesce(df <= 0, true)) AS f1_monotonic FROM st GROUP BY d""")
def _(t):
    return M.curve_monotonic(t.condition_means)


@query("curve_extents", """SELECT d, min(cer) AS min_cer, max(cer) AS max_cer, min(f1) AS min_f1, max(f1) AS max_f1
  FROM {condition_means} WHERE p = 0 AND s > 0 GROUP BY d""")
def _(t):
    return M.curve_extents(t.condition_means)


@query("impact_lists", f"""WITH {DELTAS}, {RECOVERED},
  a AS (SELECT 'impact' AS kind, condition_id, cer AS value FROM dl WHERE p = 0 AND s > 0),
  b AS (SELECT 'recovery' AS kind, condition_id, delta_cer AS value FROM rc WHERE p > 0),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT kind, condition_id, split_part(condition_id, '_', 1) AS degradation, split_part(condition_id, '_', 2)[2:]::INT AS severity,
    value FROM u""")
def _(t):
    means = t.condition_means
    return M.impact_lists(M.delta_from_control(means), M.recovery_from_degraded(means, means))


@query("overview_tracks", f"""WITH {RECOVERED} SELECT track, conditions, evaluations, mean_cer, max_cer, degradations, policies,
    CASE WHEN track = 'B2' THEN (SELECT min(delta_cer) FROM rc WHERE p > 0) END AS best_delta_cer, conditions > 0 AS available FROM (
  SELECT CASE WHEN s = 0 THEN 'B0' WHEN p = 0 THEN 'B1' ELSE 'B2' END AS track, count(*) AS conditions,
    sum(n)::BIGINT AS evaluations, {mean_sql('cer')} AS mean_cer, max(cer) AS max_cer, count(DISTINCT d) AS degradations,
    count(DISTINCT p) AS policies FROM {{condition_means}} GROUP BY ALL)""")
def _(t):
    means = t.condition_means
    return M.overview_tracks(means, M.recovery_from_degraded(means, means))


@query("branch_means", """SELECT CASE WHEN s = 0 THEN 'b0' WHEN p = 0 THEN 'b1' ELSE 'b2' END AS branch, count(*) AS count,
    MEANS
  FROM {condition_means} GROUP BY 1""".replace("MEANS", ", ".join(f"{mean_sql(m)} AS mean_{m}" for m in M.METRICS)))
def _(t):
    return M.branch_means(t.condition_means)


CID = """concat_ws('_', CASE lower(trim(degradation)) WHEN 'none' THEN 'D0' WHEN 'gaussian_blur' THEN 'D1' WHEN 'motion_blur' THEN 'D2'
    WHEN 'gaussian_noise' THEN 'D3' WHEN 'jpeg_compression' THEN 'D4' WHEN 'downsampling' THEN 'D5' WHEN 'rotation' THEN 'D6'
    WHEN 'perspective' THEN 'D7' WHEN 'shadow' THEN 'D8' ELSE upper(degradation) END, concat('S', severity::VARCHAR),
  CASE WHEN lower(preprocessing) IN ('none', 'p0', 'raw', '') THEN 'P0' ELSE concat('P_', substr(preprocessing, 3)) END)"""
GRID_SQL = f"""c0 AS (SELECT 'none' AS degradation, 0 AS severity, 'none' AS preprocessing UNION ALL
    SELECT degradation, severity, preprocessing FROM (SELECT DISTINCT degradation FROM {{named_conditions}} WHERE d > 0)
      CROSS JOIN (SELECT DISTINCT s AS severity FROM {{named_conditions}} WHERE s > 0)
      CROSS JOIN (SELECT DISTINCT preprocessing FROM {{named_conditions}})),
  cm AS (SELECT {CID} AS condition_id, degradation, severity, preprocessing, CASE WHEN severity = 0 THEN 'B0'
    WHEN preprocessing = 'none' THEN 'B1' ELSE 'B2' END AS baseline_type FROM c0)"""


#: The matrix whose conditions documents are put under: a bounded list, known without reading a table.
MATRIX = {"matrix": {"severities": [1, 2, 3, 4], "preprocessing_pipelines": {
    "p_minimal_cleanup": {}, "p_contrast_enhancement": {}, "p_standard_receipt_enhancement": {}, "p_aggressive_binarization": {}}}}


def configured(t, preprocessing: bool = True):
    """Conditions of the configured matrix; without ``preprocessing`` the control and the degradations alone."""
    degradations, severities, pipelines = matrix_frames(t.spark, MATRIX)
    return M.condition_matrix(degradations, severities, pipelines if preprocessing else pipelines.limit(0))


def _matrix(t):
    named = t.named_conditions
    return M.condition_matrix(named.select("degradation"), named.select("s"), named.select("preprocessing"))


@query("condition_matrix", f"WITH {GRID_SQL} SELECT * FROM cm")
def _(t):
    return _matrix(t)


@query("matrix_expand", f"""WITH {GRID_SQL} SELECT doc_id AS document_id, condition_id,
    ('0x' || sha256(concat_ws(':', '42', doc_id::VARCHAR, degradation, severity::VARCHAR, preprocessing))[1:8])::BIGINT AS derived_seed
  FROM {{documents}} CROSS JOIN cm""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("document_id"))
    return M.matrix_expand(docs, configured(t)).select("document_id", "condition_id", "derived_seed")


@query("condition_id", f"SELECT {CID} AS id, degradation, severity, preprocessing FROM (SELECT *, s AS severity FROM {{named_conditions}})")
def _(t):
    return t.named_conditions.select(
        M.condition_id(F.col("degradation"), F.col("s"), F.col("preprocessing")).alias("id"), "degradation",
        F.col("s").alias("severity"), "preprocessing")


@query("condition_check", """SELECT condition_id, baseline_type, CASE WHEN s = 0 THEN degradation = 'none' AND baseline_type = 'B0'
    WHEN s BETWEEN 1 AND 4 THEN degradation <> 'none' ELSE false END AS valid
  FROM (SELECT condition_id, CASE WHEN p = 4 AND d = 2 THEN 'none' ELSE degradation END AS degradation, baseline_type,
    CASE WHEN p = 3 AND d = 1 THEN s + 1 ELSE s END AS s FROM {named_conditions})""")
def _(t):
    rows = t.named_conditions.select(
        "condition_id", "baseline_type",
        F.when(F.expr("p = 4 AND d = 2"), "none").otherwise(F.col("degradation")).alias("degradation"),
        F.when(F.expr("p = 3 AND d = 1"), F.col("s") + 1).otherwise(F.col("s")).alias("s"))
    return rows.select(
        "condition_id", "baseline_type",
        M.condition_valid(F.col("degradation"), F.col("s"), F.col("baseline_type")).alias("valid"))


LAT = """round(avg({0}), 2) AS mean_ms, round(median({0}), 2) AS median_ms, round(stddev_pop({0}), 2) AS std_ms,
  round(min({0}), 2) AS min_ms, round(max({0}), 2) AS max_ms, round(quantile_cont({0}, 0.9), 2) AS p90_ms,
  round(quantile_cont({0}, 0.95), 2) AS p95_ms, round(quantile_cont({0}, 0.99), 2) AS p99_ms"""


@query("latency_stats", f"SELECT document_type, {LAT.format('processing_duration_ms')} FROM {{doc_lifecycle}} WHERE processing_duration_ms IS NOT NULL GROUP BY document_type")
def _(t):
    docs = t.doc_lifecycle.where("processing_duration_ms IS NOT NULL")
    return X.latency_stats(docs, "processing_duration_ms", ["document_type"])


@query("speedup_projection", f"""WITH a AS (SELECT {LAT.format('ms_a')} FROM {{run_pairs}}), b AS (SELECT {LAT.format('ms_b')} FROM {{run_pairs}}),
  h AS (SELECT a.mean_ms AS am, b.mean_ms AS bm, a.median_ms AS ad, b.median_ms AS bd,
    round(4158 * (a.mean_ms / 1000.0E0) / 3600.0E0, 2) AS hours_a, round(4158 * (b.mean_ms / 1000.0E0) / 3600.0E0, 2) AS hours_b FROM a, b)
  SELECT round(am / greatest(bm, 0.001), 2) AS mean_speedup, round(ad / greatest(bd, 0.001), 2) AS median_speedup, hours_a, hours_b,
    round(hours_a - hours_b, 2) AS hours_saved FROM h""")
def _(t):
    runs = t.run_pairs
    return X.speedup_projection(X.latency_stats(runs, "ms_a"), X.latency_stats(runs, "ms_b"), 4158)


def _distortion(t):
    rows = t.calibration_pairs.withColumn("changed", F.transform("embedding", lambda v: v * (1 - F.col("severity") * 0.125)))
    return rows.select("vec_id", "family", "severity", array_distortion(F.col("embedding"), F.col("changed")).alias("m")).select(
        "vec_id", "family", "severity", "m.*")


DIST = """z AS (SELECT vec_id, family, severity, len(embedding) AS n, embedding::DOUBLE[] AS a,
    list_transform(embedding::DOUBLE[], lambda v: v * (1 - severity * 0.125::DOUBLE)) AS b FROM {calibration_pairs}),
  y AS (SELECT *, list_transform(list_zip(a, b), lambda q: q[1] - q[2]) AS df FROM z),
  w AS (SELECT vec_id, family, severity, list_sum(list_transform(df, lambda q: q * q)) / n AS mse,
    list_sum(list_transform(df, lambda q: abs(q))) / n AS mae, list_sum(a) / n AS ma, list_sum(b) / n AS mb FROM y),
  ds AS (SELECT vec_id, family, severity, mse, mae, CASE WHEN mse = 0 THEN 100.0E0 ELSE 10 * log10(65025.0E0 / mse) END AS psnr,
    CASE WHEN ma <= 1e-6 THEN 0.0E0 ELSE greatest(0.0E0, (ma - mb) / ma) END AS mean_drop FROM w)"""


@query("array_distortion", f"WITH {DIST} SELECT vec_id, round(mse, 6) AS mse, round(mae, 6) AS mae, round(psnr, 4) AS psnr, round(mean_drop, 4) AS mean_drop FROM ds")
def _(t):
    return _distortion(t).select(
        "vec_id", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"), F.round("psnr", 4).alias("psnr"),
        F.round("mean_drop", 4).alias("mean_drop"))


CAL = f"""{DIST}, cal AS (SELECT family, severity, count(*) AS n, round(avg(mse), 2) AS mse, round(avg(mae), 2) AS mae,
    round(avg(psnr), 2) AS psnr, round(avg(mean_drop), 2) AS mean_drop FROM ds GROUP BY family, severity)"""


@query("calibration_means", f"WITH {CAL} SELECT * FROM cal")
def _(t):
    return M.calibration_means(_distortion(t))


@query("calibration_monotonic", f"""WITH {CAL}, st AS (SELECT family, severity, psnr - lag(psnr) OVER w AS dp, mae - lag(mae) OVER w AS da
    FROM cal WINDOW w AS (PARTITION BY family ORDER BY severity))
  SELECT family, CASE WHEN family < 'F5' THEN 'psnr' ELSE 'mae' END AS metric,
    bool_and(coalesce(CASE WHEN family < 'F5' THEN dp <= 0 ELSE da >= 0 END, true)) AS monotonic FROM st GROUP BY family""")
def _(t):
    means = M.calibration_means(_distortion(t))
    family = F.col("family")
    rules = t.calibration_pairs.select("family").distinct().select(
        family, F.when(family < "F5", "psnr").otherwise("mae").alias("metric"), F.when(family < "F5", -1).otherwise(1).alias("direction"))
    return M.calibration_monotonic(means, rules)
