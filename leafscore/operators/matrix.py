"""Robustness matrix: conditions, deltas from the control, recoveries, curves and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.functions.scalars import derive_seed, mean4
from leafscore.functions.text import strip

CONTROL = "D0_S0_P0"

# Degradation name -> code.
DEGRADATION_CODE = {
    "none": "D0",
    "control": "D0",
    "gaussian_blur": "D1",
    "motion_blur": "D2",
    "gaussian_noise": "D3",
    "jpeg_compression": "D4",
    "downsampling": "D5",
    "rotation": "D6",
    "perspective": "D7",
    "shadow": "D8",
}

METRICS = ["cer", "wer", "ned", "f1"]


def condition_id(degradation: Column, severity: Column, preprocessing: Column) -> Column:
    """``D1_S2_P_clahe`` from names; unknown degradations are upper-cased, blank preprocessing is ``P0``."""
    table = F.create_map(*[F.lit(x) for pair in DEGRADATION_CODE.items() for x in pair])
    code = F.coalesce(F.try_element_at(table, F.lower(strip(degradation))), F.upper(degradation))
    prep = strip(preprocessing)
    low = F.lower(prep)
    p_code = (
        F.when(low.isin("none", "p0", "raw", ""), "P0")
        .when(low.startswith("p_"), F.concat(F.lit("P_"), F.substring(prep, 3, 2**31 - 1)))
        .otherwise(F.concat(F.lit("P_"), prep))
    )
    return F.concat_ws("_", code, F.concat(F.lit("S"), severity.cast("string")), p_code)


def baseline_type(severity: Column, preprocessing: Column) -> Column:
    """B0 for severity 0, B1 without preprocessing, B2 with."""
    blank = F.lower(preprocessing).isin("none", "p0", "raw", "")
    return F.when(severity == 0, "B0").when(blank, "B1").otherwise("B2")


def condition_valid(degradation: Column, severity: Column, baseline: Column) -> Column:
    """Severity 0 belongs to the control alone; 1..4 need a degradation; nothing else is allowed."""
    return (
        F.when(severity == 0, (degradation == "none") & (baseline == "B0"))
        .when(severity.between(1, 4), degradation != "none")
        .otherwise(False)
    )


def condition_matrix(degradations: DataFrame, severities: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Control, degradation-only and preprocessed conditions from one-column frames of names and levels."""
    d = degradations.toDF("degradation").where(~F.lower("degradation").isin("none", "control")).distinct()
    s = severities.toDF("severity").where(F.col("severity").between(1, 4)).distinct()
    p = pipelines.toDF("preprocessing").where(~F.lower("preprocessing").isin("none", "p0", "raw")).distinct()
    grid = d.crossJoin(F.broadcast(s))
    none = grid.withColumn("preprocessing", F.lit("none"))
    cells = none.unionByName(grid.crossJoin(F.broadcast(p)))
    control = s.agg(
        F.lit("none").alias("degradation"), F.lit(0).alias("severity"), F.lit("none").alias("preprocessing")
    )
    return control.unionByName(cells).select(
        condition_id(F.col("degradation"), F.col("severity"), F.col("preprocessing")).alias("condition_id"),
        "degradation",
        "severity",
        "preprocessing",
        baseline_type(F.col("severity"), F.col("preprocessing")).alias("baseline_type"),
    )


def matrix_expand(documents: DataFrame, conditions: DataFrame, seed: int = 42) -> DataFrame:
    """Every document under every condition, with its derived seed. Conditions are a few hundred rows at most."""
    return documents.crossJoin(F.broadcast(conditions)).withColumn(
        "derived_seed",
        derive_seed(seed, F.col("document_id"), F.col("degradation"), F.col("severity"), F.col("preprocessing")),
    )


def delta_from_control(means: DataFrame, reference: DataFrame | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Each condition minus the control, a missing metric counting as 0; null when there is no control row."""
    metrics = metrics or METRICS
    control = (means if reference is None else reference).where(F.col("condition_id") == CONTROL)
    one = control.agg(F.count("*").alias("_n"), *[F.first(m).alias(f"_{m}") for m in metrics])
    deltas = {
        f"delta_{m}": F.when(
            F.col("_n") > 0, F.round(F.coalesce(m, F.lit(0.0)) - F.coalesce(f"_{m}", F.lit(0.0)), 4)
        )
        for m in metrics
    }
    return means.crossJoin(F.broadcast(one)).withColumns(deltas).drop("_n", *[f"_{m}" for m in metrics])


def recovery_from_degraded(means: DataFrame, degraded: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Each preprocessed condition minus the matching degradation-only one; unmatched conditions get no row."""
    metrics = metrics or METRICS
    ref = degraded.where("p = 0").select(
        "d", "s", F.col("condition_id").alias("reference_condition_id"), *[F.col(m).alias(f"_{m}") for m in metrics]
    )
    deltas = {f"delta_{m}": F.round(F.coalesce(m, F.lit(0.0)) - F.coalesce(f"_{m}", F.lit(0.0)), 4) for m in metrics}
    return means.join(F.broadcast(ref), ["d", "s"]).withColumns(deltas).drop(*[f"_{m}" for m in metrics])


def relative_recovery(degraded: Column, restored: Column, control: Column) -> Column:
    """Share of the loss that was won back; null when the loss is within 0.005."""
    loss = degraded - control
    return F.when(F.abs(loss) > 0.005, F.round((degraded - restored) / loss, 4))


def recovery_grid(
    means: DataFrame, degradation: int | None = None, severity: int | None = None, policy: int | None = None
) -> DataFrame:
    """degradation x severity x policy grid with deltas from the degraded and the clean condition.

    Cells lacking the degraded reference or the policy row are skipped.
    """
    cells = means.where("p > 0")
    for name, value in (("d", degradation), ("s", severity), ("p", policy)):
        if value is not None:
            cells = cells.where(F.col(name) == value)
    control = means.where(F.col("condition_id") == CONTROL).agg(
        F.first("cer").alias("ctrl_cer"), F.first("f1").alias("ctrl_f1")
    )
    out = recovery_from_degraded(cells, means).crossJoin(F.broadcast(control))
    degraded = F.round(F.col("cer") - F.col("delta_cer"), 4)
    return out.withColumns(
        {
            "delta_cer_clean": F.round(F.col("cer") - F.col("ctrl_cer"), 4),
            "delta_f1_clean": F.round(F.col("f1") - F.col("ctrl_f1"), 4),
            "relative_recovery": relative_recovery(degraded, F.col("cer"), F.col("ctrl_cer")),
        }
    ).drop("ctrl_cer", "ctrl_f1")


def recovery_extremes(recovered: DataFrame) -> DataFrame:
    """Per (degradation, severity) the policy with the largest CER fall/rise and the largest F1 rise/fall."""

    def best(pick, delta: str, keep: Column) -> Column:
        order = F.struct(F.col(delta), F.col("p") if pick is F.min_by else -F.col("p"))
        return pick(F.when(keep, F.col("p")), F.when(keep, order))

    return recovered.groupBy("d", "s").agg(
        best(F.min_by, "delta_cer", F.col("delta_cer") < 0).alias("best_cer_policy"),
        best(F.max_by, "delta_cer", F.col("delta_cer") > 0).alias("worst_cer_policy"),
        best(F.max_by, "delta_f1", F.col("delta_f1") > 0).alias("best_f1_policy"),
        best(F.min_by, "delta_f1", F.col("delta_f1") < 0).alias("worst_f1_policy"),
    )


def policy_extremes(recovered: DataFrame, margin: float = 0.01) -> DataFrame:
    """Per policy: conditions improved/worsened beyond the margin, and the best and worst of them."""
    down, up = F.col("delta_cer") < -margin, F.col("delta_cer") > margin
    rank_down = F.struct(F.col("delta_cer"), F.col("condition_id"))
    return recovered.groupBy("p").agg(
        F.count("*").alias("conditions"),
        F.count_if(down).alias("positive"),
        F.count_if(up).alias("negative"),
        F.min(F.when(down, rank_down))["condition_id"].alias("best_condition"),
        F.min_by(F.when(up, F.col("condition_id")), F.when(up, F.struct(-F.col("delta_cer"), F.col("condition_id")))).alias(
            "worst_condition"
        ),
    )


def policy_summary(recovered: DataFrame) -> DataFrame:
    """Per policy: mean and median deltas and strict improved/degraded/unchanged counts."""
    cer, f1 = F.col("delta_cer"), F.col("delta_f1")
    return recovered.groupBy("p").agg(
        F.count("*").alias("conditions"),
        mean4(cer).alias("mean_delta_cer"),
        F.round(F.median(cer), 4).alias("median_delta_cer"),
        F.count_if(cer < 0).alias("cer_improved"),
        F.count_if(cer > 0).alias("cer_degraded"),
        F.count_if(cer == 0).alias("cer_unchanged"),
        mean4(f1).alias("mean_delta_f1"),
        F.round(F.median(f1), 4).alias("median_delta_f1"),
        F.count_if(f1 > 0).alias("f1_improved"),
        F.count_if(f1 < 0).alias("f1_degraded"),
        F.count_if(f1 == 0).alias("f1_unchanged"),
    )


def recovery_pivot(recovered: DataFrame, policies: list[int], metric: str = "delta_cer") -> DataFrame:
    """degradation x policy mean delta; the policy list is explicit so no extra job discovers it."""
    out = recovered.groupBy("d").pivot("p", policies).agg(mean4(metric))
    return out.select("d", *[F.col(str(p)).alias(f"p{p}") for p in policies])


def severity_rank(deltas: DataFrame, severity: int = 4) -> DataFrame:
    """Degradation-only conditions of one severity ranked by CER increase and by F1 loss."""
    rows = deltas.where((F.col("s") == severity) & (F.col("p") == 0))
    whole = Window.partitionBy("s")
    return rows.select(
        "condition_id",
        "delta_cer",
        "delta_f1",
        F.row_number().over(whole.orderBy(F.desc("delta_cer"), "condition_id")).alias("cer_rank"),
        F.row_number().over(whole.orderBy("delta_f1", "condition_id")).alias("f1_rank"),
    )


def _with_control(means: DataFrame) -> DataFrame:
    """Curves d = 1..8 over severities 0..4, severity 0 being the control repeated for each degradation."""
    curves = means.where("p = 0 AND s > 0").select("d", "s", *METRICS)
    control = means.where(F.col("condition_id") == CONTROL).select(*METRICS)
    start = curves.select("d").distinct().crossJoin(F.broadcast(control))
    return curves.unionByName(start.select("d", F.lit(0).alias("s"), *METRICS))


def curve_jump(means: DataFrame, least: float = 0.05) -> DataFrame:
    """Largest CER rise between adjacent severities per degradation; null severity when not above ``least``."""
    w = Window.partitionBy("d").orderBy("s")
    steps = means.where("p = 0 AND s > 0").withColumn("jump", F.round(F.col("cer") - F.lag("cer").over(w), 4))
    top = steps.groupBy("d").agg(
        F.greatest(F.max("jump"), F.lit(0.0)).alias("max_jump"),
        F.max_by("s", F.struct(F.col("jump"), -F.col("s"))).alias("at"),
    )
    return top.select("d", "max_jump", F.when(F.col("max_jump") > least, F.col("at")).alias("inflection_severity"))


def curve_jump_abs(means: DataFrame) -> DataFrame:
    """Largest absolute CER change per degradation including control -> S1; the first of equals wins."""
    w = Window.partitionBy("d").orderBy("s")
    steps = _with_control(means).withColumns(
        {
            "from_severity": F.lag("s").over(w),
            "cer_change": F.round(F.col("cer") - F.lag("cer").over(w), 4),
            "f1_change": F.round(F.col("f1") - F.lag("f1").over(w), 4),
            "ned_change": F.round(F.col("ned") - F.lag("ned").over(w), 4),
        }
    )
    pick = F.row_number().over(Window.partitionBy("d").orderBy(F.desc(F.abs("cer_change")), "s"))
    return (
        steps.where("from_severity IS NOT NULL")
        .withColumn("_k", pick)
        .where("_k = 1")
        .select("d", "from_severity", F.col("s").alias("to_severity"), "cer_change", "f1_change", "ned_change")
    )


def curve_monotonic(means: DataFrame) -> DataFrame:
    """Whether CER never falls and F1 never rises along control, S1..S4."""
    w = Window.partitionBy("d").orderBy("s")
    steps = _with_control(means).select(
        "d",
        F.coalesce(F.col("cer") >= F.lag("cer").over(w), F.lit(True)).alias("up"),
        F.coalesce(F.col("f1") <= F.lag("f1").over(w), F.lit(True)).alias("down"),
    )
    return steps.groupBy("d").agg(F.bool_and("up").alias("cer_monotonic"), F.bool_and("down").alias("f1_monotonic"))


def curve_extents(means: DataFrame) -> DataFrame:
    """Smallest and largest CER and F1 per degradation, falling back to the control for an empty curve."""
    control = means.where(F.col("condition_id") == CONTROL).agg(F.first("cer").alias("_c"), F.first("f1").alias("_f"))
    curve = (F.col("p") == 0) & (F.col("s") > 0)
    out = means.where("d > 0").groupBy("d").agg(
        *[f(F.when(curve, F.col(m))).alias(f"{n}_{m}") for m in ("cer", "f1") for n, f in (("min", F.min), ("max", F.max))]
    )
    fill = {f"{n}_{m}": F.coalesce(f"{n}_{m}", f"_{m[0]}") for m in ("cer", "f1") for n in ("min", "max")}
    return out.crossJoin(F.broadcast(control)).withColumns(fill).drop("_c", "_f")


def impact_lists(deltas: DataFrame, recovered: DataFrame, impacts: int | None = None, recoveries: int | None = None) -> DataFrame:
    """Report lists: degradation impacts and recoveries, all of them or the first so many in condition order."""
    parts = F.split("condition_id", "_")
    head = deltas.where((F.col("p") == 0) & (F.col("condition_id") != CONTROL)).select(
        F.lit("impact").alias("kind"),
        "condition_id",
        parts[0].alias("degradation"),
        F.regexp_extract(parts[1], r"^S(\d+)$", 1).cast("int").alias("severity"),
        F.col("cer").alias("value"),
    )
    tail = recovered.where("p > 0").select(
        F.lit("recovery").alias("kind"),
        "condition_id",
        parts[0].alias("degradation"),
        F.regexp_extract(parts[1], r"^S(\d+)$", 1).cast("int").alias("severity"),
        F.col("delta_cer").alias("value"),
    )

    def first(rows: DataFrame, n: int | None) -> DataFrame:
        return rows if n is None else rows.orderBy("condition_id").limit(n)

    return first(head, impacts).unionByName(first(tail, recoveries))


def overview_tracks(means: DataFrame, recovered: DataFrame) -> DataFrame:
    """One row per track: number of conditions and its headline metrics, read from the data.

    A track without conditions has a row as well, which says that it is not available.
    """
    track = F.when(F.col("s") == 0, "B0").when(F.col("p") == 0, "B1").otherwise("B2")
    head = means.groupBy(track.alias("track")).agg(
        F.count("*").alias("conditions"),
        F.sum("n").alias("evaluations"),
        mean4("cer").alias("mean_cer"),
        F.max("cer").alias("max_cer"),
        F.countDistinct("d").alias("degradations"),
        F.countDistinct("p").alias("policies"),
    )
    gain = recovered.where("p > 0").agg(F.lit("B2").alias("track"), F.min("delta_cer").alias("best_delta_cer"))
    tracks = means.agg(F.count("*")).select(F.explode(F.array(F.lit("B0"), F.lit("B1"), F.lit("B2"))).alias("track"))
    out = tracks.join(head, "track", "left").join(F.broadcast(gain), "track", "left")
    return out.na.fill(0, ["conditions", "evaluations"]).withColumn("available", F.col("conditions") > 0)


def branch_means(means: DataFrame) -> DataFrame:
    """Mean metrics of the clean, degraded and restored branches."""
    track = F.when(F.col("s") == 0, "b0").when(F.col("p") == 0, "b1").otherwise("b2")
    return means.groupBy(track.alias("branch")).agg(
        F.count("*").alias("count"), *[mean4(m).alias(f"mean_{m}") for m in METRICS]
    )


# Calibration ------------------------------------------------------------------------------------------------


def calibration_means(measured: DataFrame) -> DataFrame:
    """Mean distortion metrics per (family, severity), two decimals."""
    return measured.groupBy("family", "severity").agg(
        F.count("*").alias("n"), *[F.round(F.avg(m), 2).alias(m) for m in ("mse", "mae", "psnr", "mean_drop")]
    )


def calibration_monotonic(means: DataFrame, rules: DataFrame) -> DataFrame:
    """Per family, whether its rule's metric moves one way over severities 1..4.

    ``rules``: (family, metric, direction) with direction 1 for rising and -1 for falling.
    """
    long = means.unpivot(
        ["family", "severity"], ["mse", "mae", "psnr", "mean_drop"], "metric", "value"
    ).where(F.col("severity").between(1, 4))
    w = Window.partitionBy("family", "metric").orderBy("severity")
    steps = long.join(F.broadcast(rules), ["family", "metric"]).withColumn(
        "_ok", F.coalesce((F.col("value") - F.lag("value").over(w)) * F.col("direction") >= 0, F.lit(True))
    )
    return steps.groupBy("family", "metric").agg(F.bool_and("_ok").alias("monotonic"))
