import pytest
from pyspark.sql import functions as F

from leafscore.operators import matrix as M
from leafscore.operators import robustness as R

MEANS = "condition_id string, d int, s int, p int, cer double, wer double, ned double, f1 double, n int"


def means(spark):
    rows = [("D0_S0_P0", 0, 0, 0, 0.10, 0.2, 0.9, 0.8, 5)]
    for s, cer in zip((1, 2, 3, 4), (0.12, 0.30, 0.28, 0.50)):
        rows.append((f"D1_S{s}_P0", 1, s, 0, cer, cer, 1 - cer, 0.8 - cer / 2, 5))
        rows.append((f"D1_S{s}_P1", 1, s, 1, round(cer - 0.02 * s + 0.03, 4), cer, 1 - cer, 0.8 - cer / 4, 5))
    return spark.createDataFrame(rows, MEANS)


@pytest.mark.parametrize("deg, sev, prep, want", [
    ("none", 0, "none", "D0_S0_P0"), ("Gaussian_Blur ", 2, "p_clahe", "D1_S2_P_clahe"), ("rotation", 4, "", "D6_S4_P0"),
    ("fog", 1, "P_x", "FOG_S1_P_x"), ("shadow", 3, "raw", "D8_S3_P0"), ("shadow", 3, "median", "D8_S3_P_median"),
])
def test_condition_id(one, deg, sev, prep, want):
    assert one(M.condition_id(F.col("d"), F.lit(sev), F.col("p")), d=deg, p=prep) == want


def test_control_delta_is_zero_and_missing_control_is_null(spark):
    got = {r["condition_id"]: r for r in M.delta_from_control(means(spark)).collect()}
    assert got["D0_S0_P0"]["delta_cer"] == 0.0 and got["D1_S4_P0"]["delta_cer"] == 0.4
    bare = M.delta_from_control(means(spark).where("d = 1")).collect()
    assert all(r["delta_cer"] is None for r in bare)


def test_recovery_skips_unmatched(spark):
    m = means(spark)
    assert M.recovery_from_degraded(m, m.where("s < 3")).where("p = 1").count() == 2
    grid = {r["s"]: r for r in M.recovery_grid(m).collect()}
    assert grid[1]["delta_cer"] == 0.01 and grid[1]["relative_recovery"] == -0.5
    assert grid[4]["relative_recovery"] == 0.125


def test_curves(spark):
    jump = M.curve_jump(means(spark)).first()
    assert (jump["max_jump"], jump["inflection_severity"]) == (0.22, 4)
    biggest = M.curve_jump_abs(means(spark)).first()
    assert (biggest["from_severity"], biggest["to_severity"], biggest["cer_change"]) == (3, 4, 0.22)
    mono = M.curve_monotonic(means(spark)).first()
    assert (mono["cer_monotonic"], mono["f1_monotonic"]) == (False, False)


def test_extremes(spark):
    rec = M.recovery_from_degraded(means(spark), means(spark)).where("p > 0")
    by_s = {r["s"]: r for r in M.recovery_extremes(rec).collect()}
    assert by_s[1]["best_cer_policy"] is None and by_s[1]["worst_cer_policy"] == 1
    assert by_s[4]["best_cer_policy"] == 1 and by_s[4]["worst_cer_policy"] is None
    p = M.policy_extremes(rec).first()
    assert (p["positive"], p["negative"], p["best_condition"], p["worst_condition"]) == (2, 0, "D1_S4_P1", None)


def cells(spark, text, family, severity):
    rows = spark.createDataFrame([(text,)], "x string")
    return rows.select(R.degrade_text(F.col("x"), F.lit(family), F.lit(severity), F.lit(77))).first()[0]


@pytest.mark.parametrize("family", [f for f in M.DEGRADATION_CODE if f not in ("none", "control")])
def test_degradations(spark, family):
    text = "\n".join(f"line {i} of the Solid olive bag" for i in range(12))
    assert cells(spark, text, family, 0) == text
    assert cells(spark, text, family, 3) == cells(spark, text, family, 3) != text
    assert cells(spark, "", family, 4) == ""
    if family == "perspective":
        assert text.startswith(cells(spark, text, family, 4))
    if family == "motion_blur":
        assert sorted(cells(spark, text, family, 4)) == sorted(text)


def test_policies(one):
    assert one(R.restore_steps(F.col("x"), []), x="a\x01 b") == "a\x01 b"
    assert one(R.restore_text(F.col("x"), F.lit("p_minimal_cleanup")), x=" a\x01   b ") == "a b"
    assert one(R.restore_text(F.col("x"), F.lit("p_aggressive_binarization")), x="T0tal: #1!") == "total l"
    with pytest.raises(ValueError, match="unknown"):
        R.restore_steps(F.col("x"), ["sharpen"])


def test_records_keep_failures_and_control_scores_zero(spark):
    docs = spark.createDataFrame([(1, "the olive bag is big " * 8), (2, None)], "document_id int, text string")
    named = spark.createDataFrame([("rotation", 1, "none"), ("shadow", 2, "p_minimal_cleanup")], "d string, s int, p string")
    conds = M.condition_matrix(named.select("d"), named.select("s"), named.select("p"))
    assert conds.count() == 1 + 2 * 2 * 2
    rows = R.robustness_records(docs, conds)
    assert rows.count() == 18 and rows.where("status = 'ocr_failed'").count() == 9
    control = rows.where("condition_id = 'D0_S0_P0' AND document_id = 1").first()
    assert (control["cer"], control["wer"], control["ned"]) == (0.0, 0.0, 1.0)
    out = {r["condition_id"]: r for r in R.robustness_summary(rows).collect()}
    assert out["D0_S0_P0"]["delta_cer"] == 0.0 and out["D8_S2_P0"]["status"] == "PARTIAL_FAILURE"
    assert out["D8_S2_P_minimal_cleanup"]["reference_condition_id"] == "D8_S2_P0"


def test_the_summary_covers_the_whole_matrix(spark, tmp_path):
    from leafscore.plans import QUERIES

    turns = [(1, 0, "user", "T0tal of the Solid olive bag: 56.10\nThank you ###"), (1, 1, "assistant", "A second line"), (2, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["condition_id"]: r for r in QUERIES["robustness_summary"](spark, str(tmp_path)).collect()}
    matrix = QUERIES["robustness_matrix"](spark, str(tmp_path)).groupBy("condition_id").count().collect()
    assert {r["condition_id"]: r["count"] for r in matrix} == {k: r["requested"] for k, r in out.items()}
    assert len(out) == 1 + 8 * 4 * (1 + len([p for p in R.POLICIES if p != "none"])) == 161
    restored = out["D8_S4_P_aggressive_binarization"]
    assert (restored["requested"], restored["failed"], restored["reference_condition_id"]) == (3, 1, "D8_S4_P0")
    assert restored["recovery_cer"] == round(restored["cer"] - out["D8_S4_P0"]["cer"], 4) != 0


def by_character(text, family, severity, seed):
    """The families that change characters, one character after the other."""
    if text is None or not severity:
        return text
    out = []
    for i, c in enumerate(text):
        at = i // 2 if family == "motion_blur" else i
        if seed is not None and (abs(at * 7919 + seed) % 1009 if at * 7919 + seed >= 0 else -1) < severity * 60:
            if family == "motion_blur":
                c = text[i ^ 1] if (i ^ 1) < len(text) else c
            elif family == "gaussian_blur":
                c = "e" if c in R.VOWELS else c
            elif family == "gaussian_noise":
                c = c.translate(str.maketrans(R.CONFUSED, R.CONFUSION))
            else:
                c = "" if c == " " else c.lower()
        out.append(c)
    return "".join(out)


ODD_TEXTS = [
    None, "", " ", "a", "\t # a\n", "Äpfel ÉÈ ß ÿ µ Solid OIL bag 0156", "Σίσυφος ΣΑΣ İstanbul Kelvin 字\U0001F600\U00010400 AEIOU", "\x01a\x7f   b­##c\t\t d ",
    "the Solid Olive bag\nis Over THERE " * 40, "".join(chr(c) for c in range(1, 0x250)),
]


def test_characters_change_as_one_by_one(spark):
    rows = [(k, t, f, s, n) for k, t in enumerate(ODD_TEXTS) for f in R.BY_CHARACTER for s in (None, 0, 2, 4) for n in (None, 0, 77, 4_000_000_000, -5_000)]
    df = spark.createDataFrame(rows, "id int, text string, family string, severity int, seed long")
    out = df.withColumn("out", R.degrade_text(F.col("text"), F.col("family"), F.col("severity"), F.col("seed")))
    assert out._jdf.queryExecution().executedPlan().toString().count("transform(") == 1  # for the rare capitals alone
    for r in out.collect():
        assert r.out == by_character(r.text, r.family, r.severity, r.seed), (r.id, r.family, r.severity, r.seed)


def test_policies_take_the_same_steps_in_batches(spark):
    df = spark.createDataFrame([(k, t, p) for k, t in enumerate(ODD_TEXTS) for p in [*R.POLICIES, None, "p_unknown"]], "id int, text string, policy string")
    want = F.when(F.col("policy") == "none", F.col("text"))
    for name, steps in R.POLICIES.items():
        want = want.when(F.col("policy") == name, R.restore_steps(F.col("text"), steps))
    rows = df.select("id", "policy", want.alias("want"), R.restore_text(F.col("text"), F.col("policy")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and sum(r.got is not None for r in rows) == 9 * len(R.POLICIES)
