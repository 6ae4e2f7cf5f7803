"""Comparison of two runs over the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.functions import distance as D
from leafscore.functions.scalars import ratio
from leafscore.functions.text import nfc, normalize_text, normalized_words
from leafscore.operators.layout import bound
from leafscore.operators.quantiles import exact_quantiles, with_quantiles


def id_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Document ids present in only one run; must be empty for a valid comparison."""
    left = a.select("document_id").distinct().withColumn("_a", F.lit(True))
    right = b.select("document_id").distinct().withColumn("_b", F.lit(True))
    both = left.join(right, "document_id", "full")
    return both.where("_a IS NULL OR _b IS NULL").select(
        "document_id", F.when(F.col("_a").isNull(), "only_b").otherwise("only_a").alias("side")
    )


def run_compare(pairs: DataFrame, long_texts: bool = True) -> DataFrame:
    """Per document: normalized equality, error rates of run B against run A, token count difference."""
    composed = {f"_{s}": nfc(F.coalesce(f"text_{s}", F.lit(""))) for s in ("a", "b")}
    clean = {f"_{s}t": normalize_text(F.col(f"_{s}"), compose=False) for s in ("a", "b")}
    rows = bound(pairs.withColumns(composed), **clean).drop(*composed)
    rows = bound(rows, **{f"_{s}w": D.word_list(normalized_words(F.col(f"_{s}t")), long_texts) for s in ("a", "b")})
    a, b, aw, bw = (F.col(c) for c in ("_at", "_bt", "_aw", "_bw"))
    rows = rows.withColumns({"_c": D.char_distance(b, a, long_texts), "_w": D.word_distance(b, a, long_texts, (bw, aw))})
    return rows.select(
        "document_id",
        (a == b).alias("exact_text_match"),
        (F.col("tokens_b") - F.col("tokens_a")).alias("token_diff"),
        F.round(D.error_rate(F.col("_c"), F.char_length(b), F.char_length(a)), 4).alias("cer"),
        F.round(D.error_rate(F.col("_w"), F.size(bw), F.size(aw)), 4).alias("wer"),
        F.round(D.similarity(F.col("_c"), F.char_length(b), F.char_length(a)), 4).alias("ned"),
    )


def field_agreement(fields: DataFrame) -> DataFrame:
    """Per (document, field) agreement of normalized values."""
    a, b = normalize_text(F.col("value_a")), normalize_text(F.col("value_b"))
    return fields.select("document_id", "field_name", (a == b).alias("match"))


def field_agreement_rates(agreement: DataFrame) -> DataFrame:
    """Match rate per field and overall (field ``overall``), in one pass over a grouping set."""
    counted = agreement.rollup("field_name").agg(F.count("*").alias("n"), F.count_if("match").alias("matches"))
    return counted.select(
        F.coalesce("field_name", F.lit("overall")).alias("field_name"), "n", "matches",
        ratio(F.col("matches"), F.col("n")).alias("match_rate"),
    )


def run_agreement(compared: DataFrame) -> DataFrame:
    """One row: exact match rate, mean/median/p95 CER, mean WER and NED, summed token difference.

    ``compared`` is read twice, once for its error rates' quantiles: pass a written table if it is dear to derive.
    """
    stats = compared.agg(
        F.count("*").alias("documents"),
        F.count_if("exact_text_match").alias("exact_text_match_count"),
        F.round(F.avg(F.col("exact_text_match").cast("int")), 4).alias("exact_text_match_rate"),
        F.round(F.avg("cer"), 4).alias("mean_cer"),
        F.round(F.avg("wer"), 4).alias("mean_wer"),
        F.round(F.avg("ned"), 4).alias("mean_ned"),
        F.sum("token_diff").alias("token_count_diff_sum"),
    )
    found = exact_quantiles(compared, ["cer"], [0.5, 0.95])
    places = {"median_cer": ("cer", 0), "p95_cer": ("cer", 1)}
    return with_quantiles(stats, found, places, []).withColumns({n: F.round(n, 4) for n in places})


def differing_documents(compared: DataFrame, agreement: DataFrame) -> DataFrame:
    """Only documents whose text or any field differs, with the number of differing fields."""
    fields = agreement.groupBy("document_id").agg(F.count_if(~F.col("match")).alias("field_differences"))
    out = compared.join(fields, "document_id", "left").na.fill(0, ["field_differences"])
    return out.where(~F.col("exact_text_match") | (F.col("field_differences") > 0))
