"""Text and field scoring: recognition error rates, per-field precision/recall, exact match, entity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.functions import distance as D
from leafscore.functions.scalars import harmonic, mean4, ratio
from leafscore.functions.text import has_text, nfc, normalize_amount, normalize_field_text, normalize_text, normalized_words, words
from leafscore.operators.layout import bound


def score_text(pairs: DataFrame, pred: str = "pred", gt: str = "gt", long_texts: bool = True) -> DataFrame:
    """Raw and normalized error rates of each pair over whole texts; adds eight metric columns.

    Every text is normalized and split once and every distance computed once: normalizing usually leaves the words of a
    text as they are, so most rows need one word distance for both.
    """
    raw = {"_p0": F.coalesce(pred, F.lit("")), "_g0": F.coalesce(gt, F.lit(""))}
    out = pairs.withColumns(raw)
    out = out.withColumns({"_pc": nfc(F.col("_p0")), "_gc": nfc(F.col("_g0"))})
    clean = {f"_{s}": normalize_text(F.col(f"_{s}c"), compose=False) for s in "pg"}
    out = bound(out, **clean, **{f"_{s}w0": D.word_list(words(F.col(f"_{s}0")), long_texts) for s in "pg"}).drop("_pc", "_gc")
    out = bound(out, **{f"_{s}w": D.word_list(normalized_words(F.col(f"_{s}")), long_texts) for s in "pg"})
    p0, g0, pw0, gw0 = (F.col(c) for c in ("_p0", "_g0", "_pw0", "_gw0"))
    p, g, pw, gw = (F.col(c) for c in ("_p", "_g", "_pw", "_gw"))
    out = bound(out, _same=(pw == pw0) & (gw == gw0), _clean=(p == p0) & (g == g0))
    own, changed = ~F.col("_same"), ~F.col("_clean")
    out = out.withColumns(
        {
            "_c0": D.char_distance(p0, g0, long_texts),
            "_w0": D.word_distance(p0, g0, long_texts, (pw0, gw0)),
            "_c1": D.char_distance(F.when(changed, p), F.when(changed, g), long_texts),
            "_w1": D.word_distance(
                F.when(own, p), F.when(own, g), long_texts, (F.when(own, pw), F.when(own, gw))),
        }
    )
    sides = {
        "raw": (p0, g0, pw0, gw0, F.col("_c0"), F.col("_w0")),
        "normalized": (
            p, g, pw, gw, F.when(changed, F.col("_c1")).otherwise(F.col("_c0")),
            F.when(own, F.col("_w1")).otherwise(F.col("_w0"))),
    }
    for tag, (a, b, aw, bw, chars, tokens) in sides.items():
        alen, blen = F.char_length(a), F.char_length(b)
        out = out.withColumns(
            {
                f"cer_{tag}": F.round(D.error_rate(chars, alen, blen), 4),
                f"wer_{tag}": F.round(D.error_rate(tokens, F.size(aw), F.size(bw)), 4),
                f"char_ned_{tag}": F.round(D.similarity(chars, alen, blen), 4),
                f"char_edit_distance_{tag}": chars,
            }
        )
    return out.select(*pairs.columns, *[
        f"{m}_{t}" for t in sides for m in ("cer", "wer", "char_ned", "char_edit_distance")])


def field_matches(pairs: DataFrame, compose: bool = True) -> DataFrame:
    """Long pairs ``(document_id, field_name, pred, gt)`` plus match and presence flags, raw and normalized.

    An empty reference matches only an empty prediction.
    """
    out = pairs.withColumns({"pred_raw": F.coalesce("pred", F.lit("")), "gt_raw": F.coalesce("gt", F.lit(""))})
    sides = ("pred", "gt")
    composed = {f"_{s}": nfc(F.col(f"{s}_raw")) if compose else F.col(f"{s}_raw") for s in sides}
    normal = {
        f"{s}_normalized": F.when(F.col("field_name") == "total", normalize_amount(F.col(f"{s}_raw"))).otherwise(
            normalize_field_text(F.col(f"_{s}"), compose=False))
        for s in sides
    }
    out = bound(out.withColumns(composed), **normal).drop(*composed)
    for tag in ("raw", "normalized"):
        a, b = F.col(f"pred_{tag}"), F.col(f"gt_{tag}")
        out = out.withColumns(
            {
                f"match_{tag}": a == b,
                f"has_pred_{tag}": has_text(a),
                f"has_gt_{tag}": has_text(b),
            }
        )
    return out


def score_fields(matches: DataFrame) -> DataFrame:
    """Per document: number of fields, matched fields and exact match, raw and normalized."""
    return matches.groupBy("document_id").agg(
        F.count("*").alias("fields"),
        F.count_if("match_raw").alias("matched_raw"),
        F.count_if("match_normalized").alias("matched_normalized"),
        F.bool_and("match_raw").alias("raw_doc_em"),
        F.bool_and("match_normalized").alias("normalized_doc_em"),
    )


def _counts(tag: str) -> list[Column]:
    has_p, has_g, hit = F.col(f"has_pred_{tag}"), F.col(f"has_gt_{tag}"), F.col(f"match_{tag}")
    return [
        F.count_if(has_p & has_g & hit).alias(f"tp_{tag}"),
        F.count_if(has_p & ~(has_g & hit)).alias(f"fp_{tag}"),
        F.count_if(has_g & ~(has_p & hit)).alias(f"fn_{tag}"),
    ]


def field_prf(matches: DataFrame, keys: list[str] | None = None, f1_from_rounded: bool = False) -> DataFrame:
    """Precision, recall and F1 per field (and per extra key).

    A mismatch of two present values is both a false positive and a false negative. F1 uses the unrounded rates;
    ``f1_from_rounded`` gives the rounded-rate variant that condition summaries use.
    """
    out = matches.groupBy(*(keys or []), "field_name").agg(*_counts("raw"), *_counts("normalized"))
    for tag in ("raw", "normalized"):
        tp, fp, fn = (F.col(f"{k}_{tag}") for k in ("tp", "fp", "fn"))
        digits = 4 if f1_from_rounded else None
        out = out.withColumns(
            {
                f"precision_{tag}": ratio(tp, tp + fp),
                f"recall_{tag}": ratio(tp, tp + fn),
                f"f1_{tag}": harmonic(ratio(tp, tp + fp, digits), ratio(tp, tp + fn, digits)),
            }
        )
    return out


MACRO = [f"{m}_{t}" for t in ("raw", "normalized") for m in ("precision", "recall", "f1")]


def _macro() -> list[Column]:
    return [F.coalesce(mean4(n), F.lit(0.0)).alias(f"macro_{n}") for n in MACRO]


def macro_prf(prf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of the rounded per-field rates."""
    return prf.groupBy(*(keys or [])).agg(*_macro())


def macro_and_entity(prf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro rates and entity scores in one aggregate over the few per-field rows.

    Present predictions are tp + fp and present references tp + fn, so the pairs need no second pass.
    """
    total = lambda *names: F.coalesce(F.sum(sum((F.col(n) for n in names[1:]), F.col(names[0]))), F.lit(0))
    out = prf.groupBy(*(keys or [])).agg(
        *_macro(),
        total("tp_normalized", "fn_normalized").alias("total_gt_entities"),
        total("tp_normalized", "fp_normalized").alias("total_pred_entities"),
        total("tp_normalized").alias("total_matched_entities"),
    )
    return _entity_rates(out)


def doc_em_rate(documents: DataFrame) -> DataFrame:
    """Share of documents with every field right."""
    return documents.agg(
        F.count("*").alias("total_documents"),
        F.count_if("raw_doc_em").alias("raw_doc_em_count"),
        F.count_if("normalized_doc_em").alias("normalized_doc_em_count"),
    ).withColumns(
        {
            "raw_doc_em_rate": ratio(F.col("raw_doc_em_count"), F.col("total_documents")),
            "normalized_doc_em_rate": ratio(F.col("normalized_doc_em_count"), F.col("total_documents")),
        }
    )


def entity_hmean(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and harmonic mean (of the rounded rates) over all present entities."""
    has_p, has_g = F.col("has_pred_normalized"), F.col("has_gt_normalized")
    out = matches.groupBy(*(keys or [])).agg(
        F.count_if(has_g).alias("total_gt_entities"),
        F.count_if(has_p).alias("total_pred_entities"),
        F.count_if(has_p & has_g & F.col("match_normalized")).alias("total_matched_entities"),
    )
    return _entity_rates(out)


def _entity_rates(out: DataFrame) -> DataFrame:
    tp = F.col("total_matched_entities")
    p, r = ratio(tp, F.col("total_pred_entities")), ratio(tp, F.col("total_gt_entities"))
    return out.withColumns({"entity_precision": p, "entity_recall": r, "entity_hmean": harmonic(p, r)})


def pair_with_truth(predictions: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined pairs, predictions without any ground-truth document).

    The second frame must be empty for a valid evaluation; truths without predictions are ignored.
    """
    known = truths.select("document_id").distinct()
    orphans = predictions.join(known, "document_id", "left_anti")
    joined = predictions.join(truths, ["document_id", "field_name"])
    return joined, orphans


def corpus_eval(matches: DataFrame) -> DataFrame:
    """One row with macro rates, exact-match rates and entity scores; zeros for an empty corpus."""
    return macro_and_entity(field_prf(matches)).crossJoin(doc_em_rate(score_fields(matches)))
