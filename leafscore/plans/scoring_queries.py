"""Queries over text and field scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.functions import distance as D
from leafscore.functions.text import normalize_amount, normalize_field_text, normalize_text
from leafscore.operators import scoring as S
from leafscore.operators.layout import spread
from leafscore.plans.registry import SPACE, query, strip_sql

# DuckDB forms of the normalizers, for ASCII field values.
EDGE = """' ''"`:,.;#~!?*[](){}'"""


def text_sql(x: str) -> str:
    kept = f"regexp_replace(nfc_normalize({x}), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]|\\p{{Cf}}|\\p{{Co}}', '', 'g')"
    return f"trim(regexp_replace({kept}, '[\\p{{Z}}\\n\\r\\t]+', ' ', 'g'))"


def field_text_sql(x: str) -> str:
    return f"trim({text_sql(f'lower({x})')}, {EDGE})"


def amount_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace({strip_sql(x)}, '^(RM|MYR|[$]|{SPACE})+', '', 'i'), '(RM|MYR|[$]|{SPACE})+$', '', 'i')"
    whole = f"regexp_extract({s}, '(\\d+)(\\.(\\d+))?', 1)"
    cents = f"regexp_extract({s}, '(\\d+)(\\.(\\d+))?', 3)"
    return f"CASE WHEN {whole} = '' THEN lower({s}) ELSE concat({whole}, '.', rpad({cents}, 2, '0')) END"


def field_sql(name: str, x: str) -> str:
    return f"CASE WHEN {name} = 'total' THEN {amount_sql(x)} ELSE {field_text_sql(x)} END"


def error_rate_sql(dist: str, plen: str, glen: str) -> str:
    return f"CASE WHEN {glen} = 0 AND {plen} = 0 THEN 0.0E0 WHEN {glen} = 0 THEN 1.0E0 ELSE {dist} / {glen}::DOUBLE END"


def similarity_sql(dist: str, plen: str, glen: str) -> str:
    return (f"CASE WHEN {glen} = 0 AND {plen} = 0 THEN 1.0E0 WHEN {glen} = 0 OR {plen} = 0 THEN 0.0E0 "
            f"ELSE greatest(0.0E0, 1 - {dist} / greatest({glen}, {plen})::DOUBLE) END")


def words_sql(x: str) -> str:
    return f"CASE WHEN {strip_sql(x)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({strip_sql(x)}, '{SPACE}+') END"


def folded(x: str) -> str:
    """DuckDB's distance counts bytes: other characters become one byte that the data does not hold."""
    return f"regexp_replace({x}, '[^\\x01-\\x7e]', '~', 'g')"


MATCHES = f"""
WITH m AS (SELECT document_id, field_name, pred AS pr, gt AS gr, {field_sql('field_name', 'pred')} AS pn,
    {field_sql('field_name', 'gt')} AS gn FROM {{kie_pairs}}),
 f AS (SELECT document_id, field_name, pr, gr, pn, gn, pr = gr AS mr, pn = gn AS mn,
    {strip_sql('pr')} <> '' AS hpr, {strip_sql('gr')} <> '' AS hgr, {strip_sql('pn')} <> '' AS hpn, {strip_sql('gn')} <> '' AS hgn FROM m)"""

PRF_COUNTS = """
    count(*) FILTER (hpr AND hgr AND mr) AS tp_raw, count(*) FILTER (hpr AND NOT (hgr AND mr)) AS fp_raw,
    count(*) FILTER (hgr AND NOT (hpr AND mr)) AS fn_raw,
    count(*) FILTER (hpn AND hgn AND mn) AS tp_normalized,
    count(*) FILTER (hpn AND NOT (hgn AND mn)) AS fp_normalized,
    count(*) FILTER (hgn AND NOT (hpn AND mn)) AS fn_normalized"""


def ratio_sql(a: str, b: str, digits: int | None = 4) -> str:
    value = f"({a}) / ({b})::DOUBLE"
    return f"CASE WHEN ({b}) > 0 THEN {value if digits is None else f'round({value}, {digits})'} ELSE 0.0E0 END"


def harmonic_sql(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN round(2.0E0 * ({p}) * ({r}) / (({p}) + ({r})), 4) ELSE 0.0E0 END"


def prf_sql(tag: str, rounded: bool = False) -> str:
    tp, fp, fn = f"tp_{tag}", f"fp_{tag}", f"fn_{tag}"
    d = 4 if rounded else None
    f1 = harmonic_sql(ratio_sql(tp, f"{tp}+{fp}", d), ratio_sql(tp, f"{tp}+{fn}", d))
    return (f"{ratio_sql(tp, f'{tp}+{fp}')} AS precision_{tag}, {ratio_sql(tp, f'{tp}+{fn}')} AS recall_{tag}, "
            f"{f1} AS f1_{tag}")


PRF = MATCHES + f""", c AS (SELECT field_name, {PRF_COUNTS} FROM f GROUP BY field_name),
 prf AS (SELECT *, {prf_sql('raw')}, {prf_sql('normalized')} FROM c)"""
def mean_sql(x: str) -> str:
    """Mean of four-decimal values rounded half away from zero in integers."""
    total = f"sum(CAST(round({x} * 10000) AS BIGINT))"
    return f"sign({total}) * ((2 * abs({total}) + count({x})) // (2 * count({x}))) / 10000.0E0"


MACRO = ", ".join(
    f"{mean_sql(f'{m}_{t}')} AS macro_{m}_{t}" for t in ("raw", "normalized") for m in ("precision", "recall", "f1"))
DOC_EM = """d AS (SELECT document_id, bool_and(mr) AS raw_doc_em, bool_and(mn) AS normalized_doc_em FROM f GROUP BY document_id)"""
DOC_EM_RATE = f"""e AS (SELECT *, {ratio_sql('raw_doc_em_count', 'total_documents')} AS raw_doc_em_rate,
    {ratio_sql('normalized_doc_em_count', 'total_documents')} AS normalized_doc_em_rate FROM (
    SELECT count(*) AS total_documents, count(*) FILTER (raw_doc_em) AS raw_doc_em_count,
      count(*) FILTER (normalized_doc_em) AS normalized_doc_em_count FROM d))"""
ENTITY = f"""h AS (SELECT *, {harmonic_sql('entity_precision', 'entity_recall')} AS entity_hmean FROM (
    SELECT *, {ratio_sql('total_matched_entities', 'total_pred_entities')} AS entity_precision,
      {ratio_sql('total_matched_entities', 'total_gt_entities')} AS entity_recall FROM (
      SELECT count(*) FILTER (hgn) AS total_gt_entities, count(*) FILTER (hpn) AS total_pred_entities,
        count(*) FILTER (hpn AND hgn AND mn) AS total_matched_entities FROM f)))"""


@query("edit_distance", "SELECT document_id, levenshtein(pred, gt) AS char_distance FROM {ocr_pairs}")
def _(t):
    """Whole documents, folded to ASCII because the oracle counts bytes."""
    return spread(t.ocr_pairs, "document_id").select(
        "document_id", D.char_distance(F.col("pred"), F.col("gt")).cast("long").alias("char_distance"))


@query("cer", f"""SELECT document_id, field_name,
    {error_rate_sql(f"levenshtein({folded('pred')}, {folded('gt')})", 'length(pred)', 'length(gt)')} AS cer FROM {{kie_pairs}}""")
def _(t):
    return t.kie_pairs.select(
        "document_id", "field_name", D.cer(F.col("pred"), F.col("gt"), long_texts=False).alias("cer"))


@query("char_ned", f"""SELECT document_id, field_name,
    {similarity_sql(f"levenshtein({folded('pred')}, {folded('gt')})", 'length(pred)', 'length(gt)')} AS char_ned FROM {{kie_pairs}}""")
def _(t):
    return t.kie_pairs.select(
        "document_id", "field_name", D.char_ned(F.col("pred"), F.col("gt"), long_texts=False).alias("char_ned"))


_CODES = "array_to_string(list_transform({w}, lambda x: chr((40 + list_position(dict, x))::INT)), '')"


@query("wer", f"""WITH w AS (SELECT document_id, field_name, {words_sql('pred')} AS wp, {words_sql('gt')} AS wg
    FROM {{kie_pairs}}), c AS (SELECT *, list_concat(wp, wg) AS dict FROM w)
    SELECT document_id, field_name, {error_rate_sql(
        f"levenshtein({_CODES.format(w='wp')}, {_CODES.format(w='wg')})", 'len(wp)', 'len(wg)')} AS wer FROM c""")
def _(t):
    return t.kie_pairs.select(
        "document_id", "field_name", D.wer(F.col("pred"), F.col("gt"), long_texts=False).alias("wer"))


def document_pairs(t):
    """Whole documents in their original characters against a deterministic misreading of each."""
    docs = t.documents.select(
        F.col("doc_id").alias("document_id"),
        "lang",
        F.col("text").alias("gt"),
        F.when(F.col("doc_id") % 10 == 0, F.col("text"))
        .when(F.col("doc_id") % 10 == 1, F.lit(""))
        .when(F.col("doc_id") % 10 < 6, F.translate("text", "el", "c1"))
        .otherwise(F.replace("text", F.lit("th"), F.lit(""))).alias("pred"),
    )
    return spread(docs, "document_id")


@query("score_text")
def _(t):
    """Checked against brute force in the tests: the oracle's distance counts bytes and has no word form."""
    return S.score_text(document_pairs(t)).drop("pred", "gt", "lang")


@query("normalize_text", f"SELECT doc_id, {text_sql('text')} AS text FROM {{documents}}")
def _(t):
    return t.documents.select("doc_id", normalize_text(F.col("text")).alias("text"))


@query("normalize_field_text", f"SELECT document_id, field_name, {field_text_sql('pred')} AS value FROM {{kie_pairs}}")
def _(t):
    return t.kie_pairs.select("document_id", "field_name", normalize_field_text(F.col("pred")).alias("value"))


@query("normalize_amount", f"SELECT document_id, field_name, {amount_sql('pred')} AS value FROM {{kie_pairs}}")
def _(t):
    return t.kie_pairs.select("document_id", "field_name", normalize_amount(F.col("pred")).alias("value"))


@query("normalize_field", f"SELECT document_id, field_name, {field_sql('field_name', 'pred')} AS value FROM {{kie_pairs}}")
def _(t):
    from leafscore.functions.text import normalize_field

    return t.kie_pairs.select(
        "document_id", "field_name", normalize_field(F.col("field_name"), F.col("pred")).alias("value"))


@query("score_fields", MATCHES + """
SELECT document_id, count(*) AS fields, count(*) FILTER (mr) AS matched_raw, count(*) FILTER (mn) AS matched_normalized,
  bool_and(mr) AS raw_doc_em, bool_and(mn) AS normalized_doc_em FROM f GROUP BY document_id""")
def _(t):
    return S.score_fields(S.field_matches(t.kie_pairs))


@query("field_prf", PRF + " SELECT * FROM prf")
def _(t):
    return S.field_prf(S.field_matches(t.kie_pairs))


@query("macro_prf", PRF + f" SELECT {MACRO} FROM prf")
def _(t):
    return S.macro_prf(S.field_prf(S.field_matches(t.kie_pairs)))


@query("doc_em_rate", MATCHES + f", {DOC_EM}, {DOC_EM_RATE} SELECT * FROM e")
def _(t):
    return S.doc_em_rate(S.score_fields(S.field_matches(t.kie_pairs)))


@query("entity_hmean", MATCHES + f", {ENTITY} SELECT * FROM h")
def _(t):
    return S.entity_hmean(S.field_matches(t.kie_pairs))


@query("corpus_eval", PRF + f", {DOC_EM}, {DOC_EM_RATE}, {ENTITY}, m2 AS (SELECT {MACRO} FROM prf) SELECT * FROM m2, e, h")
def _(t):
    return S.corpus_eval(S.field_matches(t.kie_pairs))


@query("pred_gt_join", """
SELECT 'joined' AS part, count(*) AS n FROM (SELECT document_id, field_name FROM {review_fields}) p
  JOIN {kie_pairs} g USING (document_id, field_name)
UNION ALL SELECT 'orphans', count(*) FROM {extracted_fields} p
  WHERE document_id NOT IN (SELECT document_id FROM {kie_pairs})""")
def _(t):
    truths = t.kie_pairs.select("document_id", "field_name", "gt")
    joined, _none = S.pair_with_truth(t.review_fields.select("document_id", "field_name", "value"), truths)
    _joined, orphans = S.pair_with_truth(t.extracted_fields.select("document_id", "field_name"), truths)
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(joined, "joined").unionByName(count(orphans, "orphans"))
