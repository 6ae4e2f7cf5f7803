"""Domain tables derived from the star-schema tables, in SQL that Spark and DuckDB both run.

``{table}`` names a source table or another view; ``{g}`` is the extra flag DuckDB's ``regexp_replace`` needs.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from leafscore.operators.layout import PARTS, bound, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "doc_lifecycle": """
SELECT document_id, document_type, status,
  CASE WHEN status = 'completed_automatic' THEN 'automatic'
       WHEN status IN ('manual_review','completed_manual') THEN 'manual_review'
       WHEN status = 'error' AND document_id % 3 = 0 THEN 'rejected' END AS decision,
  CASE WHEN status = 'completed_automatic' THEN 'none'
       WHEN document_id % 7 = 0 THEN 'low_image_quality'
       WHEN document_id % 7 = 1 THEN 'missing_required_field'
       WHEN document_id % 7 = 2 THEN 'invalid_date'
       WHEN document_id % 7 = 3 THEN 'invalid_number'
       WHEN document_id % 11 = 4 THEN NULL
       ELSE 'low_confidence' END AS review_reason,
  CASE WHEN document_id % 50 = 3 THEN NULL ELSE (document_id * 7919 % 1001) / 1000.0E0 END AS confidence,
  created_at,
  CASE WHEN status <> 'processing' THEN created_at + (document_id % 172800) * INTERVAL '1' SECOND END
    AS processing_finished_at,
  CASE WHEN status = 'completed_manual' OR (status = 'manual_review' AND document_id % 2 = 0)
       THEN created_at + (document_id % 172800 + 60) * INTERVAL '1' SECOND END AS review_started_at,
  CASE WHEN status = 'completed_manual'
       THEN created_at + (document_id % 172800 + 600) * INTERVAL '1' SECOND END AS review_finished_at,
  CASE WHEN status <> 'processing' THEN (document_id % 5000) * 1.0E0 END AS processing_duration_ms,
  CASE WHEN status = 'completed_manual' THEN 540000.0E0 END AS review_duration_ms
FROM (SELECT o_orderkey AS document_id, o_orderdate AS created_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'receipt' WHEN 1 THEN 'invoice' WHEN 2 THEN 'act' ELSE 'contract' END
    AS document_type,
  CASE WHEN o_orderkey % 20 = 0 THEN 'error' WHEN o_orderkey % 25 = 1 THEN 'processing'
       WHEN o_orderstatus = 'F' THEN 'completed_automatic'
       WHEN o_orderstatus = 'P' THEN 'completed_manual' ELSE 'manual_review' END AS status
  FROM {orders}) t""",
    "audit_events": """
SELECT event_id, event_id % 3000 AS document_id,
  CASE WHEN event_type = 'click' THEN 'operator:op' ELSE 'system' END AS actor,
  CASE event_type WHEN 'click' THEN 'field_corrected' WHEN 'view' THEN 'decision_evaluated'
       WHEN 'purchase' THEN 'review_completed' WHEN 'signup' THEN 'document_uploaded'
       ELSE 'processing_failed' END AS action,
  CASE WHEN event_type <> 'click' OR event_id % 17 = 0 THEN NULL
       WHEN event_id % 7 IN (0, 1, 2) THEN 'total' WHEN event_id % 7 IN (3, 4) THEN 'company'
       WHEN event_id % 7 = 5 THEN 'date' ELSE 'address' END AS field_name,
  CASE WHEN event_type = 'click' THEN concat('value ', CAST(user_id AS STRING)) END AS new_value,
  CASE WHEN event_type <> 'view' THEN props
       WHEN event_id % 4 = 0 THEN '{"decision":"automatic","reason":"none"}'
       WHEN event_id % 4 = 1 THEN '{"decision":"manual_review","reason":"low_confidence","review_details":{"reasons":[{"code":"low_confidence","field":"total","confidence":0.5,"threshold":0.95,"message":"Total is uncertain."},{"code":"invalid_date","field":"date"}]}}'
       WHEN event_id % 4 = 2 THEN '{"decision":"manual_review","reason":"invalid_number","explanation":"Total is not a number."}'
       ELSE '{"decision":"manual_review","reason":"low_confidence","review_details":{"reasons":["low_field_confidence:company","invalid_date"]}}'
  END AS metadata_json,
  ts AS created_at
FROM {events}""",
    "extracted_fields": """
SELECT l_orderkey AS document_id,
  CASE l_linenumber WHEN 1 THEN 'company' WHEN 2 THEN 'date' WHEN 3 THEN 'address' WHEN 4 THEN 'total'
    WHEN 5 THEN 'tax' WHEN 6 THEN 'cashier' ELSE 'unknown' END AS field_name,
  CAST(l_partkey AS STRING) AS value,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey + l_suppkey % 2 AS STRING) END AS corrected_value,
  CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE (l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 101 / 100.0E0 END
    AS confidence
FROM {lineitem}""",
    "kie_pairs": """
SELECT document_id, field_name,
  CASE WHEN (document_id + f) % 9 = 0 THEN '' WHEN (document_id + f) % 37 = 0 THEN concat(chr(9), chr(10))
       WHEN (document_id + f) % 41 = 0 THEN concat(chr(160), gt, chr(9)) WHEN (document_id + f) % 5 = 0 THEN concat('x', gt)
       WHEN (document_id + f) % 4 = 0 THEN
         CASE WHEN field_name = 'total' THEN concat('RM ', gt) ELSE concat(' "', upper(gt), '",') END
       ELSE gt END AS pred, gt
FROM (SELECT o_orderkey AS document_id, f,
    CASE f WHEN 0 THEN 'company' WHEN 1 THEN 'date' WHEN 2 THEN 'address' ELSE 'total' END AS field_name,
    CASE f WHEN 0 THEN c_name
      WHEN 1 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',
        lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))
      WHEN 2 THEN CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN chr(160) ELSE concat('JALAN ', CAST(o_custkey AS STRING), ', ', n_name) END
      ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS gt
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ff) t""",
    "receipt_tokens": """
SELECT document_id, idx, text, idx * 12.0E0 AS y_min FROM (SELECT o_orderkey AS document_id, idx,
    CASE idx WHEN 0 THEN concat(upper(c_mktsegment), ' SDN BHD')
      WHEN 1 THEN concat('NO. ', CAST(o_custkey AS STRING), ' JALAN ', n_name)
      WHEN 2 THEN concat('TEL ', CAST(o_custkey AS STRING))
      WHEN 3 THEN concat('DATE ', CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/',
        CAST(year(o_orderdate) AS STRING))
      WHEN 4 THEN concat('SUBTOTAL ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING))
      WHEN 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'GRAND TOTAL' ELSE 'CASH 100.00' END
      ELSE concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'TOTAL RM' END,
        CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)) END AS text
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
    UNION ALL SELECT 5 UNION ALL SELECT 6) ii) t""",
    # Recognized tokens with confidences; some are missing and some are not numbers.
    "page_tokens": """
SELECT document_id, idx, text, idx % 3 * 40.0E0 AS x_min, (6 - idx) * 12.0E0 + document_id % 5 AS y_min,
  CASE WHEN (document_id + idx) % 19 = 0 THEN NULL WHEN (document_id + idx) % 23 = 0 THEN 'n/a'
       ELSE CAST((document_id * 13 + idx * 29) % 101 / 100.0E0 AS STRING) END AS confidence
FROM {receipt_tokens}""",
    # Whole documents with their lines: every character outside ASCII is folded to one '?', so lengths are kept.
    "ocr_pairs": """
SELECT doc_id AS document_id, gt,
  CASE WHEN doc_id % 10 = 0 THEN gt WHEN doc_id % 10 = 1 THEN ''
       WHEN doc_id % 10 < 6 THEN replace(replace(gt, 'e', 'c'), 'l', '1')
       ELSE replace(gt, 'th', '') END AS pred
FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n\t]', '?'{g}) AS gt FROM {documents}) t""",
    "quality_measures": """
SELECT p_partkey AS document_id, (p_partkey * 37 % 2500) / 10.0E0 AS blur_score,
  (p_partkey * 13 % 700) / 10.0E0 AS contrast_score, (p_partkey * 7 % 300) / 10.0E0 AS noise_score,
  (p_partkey * 11 % 240 - 120) / 10.0E0 AS rotation_angle
FROM {part}""",
    # Documents with the columns listings use, and quality scores per document.
    "filed_documents": """
SELECT *, concat('scan-', document_type, '-', CAST(document_id AS STRING), '.PDF') AS filename,
  coalesce(review_finished_at, processing_finished_at, created_at) AS updated_at
FROM {doc_lifecycle}""",
    "document_quality": """
SELECT document_id, (document_id * 37 % 101) / 100.0E0 AS quality_score FROM {quality_measures}""",
    "run_records": """
SELECT concat('D', CAST(d AS STRING), '_S', CAST(s AS STRING), '_P', CAST(p AS STRING)) AS condition_id, d, s, p,
  doc_id AS document_id,
  CASE WHEN (doc_id * 31 + d * 7 + s) % 97 = 0 THEN 'ocr_failed' ELSE 'success' END AS status,
  ((doc_id * 17 + d * 5) % 40 + s * (d % 4 + 1) * 3 - p * 2 + 10) / 100.0E0 AS cer,
  ((doc_id * 13 + d * 3 + s + p) % 5) / 4.0E0 AS macro_match
FROM {documents}
CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
  UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) dd
CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ss
CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) pp
UNION ALL
SELECT 'D0_S0_P0', 0, 0, 0, doc_id, 'success', (doc_id * 17 % 40 + 10) / 100.0E0, (doc_id * 13 % 5) / 4.0E0
FROM {documents}""",
    # Per-condition means, the form statistics over curves and recoveries start from; summed as integers, so that
    # row order cannot tip a rounding.
    "condition_means": """
SELECT condition_id, d, s, p, cer, wer, ROUND(1 - cer, 4) AS ned, f1, n FROM (
  SELECT condition_id, d, s, p, n, FLOOR((200 * hundredths + n) / (2.0E0 * n)) / 10000.0E0 AS cer,
    FLOOR((250 * hundredths + n) / (2.0E0 * n)) / 10000.0E0 AS wer, FLOOR((5000 * quarters + n) / (2.0E0 * n)) / 10000.0E0 AS f1
  FROM (SELECT condition_id, d, s, p, COUNT(*) AS n, SUM(CAST(ROUND(cer * 100) AS BIGINT)) AS hundredths,
      SUM(CAST(ROUND(macro_match * 4) AS BIGINT)) AS quarters
    FROM {run_records} WHERE status = 'success' GROUP BY condition_id, d, s, p) c) m""",
    # The same with the degradation and clean-up policy spelled out.
    "named_conditions": """
SELECT *, CASE d WHEN 0 THEN 'none' WHEN 1 THEN 'gaussian_blur' WHEN 2 THEN 'motion_blur' WHEN 3 THEN 'gaussian_noise'
    WHEN 4 THEN 'jpeg_compression' WHEN 5 THEN 'downsampling' WHEN 6 THEN 'rotation' WHEN 7 THEN 'perspective'
    ELSE 'shadow' END AS degradation,
  CASE p WHEN 0 THEN 'none' WHEN 1 THEN 'p_minimal_cleanup' WHEN 2 THEN 'p_contrast_enhancement'
    WHEN 3 THEN 'p_standard_receipt_enhancement' ELSE 'p_aggressive_binarization' END AS preprocessing,
  CASE WHEN s = 0 THEN 'B0' WHEN p = 0 THEN 'B1' ELSE 'B2' END AS baseline_type
FROM {condition_means}""",
    # Field pairs of a run: the condition is a property of the document.
    "condition_fields": """
SELECT concat('D', CAST(document_id % 8 + 1 AS STRING), '_S', CAST(document_id % 4 + 1 AS STRING), '_P0') AS condition_id,
  document_id, field_name, pred, gt FROM {kie_pairs}""",
    # Distortion of one array against another, by family and severity.
    "calibration_pairs": """
SELECT vec_id, concat('F', CAST(label % 8 AS STRING)) AS family, CAST(vec_id % 4 + 1 AS INT) AS severity, embedding
FROM {embeddings}""",
    "processing_jobs": """
SELECT event_id AS job_id, event_id % 3000 AS document_id,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'retrying'
       WHEN 'signup' THEN 'running' ELSE 'failed' END AS status,
  user_id % 5 AS priority, CASE WHEN event_type = 'error' THEN concat('failure ', props) END AS error_message,
  ts AS created_at
FROM {events}""",
    # Field values as an operator sees them in review: recognized value, optional correction, confidence.
    "review_fields": """
SELECT document_id, field_name, CASE WHEN (document_id * 7 + length(field_name)) % 29 <> 0 THEN pred END AS value,
  CASE WHEN (document_id + length(field_name)) % 6 = 0 THEN gt END AS corrected_value,
  0.7E0 + (document_id * 31 + length(field_name) * 17) % 31 / 100.0E0 AS confidence
FROM {kie_pairs}""",
    "corpus_files": """
SELECT split, kind, stem, CASE WHEN doc_id % 211 = 7 THEN 0 ELSE n_chars END AS size FROM (
  SELECT doc_id, n_chars, concat('doc', CAST(doc_id AS STRING)) AS stem,
    CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'img' AS kind
    FROM {documents} WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, n_chars, concat('doc', CAST(doc_id AS STRING)),
    CASE WHEN doc_id % 5 = 0 OR doc_id % 97 = 1 THEN 'test' ELSE 'train' END, 'box'
    FROM {documents} WHERE doc_id % 13 <> 0
  UNION ALL SELECT d.doc_id, n_chars, concat('doc', CAST(d.doc_id AS STRING)),
    CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END, 'entities'
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) t""",
    "box_lines": """
SELECT document_id, idx AS line_no,
  CASE WHEN (document_id + idx) % 31 = 0 THEN concat('10,20,30,', text)
       WHEN (document_id + idx) % 37 = 0 THEN concat('1,2,x,4,5,6,7,8,', text)
       WHEN (document_id + idx) % 41 = 0 THEN concat('1,2,3,4,5,6,7,8,9,10,', text)
       WHEN (document_id + idx) % 43 = 0 THEN '  '
       ELSE concat(CAST(document_id % 90 - 5 AS STRING), ',', CAST(idx * 12 AS STRING), ',120,',
         CAST(idx * 12 AS STRING), ',120,', CAST(idx * 12 + 10 AS STRING), ',', CAST(document_id % 90 - 5 AS STRING),
         ',', CAST(idx * 12 + 10 AS STRING), ',', text, CASE WHEN document_id % 3 = 0 THEN ', SDN' ELSE '' END) END AS line
FROM {receipt_tokens}""",
    "entity_files": """
SELECT o_orderkey AS document_id,
  CASE WHEN o_orderkey % 17 = 0 THEN '{"company": "BROKEN"'
       WHEN o_orderkey % 19 = 0 THEN concat('{"company":"', c_name, '","date":"01/02/2019"}')
       WHEN o_orderkey % 23 = 0 THEN concat('{"company":"', c_name, '","date":"01/02/2019","address":"NO. 1","total":12.5}')
       WHEN o_orderkey % 27 = 0 THEN '["list"]'
       ELSE concat('{"company":"', c_name, '","date":"01/02/2019","address":"NO. 1","total":"',
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '","cashier":"C1"}') END AS body
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # Two runs over the same documents, for run comparison.
    "run_pairs": """
SELECT doc_id AS document_id, gt AS text_a,
  CASE WHEN doc_id % 3 = 0 THEN replace(gt, 'the', 'tho') WHEN doc_id % 7 = 0 THEN concat(gt, ' x') ELSE gt END AS text_b,
  doc_id % 20 AS tokens_a, doc_id % 20 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS tokens_b,
  200.0E0 + doc_id * 37 % 400 AS ms_a, 60.0E0 + doc_id * 53 % 150 AS ms_b
FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n\t]', '?'{g}) AS gt FROM {documents}) t""",
    "run_fields": """
SELECT document_id, field_name, gt AS value_a, CASE WHEN document_id % 8 = 0 THEN pred ELSE gt END AS value_b
FROM {kie_pairs}""",
    # Configuration entries per part, one of them volatile.
    "config_entries": """
SELECT p_partkey AS config_id, CASE k WHEN 0 THEN 'name' WHEN 1 THEN 'brand' WHEN 2 THEN 'size' ELSE 'timestamp' END AS key,
  CASE k WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN CAST(p_size AS STRING) ELSE CAST(p_retailprice AS STRING) END AS value
FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) kk""",
    # Short texts for the full robustness matrix.
    "turns": """
SELECT conv_id * 1000 + turn AS document_id, text FROM {conversations}""",
    "question_updates": """
SELECT conv_id AS question_id, turn AS seq,
  CASE turn % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'EXPERIMENT_AVAILABLE' ELSE 'CLOSED' END AS status,
  CASE WHEN role = 'user' THEN trim(text) END AS title,
  CASE conv_id % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'date' WHEN 2 THEN 'company' END AS field,
  CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN '[{"track":"B1","b1_experiment_id":"D1"},{"experiment_id":"D6"}]'
       WHEN turn = 0 AND conv_id % 3 = 0 THEN '[{"experiment_id":"D99"}]' END AS refs_json
FROM {conversations}""",
}

# Views whose rows are costly to derive or to use: their driving table is dealt into small parts.
SPREAD = {"kie_pairs": ("orders", "o_orderkey"), "receipt_tokens": ("orders", "o_orderkey"), "run_records": ("documents", "doc_id")}
# Views whose columns take long expressions: each is computed once per row, however often a query uses it.
BOUND = {"kie_pairs", "receipt_tokens"}

_NAME = re.compile(r"\{(\w+)\}")


def depends(name: str) -> list[str]:
    """Names a view is built from."""
    found = dict.fromkeys(n for n in _NAME.findall(VIEWS[name]) if n != "g")
    return list(found)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table or a domain view as a lazy DataFrame; Catalyst prunes what a query does not use."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: load(spark, sf_dir, n) for n in depends(name)}
    if name in SPREAD:
        table, key = SPREAD[name]
        inputs[table] = spread(inputs[table], key, parts=PARTS)
    sql = VIEWS[name].replace("{g}", "")
    # JSON literals hold braces that are not names; the formatter only sees real ones.
    keep = _NAME.sub(lambda m: f"\0{m.group(1)}\1", sql).replace("{", "{{").replace("}", "}}")
    rows = spark.sql(keep.replace("\0", "{").replace("\1", "}"), **inputs)
    return bound(rows) if name in BOUND else rows


@cache
def _ordered(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in out:
            for inner in depends(name):
                visit(inner)
            out.append(name)

    for name in names:
        visit(name)
    return tuple(out)


def duckdb_sql(body: str) -> str:
    """The body with every ``{view}`` it names prepended as a common table expression."""
    names = _ordered(tuple(dict.fromkeys(n for n in _NAME.findall(body) if n in VIEWS or n in TABLES)))
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names]
    start = re.match(r"\s*WITH (RECURSIVE )?", body)
    if not ctes:
        sql = body
    elif start:
        sql = f"WITH {start[1] or ''}{', '.join(ctes)}, {body[start.end():]}"
    else:
        sql = f"WITH {', '.join(ctes)} {body}"

    def known(m: re.Match) -> str:
        name = m.group(1)
        return ", 'g'" if name == "g" else name if name in VIEWS or name in TABLES else m.group(0)

    return _NAME.sub(known, sql)
