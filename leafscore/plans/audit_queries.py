"""Queries over corpus audits, run comparison, sampling and the text robustness workload."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.operators import audit as A
from leafscore.operators import compare as C
from leafscore.operators import matrix as M
from leafscore.operators import robustness as R
from leafscore.operators import sampling as P
from leafscore.operators.canonical import nested_config_hash
from leafscore.operators.layout import spread
from leafscore.operators.records import schema_checks
from leafscore.plans.matrix_queries import configured
from leafscore.plans.registry import query
from leafscore.plans.scoring_queries import text_sql
from leafscore.session import shared_dir
from leafscore.sources import corpus

LINES = """pt AS (SELECT document_id, line_no, string_split(line, ',') AS p FROM {box_lines} WHERE trim(line) <> ''),
  pc AS (SELECT *, list_transform(p[1:8], lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS c FROM pt),
  bl AS (SELECT document_id, line_no, p, c, CASE WHEN len(p) < 9 THEN 'too_few_parts' WHEN len(list_filter(c, lambda x: x IS NULL)) > 0 THEN 'non_numeric'
      WHEN len(p) >= 11 AND TRY_CAST(trim(p[9]) AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(p[10]) AS DOUBLE) IS NOT NULL THEN 'extra_coordinates' END AS reason FROM pc),
  bp AS (SELECT document_id, line_no, reason, CASE WHEN reason IS NULL THEN array_to_string(p[9:], ',') END AS transcript,
    CASE WHEN reason IS NULL THEN least(c[1], c[3], c[5], c[7]) END AS x_min, CASE WHEN reason IS NULL THEN least(c[2], c[4], c[6], c[8]) END AS y_min,
    CASE WHEN reason IS NULL THEN greatest(c[1], c[3], c[5], c[7]) END AS x_max, CASE WHEN reason IS NULL THEN greatest(c[2], c[4], c[6], c[8]) END AS y_max FROM bl)"""


@query("read_box_lines", f"WITH {LINES} SELECT * FROM bp")
def _(t):
    return A.parse_box_lines(t.box_lines)


ENT = """en AS (SELECT document_id, body, CASE WHEN NOT json_valid(body) THEN 'malformed_json' WHEN json_type(body) <> 'OBJECT' THEN 'not_an_object'
    WHEN json_type(body, '$.company') IS NULL OR json_type(body, '$.date') IS NULL OR json_type(body, '$.address') IS NULL OR json_type(body, '$.total') IS NULL THEN 'missing_keys'
    WHEN NOT (json_type(body, '$.company') = 'VARCHAR' AND json_type(body, '$.date') = 'VARCHAR' AND json_type(body, '$.address') = 'VARCHAR' AND json_type(body, '$.total') = 'VARCHAR') THEN 'not_a_string' END AS reason
  FROM {entity_files}),
  ep AS (SELECT document_id, reason, CASE WHEN reason IS NULL THEN body ->> '$.company' END AS company, CASE WHEN reason IS NULL THEN body ->> '$.date' END AS date,
    CASE WHEN reason IS NULL THEN body ->> '$.address' END AS address, CASE WHEN reason IS NULL THEN body ->> '$.total' END AS total,
    CASE WHEN reason IS NULL THEN '{"cashier":"C1"}' END AS metadata FROM en)"""


@query("read_entities", f"WITH {ENT} SELECT * FROM ep")
def _(t):
    return A.parse_entities(t.entity_files)


# The files of the corpus as a real tree: every tenth name in capitals, next to files that are no part of it.
NAMED = """concat(stem, CASE kind WHEN 'img' THEN CASE WHEN size % 10 = 3 THEN '.PNG' ELSE '.jpg' END WHEN 'box' THEN '.txt' ELSE '.json' END)"""


@query("read_corpus_index", f"""WITH f AS (SELECT split, stem, kind, concat(split, '/', kind, '/', {NAMED}) AS path FROM {{corpus_files}})
  SELECT split, stem, max(path) FILTER (kind = 'img') AS img_path, max(path) FILTER (kind = 'box') AS box_path,
    max(path) FILTER (kind = 'entities') AS entities_path,
    bool_or(kind = 'img') OR split NOT IN (SELECT split FROM f WHERE kind = 'img') AS is_document FROM f GROUP BY split, stem""")
def _(t):
    root = shared_dir(t.spark, "corpus-tree")
    files = t.corpus_files.select("split", "kind", F.expr(NAMED).alias("name"), "size")
    others = files.where("size % 50 = 1").select("split", "kind", F.concat(F.lit("."), "name").alias("name"), F.lit(1).alias("size"))
    corpus.write_corpus_tree(files.unionByName(others), root)
    index = corpus.read_corpus_index(t.spark, root)
    inner = lambda c: F.regexp_extract(c, r"((train|test)/(img|box|entities)/[^/]+)$", 1)
    return index.withColumns({c: F.when(F.col(c).isNotNull(), inner(c)) for c in ("img_path", "box_path", "entities_path")})


@query("read_corpus_files", "SELECT split, kind, stem, size FROM {corpus_files}")
def _(t):
    """Sizes as listed, zero-length files among them."""
    root = shared_dir(t.spark, "corpus-sizes")
    corpus.write_corpus_tree(t.corpus_files.select("split", "kind", F.expr(NAMED).alias("name"), "size"), root)
    return corpus.read_corpus_files(t.spark, root)


CHECKS = """ck AS (SELECT document_id, idx, array_to_string(list_filter([CASE WHEN confidence IS NOT NULL AND TRY_CAST(confidence AS DOUBLE) IS NULL THEN 'confidence_not_a_number' END,
    CASE WHEN TRY_CAST(confidence AS DOUBLE) * 1.1E0 > 1 THEN 'confidence_out_of_range' END, CASE WHEN document_id % 37 = 0 THEN 'box_inverted' END], lambda x: x IS NOT NULL), ',') AS violations FROM {page_tokens})"""


@query("record_checks", f"WITH {CHECKS} SELECT * FROM ck")
def _(t):
    """Confidences are stretched by a tenth and every 37th box is inverted, so that checks have something to find."""
    number = F.col("confidence").try_cast("double") * 1.1
    rows = t.page_tokens.select(
        "document_id", "idx", F.coalesce(number.cast("string"), F.col("confidence")).alias("confidence"), "x_min", "y_min",
        (F.col("x_min") + F.when(F.col("document_id") % 37 == 0, -5.0).otherwise(35.0)).alias("x_max"), (F.col("y_min") + 10).alias("y_max"))
    return A.record_checks(rows).select("document_id", "idx", F.array_join("violations", ",").alias("violations"))


def _bodies(kind):
    """A JSON record per document, as a Spark expression; every so many have a fault of one sort."""
    def fault(n, bad, good, rest=0):
        return f"CASE WHEN doc_id % {n} = {rest} THEN '{bad}' ELSE {good} END"

    name = "concat('\"doc', CAST(doc_id AS STRING), '\"')"
    box = f"""'{{"x_min":', {fault(47, 'true', "'0'")}, ',"y_min":0.5,"x_max":', {fault(53, '-1', "'10'")}, ',"y_max":5}}'"""
    token = f"""'{{"text":"w","bbox":', {box}, ',"confidence":', {fault(59, '1.5', "'0.5'")}, '}}'"""
    return {
        "recognition": f"""concat('{{"document_id":', {fault(41, '"  "', name)}, ',"full_text":', {fault(43, '5', name)}, ',"tokens":[', {token},
            '],"processing_time_ms":', {fault(61, '-1', "CAST(n_chars AS STRING)")}, '}}')""",
        "extraction": f"""concat('{{"document_id":', {name}, ',"fields":', {fault(31, '[]', "'{}'")}, ',"confidences":{{"date":1,"total":', {fault(37, 'false', "'0.5'")}, '}}}}')""",
        "document": f"""concat('{{"document_id":', {name}, {fault(67, '', "',\"image_path\":\"p\"'")}, ',"width":', CASE WHEN doc_id % 71 = 1 THEN '5.5' ELSE {fault(71, 'true', "CAST(n_chars + 1 AS STRING)")} END,
            ',"height":', {fault(73, '0', "'7'")}, ',"split":', {fault(79, '"dev"', "'\"train\"'")}, '}}')""",
        "experiment": f"""concat('{{"experiment_id":"e","document_id":', {name}, ',"degradation":{{"type":"blur","severity":', CASE WHEN doc_id % 83 = 1 THEN 'true' ELSE {fault(83, '5', "CAST(doc_id % 5 AS STRING)")} END,
            '}},"preprocessing":{{"methods":["a",', {fault(89, '""', "'\"b\"'")}, ']}},"ocr_model":"o","kie_model":', {fault(97, 'null', "'\"k\"'")}, '}}')""",
        "token": fault(29, "{", f"concat({token})", 3),
    }[kind]


def _found(*faults):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for when, code in faults) + "], lambda c: c IS NOT NULL), ',')"


def _token_faults(at, sound="true"):
    return [(f"{sound} AND doc_id % 47 = 0", f"{at}.bbox.x_min: not_a_number"), (f"{sound} AND doc_id % 53 = 0 AND doc_id % 47 <> 0", f"{at}.bbox: inverted"),
            (f"{sound} AND doc_id % 59 = 0", f"{at}.confidence: out_of_range")]


FAULTS = {
    "recognition": [("doc_id % 41 = 0", "$.document_id: blank"), ("doc_id % 43 = 0", "$.full_text: not_a_string"), *_token_faults("$.tokens[0]"),
                    ("doc_id % 61 = 0", "$.processing_time_ms: out_of_range")],
    "extraction": [("doc_id % 31 = 0", "$.fields: not_an_object"), ("doc_id % 37 = 0", "$.confidences.total: not_a_number")],
    "document": [("doc_id % 67 = 0", "$.image_path: missing"), ("doc_id % 71 < 2", "$.width: not_an_integer"), ("doc_id % 73 = 0", "$.height: out_of_range"),
                 ("doc_id % 79 = 0", "$.split: unknown_value")],
    "experiment": [("doc_id % 83 = 0", "$.degradation.severity: out_of_range"), ("doc_id % 83 = 1", "$.degradation.severity: not_an_integer"),
                   ("doc_id % 89 = 0", "$.preprocessing.methods[1]: blank"), ("doc_id % 97 = 0", "$.kie_model: not_a_string")],
    "token": [("doc_id % 29 = 3", "$: malformed_json"), *_token_faults("$", "doc_id % 29 <> 3")],
}


@query("schema_checks", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {_found(*f)} AS violations FROM {{documents}}" for k, f in FAULTS.items()))
def _(t):
    out = None
    for kind in FAULTS:
        rows = t.documents.select("doc_id", F.lit(kind).alias("kind"), F.expr(_bodies(kind)).alias("body"))
        found = schema_checks(rows, kind).select("doc_id", "kind", F.array_join("violations", ",").alias("violations"))
        out = found if out is None else out.unionByName(found)
    return out


TRIP = """fl AS (SELECT split, stem, bool_or(kind = 'img') AS i, bool_or(kind = 'box') AS b, bool_or(kind = 'entities') AS e FROM {corpus_files} GROUP BY 1, 2),
  tr AS (SELECT split, stem, i AND b AND e AS paired, NOT i AND (b OR e) AS missing_image, i AND NOT b AS missing_ocr, i AND NOT e AS missing_kie,
    b AND NOT i AS extra_ocr, e AND NOT i AS extra_kie, i AND NOT (b AND e) AS extra_image FROM fl)"""


@query("corpus_triplet", f"WITH {TRIP} SELECT * FROM tr")
def _(t):
    return A.corpus_triplet(t.corpus_files)


TCOUNT = "tc AS (SELECT split, " + ", ".join(
    f"count(*) FILTER ({c}) AS {c}" for c in ("paired", "missing_image", "missing_ocr", "missing_kie", "extra_ocr", "extra_kie", "extra_image")) + " FROM tr GROUP BY 1)"


@query("triplet_counts", f"WITH {TRIP}, {TCOUNT} SELECT * FROM tc")
def _(t):
    return A.triplet_counts(A.corpus_triplet(t.corpus_files))


LEAK = "(SELECT stem FROM {corpus_files} WHERE split = 'train' INTERSECT SELECT stem FROM {corpus_files} WHERE split = 'test')"


@query("split_leakage", f"SELECT * FROM {LEAK}")
def _(t):
    return A.split_leakage(t.corpus_files)


@query("set_union", "SELECT stem FROM {corpus_files} WHERE kind = 'img' UNION SELECT stem FROM {corpus_files} WHERE kind = 'box'")
def _(t):
    kind = lambda k: t.corpus_files.where(F.col("kind") == k).select("stem")
    return kind("img").union(kind("box")).distinct()


@query("set_intersect", "SELECT stem FROM {corpus_files} WHERE kind = 'img' INTERSECT SELECT stem FROM {corpus_files} WHERE kind = 'box'")
def _(t):
    kind = lambda k: t.corpus_files.where(F.col("kind") == k).select("stem")
    return kind("img").intersect(kind("box"))


@query("set_difference", "SELECT stem FROM {corpus_files} WHERE kind = 'img' EXCEPT SELECT stem FROM {corpus_files} WHERE kind = 'box'")
def _(t):
    kind = lambda k: t.corpus_files.where(F.col("kind") == k).select("stem")
    return kind("img").subtract(kind("box"))


FILES = """c1 AS (SELECT CASE kind WHEN 'img' THEN 'C-01' WHEN 'box' THEN 'C-04' ELSE 'C-07' END AS "check",
    CASE kind WHEN 'img' THEN 'image_file_exists' WHEN 'box' THEN 'ocr_file_exists' ELSE 'kie_file_exists_and_valid_json' END AS name, 'error' AS severity,
    count(*) AS checked, count(*) FILTER (size <= 0) AS violations FROM {corpus_files} GROUP BY kind)"""


@query("audit_files", f"WITH {FILES} SELECT * FROM c1")
def _(t):
    return A.audit_files(t.corpus_files)


POLY = "c5 AS (SELECT 'C-05' AS \"check\", 'ocr_polygons_valid' AS name, 'error' AS severity, count(*) AS checked, count(reason) AS violations FROM bp)"


@query("audit_polygons", f"WITH {LINES}, {POLY} SELECT * FROM c5")
def _(t):
    return A.audit_polygons(A.parse_box_lines(t.box_lines))


def _sizes(t):
    return t.orders.select(F.col("o_orderkey").alias("document_id"), F.lit(121).alias("width"), F.lit(80).alias("height"))


BOXC = """c6a AS (SELECT count(*) AS n, count(*) FILTER (x_max < x_min OR y_max < y_min) AS a, count(*) FILTER (x_min < 0 OR y_min < 0 OR x_max > 121 OR y_max > 80) AS b FROM bp WHERE reason IS NULL),
  c6 AS (SELECT 'C-06' AS "check", 'bbox_geometry_bounds' AS name, 'error' AS severity, n AS checked, a AS violations FROM c6a UNION ALL SELECT 'C-06', 'bbox_geometry_bounds', 'warning', n, b FROM c6a)"""


@query("audit_boxes", f"WITH {LINES}, {BOXC} SELECT * FROM c6")
def _(t):
    return A.audit_boxes(A.parse_box_lines(t.box_lines), _sizes(t))


ENTC = """c7a AS (SELECT count(*) AS n, count(*) FILTER (reason IN ('malformed_json','not_an_object')) AS a, count(*) FILTER (reason IN ('missing_keys','not_a_string')) AS b FROM ep),
  c7 AS (SELECT 'C-07' AS "check", 'kie_file_exists_and_valid_json' AS name, 'error' AS severity, n AS checked, a AS violations FROM c7a
    UNION ALL SELECT 'C-08', 'kie_required_keys_and_string_values', 'error', n - a, b FROM c7a)"""


@query("audit_entities", f"WITH {ENT}, {ENTC} SELECT * FROM c7")
def _(t):
    return A.audit_entities(A.parse_entities(t.entity_files))


ISO = f"""c9 AS (SELECT 'C-09' AS "check", 'id_uniqueness_and_split_isolation' AS name, 'error' AS severity, (SELECT count(DISTINCT stem) FROM {{corpus_files}}) AS checked,
    (SELECT count(*) FROM {LEAK}) + (SELECT count(*) FROM (SELECT split, stem FROM {{corpus_files}} WHERE kind = 'img' GROUP BY 1, 2 HAVING count(*) > 1)) AS violations)"""


@query("audit_isolation", f"WITH {ISO} SELECT * FROM c9")
def _(t):
    return A.audit_isolation(t.corpus_files)


TRC = "c10 AS (SELECT 'C-10' AS \"check\", 'cross_file_triplet_consistency' AS name, 'error' AS severity, count(*) AS checked, count(*) FILTER (missing_image OR missing_ocr OR missing_kie) AS violations FROM tr)"


@query("audit_triplets", f"WITH {TRIP}, {TRC} SELECT * FROM c10")
def _(t):
    return A.audit_triplets(t.corpus_files)


@query("audit_counts", f"""WITH {TRIP}, {TCOUNT} SELECT split, paired AS actual, CASE split WHEN 'train' THEN 626 ELSE 347 END::BIGINT AS expected, 'warning' AS severity,
    paired = CASE split WHEN 'train' THEN 626 ELSE 347 END AS ok FROM tc""")
def _(t):
    return A.audit_counts(t.corpus_files, {"train": 626, "test": 347})


@query("audit_report", f"""WITH {FILES}, {LINES}, {POLY}, {BOXC}, {ENT}, {ENTC}, {ISO}, {TRIP}, {TRC},
  al AS (SELECT * FROM c1 UNION ALL SELECT * FROM c5 UNION ALL SELECT * FROM c6 UNION ALL SELECT * FROM c7 UNION ALL SELECT * FROM c9 UNION ALL SELECT * FROM c10)
  SELECT *, CASE WHEN errors = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT "check", name, coalesce(sum(violations) FILTER (severity = 'error'), 0)::BIGINT AS errors,
    coalesce(sum(violations) FILTER (severity = 'warning'), 0)::BIGINT AS warnings FROM al GROUP BY 1, 2)""")
def _(t):
    # The listing and the lines are derived once; their checks read the written rows, of the lines what they ask for.
    files = t.once(t.corpus_files, "audited-files")
    parsed = A.parse_box_lines(t.box_lines)
    boxes = t.once(parsed.select("document_id", "reason", "x_min", "y_min", "x_max", "y_max"), "parsed-boxes")
    entities = A.parse_entities(t.entity_files)
    return A.audit_report(
        A.audit_files(files), A.audit_polygons(boxes), A.audit_boxes(boxes, _sizes(t)), A.audit_entities(entities),
        A.audit_isolation(files), A.audit_triplets(files))


@query("audit_text_table", """SELECT 'empty_text' AS "check", count(*) FILTER (text IS NULL OR trim(text) = '') AS violations FROM {documents}
  UNION ALL SELECT 'length_mismatch', count(*) FILTER (length(text) <> n_chars) FROM {documents}
  UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT text) FROM {documents}
  UNION ALL SELECT 'orphan_label', count(*) FROM {labels} WHERE doc_id NOT IN (SELECT doc_id FROM {documents})""")
def _(t):
    return A.audit_text_table(t.documents, t.labels)


# Run comparison -------------------------------------------------------------------------------------------------


@query("run_compare")
def _(t):
    """Whole documents; checked against brute force in the tests."""
    return C.run_compare(spread(t.run_pairs, "document_id"))


@query("run_agreement")
def _(t):
    return C.run_agreement(t.once(C.run_compare(spread(t.run_pairs, "document_id")), "compared"))


@query("run_id_mismatch", """SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN a.document_id IS NULL THEN 'only_b' ELSE 'only_a' END AS side
  FROM (SELECT DISTINCT document_id FROM {kie_pairs}) a FULL JOIN (SELECT DISTINCT document_id FROM {extracted_fields}) b ON a.document_id = b.document_id
  WHERE a.document_id IS NULL OR b.document_id IS NULL""")
def _(t):
    return C.id_mismatch(t.kie_pairs, t.extracted_fields)


AGREE = f"ag AS (SELECT document_id, field_name, {text_sql('value_a')} = {text_sql('value_b')} AS match FROM {{run_fields}})"


@query("field_agreement_rates", f"""WITH {AGREE} SELECT coalesce(field_name, 'overall') AS field_name, count(*) AS n, count(*) FILTER (match) AS matches,
    round(count(*) FILTER (match) / count(*)::DOUBLE, 4) AS match_rate FROM ag GROUP BY ROLLUP (field_name)""")
def _(t):
    return C.field_agreement_rates(C.field_agreement(t.run_fields))


@query("differing_documents")
def _(t):
    return C.differing_documents(C.run_compare(spread(t.run_pairs, "document_id")), C.field_agreement(t.run_fields))


# Sampling -------------------------------------------------------------------------------------------------------

HASHED = "hs AS (SELECT doc_id, sha256(concat('42:', doc_id::VARCHAR)) AS h FROM {documents})"


@query("split_assign", f"""WITH {HASHED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k FROM hs)
  SELECT doc_id, CASE WHEN k <= 500 THEN 'development' ELSE 'validation' END AS split FROM r WHERE k <= 626""")
def _(t):
    return P.split_assign(t.documents, column="doc_id")


@query("subset_sample", f"WITH {HASHED} SELECT doc_id FROM hs ORDER BY h, doc_id LIMIT 64")
def _(t):
    return P.subset_sample(t.documents, 64, column="doc_id")


@query("split_guard", "SELECT DISTINCT split, stem FROM {corpus_files} WHERE split = 'train'")
def _(t):
    return P.resolve_split(t.corpus_files, "train")


@query("derive_seed", """SELECT document_id, condition_id, ('0x' || sha256(concat_ws(':', '42', document_id::VARCHAR, d::VARCHAR, s::VARCHAR, p::VARCHAR))[1:8])::BIGINT AS seed FROM {run_records}""")
def _(t):
    from leafscore.functions.scalars import derive_seed

    seed = derive_seed(42, F.col("document_id"), F.col("d").cast("string"), F.col("s"), F.col("p").cast("string"))
    return t.run_records.select("document_id", "condition_id", seed.alias("seed"))


@query("config_hash", """SELECT config_id, sha256(concat('{', string_agg(concat('"', key, '":"', value, '"'), ',' ORDER BY key), '}')) AS config_hash
  FROM {config_entries} WHERE key <> 'timestamp' GROUP BY 1""")
def _(t):
    return P.config_hash(t.config_entries)


# Nested configurations of the parts: objects and lists three levels deep, run-time keys at every one.
NESTED = """'{"brand":"' || p_brand || '","pipeline":{"steps":[{"name":"' || p_name || '","size":' || p_size::VARCHAR || '},"' || p_type
    || '"],"types":[]},"threshold":' || CASE WHEN p_size % 2 = 0 THEN '0.5' ELSE '10' END || '}'"""


@query("config_hash_nested", f"SELECT p_partkey AS config_id, sha256({NESTED}) AS config_hash FROM {{part}}")
def _(t):
    def field(name, value):
        return F.concat(F.lit(f'"{name}": '), value)

    def text(c):
        return F.concat(F.lit('"'), F.col(c), F.lit('"'))

    def listed(*fields):
        return F.concat(F.lit("{"), F.concat_ws(" , ", *fields), F.lit("}"))

    stamp = field("timestamp", F.col("p_retailprice").cast("string"))
    step = listed(stamp, field("size", F.col("p_size").cast("string")), field("name", text("p_name")), field("run_id", listed(stamp)))
    steps = F.concat(F.lit("["), step, F.lit(", "), text("p_type"), F.lit("]"))
    pipeline = listed(field("types", F.lit("[ ]")), field("log_dir", F.lit("[1, 2]")), field("steps", steps))
    threshold = F.when(F.col("p_size") % 2 == 0, "0.50").otherwise("10.0")
    whole = listed(field("threshold", threshold), field("pid", F.col("p_size").cast("string")), field("pipeline", pipeline), field("brand", text("p_brand")))
    return nested_config_hash(t.part.select(F.col("p_partkey").alias("config_id"), F.parse_json(whole).alias("config")))


# Robustness on text ---------------------------------------------------------------------------------------------

B1 = f"""b1 AS (SELECT 'none' AS degradation, 0 AS severity UNION ALL SELECT g, v FROM (SELECT unnest([{', '.join(repr(n) for n in M.DEGRADATION_CODE if n not in ('none', 'control'))}]) AS g)
    CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS v)),
  cl AS (SELECT document_id, text, degradation, severity, ('0x' || sha256(concat_ws(':', '42', document_id::VARCHAR, degradation, severity::VARCHAR, 'none'))[1:8])::BIGINT AS seed FROM {{turns}} CROSS JOIN b1),
  ch AS (SELECT *, regexp_extract_all(text, '(?s).') AS cs, string_split(text, ' ') AS ws, string_split(text, chr(10)) AS ln, length(text) AS n FROM cl)"""
PICK = "(seed + ({i}) * 7919) % 1009 < severity * 60"


def each_sql(body: str) -> str:
    return f"array_to_string(list_transform(cs, lambda c, i: {body}), '')"


DEGRADED = f"""dg AS (SELECT document_id, degradation, severity, CASE degradation
    WHEN 'none' THEN text
    WHEN 'gaussian_blur' THEN {each_sql(f"CASE WHEN contains('aeiouAEIOU', c) AND {PICK.format(i='i - 1')} THEN 'e' ELSE c END")}
    WHEN 'motion_blur' THEN {each_sql(f"coalesce(CASE WHEN {PICK.format(i='(i - 1) // 2')} THEN cs[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END] END, c)")}
    WHEN 'gaussian_noise' THEN {each_sql(f"CASE WHEN {PICK.format(i='i - 1')} THEN translate(c, 'olsbgzOIS', '015692015') ELSE c END")}
    WHEN 'jpeg_compression' THEN {each_sql(f"CASE WHEN {PICK.format(i='i - 1')} THEN CASE WHEN c = ' ' THEN '' ELSE lower(c) END ELSE c END")}
    WHEN 'downsampling' THEN array_to_string(list_filter(ws, lambda w, i: (i - 1) % (12 - 2 * severity) <> seed % (12 - 2 * severity)), ' ')
    WHEN 'rotation' THEN array_to_string(list_concat(ln[severity % len(ln) + 1:], ln[1:severity % len(ln)]), chr(10))
    WHEN 'perspective' THEN left(text, CAST(floor(n * (10 - severity) / 10.0E0) AS BIGINT))
    ELSE concat(left(text, seed % greatest(1, n - n * severity // 20)), repeat('#', n * severity // 20), substr(text, (seed % greatest(1, n - n * severity // 20)) + n * severity // 20 + 1)) END AS pred FROM ch)"""


@query("degrade_text", f"WITH {B1}, {DEGRADED} SELECT * FROM dg")
def _(t):
    cells = M.matrix_expand(t.turns, configured(t, preprocessing=False))
    pred = R.degrade_text(F.col("text"), F.col("degradation"), F.col("severity"), F.col("derived_seed"))
    return cells.select("document_id", "degradation", "severity", pred.alias("pred"))


CTRL = "regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
UNDO = "translate({0}, '015692', 'olsbgz')"
SQUEEZE = "trim(regexp_replace({0}, '[ \\t]+', ' ', 'g'))"


@query("restore_text", f"""SELECT doc_id, policy, CASE policy WHEN 'none' THEN text WHEN 'p_minimal_cleanup' THEN {SQUEEZE.format(CTRL.format('text'))}
    WHEN 'p_contrast_enhancement' THEN {UNDO.format(CTRL.format('text'))}
    WHEN 'p_standard_receipt_enhancement' THEN {SQUEEZE.format("regexp_replace(" + UNDO.format(CTRL.format('text')) + ", '#+', '', 'g')")}
    ELSE {SQUEEZE.format("regexp_replace(lower(" + UNDO.format('text') + "), '[^A-Za-z0-9\\s]', '', 'g')")} END AS restored
  FROM {{documents}} CROSS JOIN (SELECT DISTINCT preprocessing AS policy FROM {{named_conditions}})""")
def _(t):
    policies = t.spark.createDataFrame([(p,) for p in R.POLICIES], "policy string")
    rows = t.documents.select("doc_id", "text").crossJoin(F.broadcast(policies))
    return rows.select("doc_id", "policy", R.restore_text(F.col("text"), F.col("policy")).alias("restored"))


@query("robustness_matrix")
def _(t):
    """All 161 conditions over the conversation turns, scored; checked by its parts and in the tests."""
    return R.robustness_records(spread(t.turns, "document_id"), configured(t))


@query("robustness_summary")
def _(t):
    """All 161 conditions over whole turns, summarized with intervals, deltas and recoveries."""
    records = R.robustness_records(spread(t.turns, "document_id"), configured(t))
    # Scored once; counts, statistics and intervals read the rows.
    return R.robustness_summary(t.once(records, "robustness"))
