"""Queries over token tables: field extraction, boxes and reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafscore.functions.scalars import confident_tokens, quad_to_bbox, scale_bbox
from leafscore.functions.text import contains_any, digit_ratio, humanize, is_upper, sanitize_filename, sniff_mime, upload_check
from leafscore.operators import extraction as X
from leafscore.plans.registry import query

FULL = X.VOCABULARY["full"]


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def flat(df):
    return df.withColumn("token_indices", F.array_join(F.transform("token_indices", lambda i: i.cast("string")), ","))


MON = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({0})[1:3])"
PLAUSIBLE = ("(CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END BETWEEN 1990 AND 2035 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31)")
# Token texts of the view hold at most one date each, so a single extraction per pattern is complete.
TOK = f"""tk AS (SELECT document_id, idx, trim(text) AS t, upper(text) AS u, lag(upper(text)) OVER w AS pu, idx AS i FROM {{receipt_tokens}}
    WINDOW w AS (PARTITION BY document_id ORDER BY idx))"""
DATE = f"""{TOK}, dm AS (SELECT *, regexp_extract(t, '(?:^|[^0-9])(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{2,4}})(?:$|[^0-9])', ['a','b','c']) AS g FROM tk),
  dn AS (SELECT document_id, idx, concat(g.a, regexp_extract(t, '\\d([/.-])', 1), g.b, regexp_extract(t, '\\d[/.-]\\d+([/.-])', 1), g.c) AS value,
      TRY_CAST(g.a AS INT) AS a, TRY_CAST(g.b AS INT) AS b, TRY_CAST(g.c AS INT) AS y,
      CASE WHEN {any_sql('u', FULL['date'])} OR coalesce({any_sql('pu', FULL['date'])}, false) THEN 0.95E0 ELSE 0.7E0 END AS confidence FROM dm WHERE g.a <> ''),
  dq AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, idx) AS rn FROM dn
    WHERE {PLAUSIBLE.format(y='y', m='b', d='a')} OR {PLAUSIBLE.format(y='y', m='a', d='b')})
  SELECT document_id, 'date' AS field_name, value, confidence, idx::VARCHAR AS token_indices, 'regex_dmy' AS rule FROM dq WHERE rn = 1"""


@query("extract_date", "WITH " + DATE)
def _(t):
    return flat(X.extract_date(t.receipt_tokens))


TOTAL = f"""WITH {TOK}, am AS (SELECT *, regexp_extract(t, '([0-9]{{1,6}}\\.[0-9]{{2}})\\b', 1) AS value,
      {any_sql('u', FULL['total'])} AS good, {any_sql('u', FULL['total_negative'])} AS bad,
      coalesce({any_sql('pu', FULL['total'])} AND NOT {any_sql('pu', FULL['total_negative'])}, false) AS pg,
      contains(u, 'GRAND') OR coalesce(contains(pu, 'GRAND'), false) AS gr FROM tk),
  sc AS (SELECT *, CASE WHEN gr THEN 0.95E0 ELSE 0.85E0 END AS confidence FROM am WHERE value <> '' AND NOT bad AND (good OR pg)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, value::DOUBLE DESC, idx) AS rn FROM sc)
  SELECT document_id, 'total' AS field_name, value, confidence, CASE WHEN pg THEN concat((idx - 1)::VARCHAR, ',', idx::VARCHAR) ELSE idx::VARCHAR END AS token_indices,
    'keyword_proximity' AS rule FROM rk WHERE rn = 1"""


@query("extract_total", TOTAL)
def _(t):
    return flat(X.extract_total(t.receipt_tokens))


COMPANY = f"""cs AS (SELECT *, round(least(1.0E0, greatest(0.4E0, 0.85E0 - idx * 0.08E0) + CASE WHEN {any_sql('u', FULL['company_legal'])} THEN 0.25E0 ELSE 0.0E0 END
      + CASE WHEN t = u AND regexp_matches(t, '[A-Z]') AND length(t) > 4 THEN 0.05E0 ELSE 0.0E0 END), 4) AS confidence FROM tk
    WHERE idx < 10 AND length(t) BETWEEN 3 AND 100 AND NOT {any_sql('u', FULL['company_negative'])}
      AND len(regexp_extract_all(t, '[0-9]')) / length(t)::DOUBLE <= 0.35),
  ck AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, idx) AS rn FROM cs)"""


@query("extract_company", f"""WITH {TOK}, {COMPANY} SELECT document_id, 'company' AS field_name, t AS value, confidence,
    idx::VARCHAR AS token_indices, 'header_legal_heuristic' AS rule FROM ck WHERE rn = 1""")
def _(t):
    return flat(X.extract_company(t.receipt_tokens))


ADDRESS = f"""ad AS (SELECT document_id, idx, t, {any_sql('upper(t)', X.ADDRESS_STOP)} AS stop, {any_sql('upper(t)', FULL['address_negative'])} AS skip,
      {any_sql('upper(t)', FULL['location'])}::INT + regexp_matches(t, '\\b[0-9]{{{{5}}}}\\b')::INT AS hits,
      NOT (contains(upper(t), 'TEL') OR len(regexp_extract_all(t, '[0-9]')) / greatest(1, length(t))::DOUBLE > 0.6) AND length(t) > 3 AS plain FROM tk),
  hd AS (SELECT ad.*, min(ad.idx) FILTER (stop) OVER (PARTITION BY ad.document_id) AS cut FROM ad LEFT JOIN (SELECT document_id, idx + 1 AS start FROM ck WHERE rn = 1) st USING (document_id)
    WHERE ad.idx >= coalesce(start, 0) AND ad.idx < coalesce(start, 0) + 18),
  bg AS (SELECT *, min(idx) FILTER (hits > 0) OVER (PARTITION BY document_id) AS begins FROM hd WHERE (cut IS NULL OR idx < cut) AND NOT skip),
  pl AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS r FROM bg WHERE idx >= begins AND (hits > 0 OR plain)),
  bk AS (SELECT document_id, sum(hits)::BIGINT AS features, list(t ORDER BY idx) AS parts, list(idx ORDER BY idx) AS ix FROM pl WHERE r <= 6 OR hits > 0 GROUP BY 1),
  sc AS (SELECT document_id, count(*) AS features, list(t ORDER BY idx) AS parts, list(idx ORDER BY idx) AS ix
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS r FROM ad WHERE hits > 0 AND NOT skip) WHERE r <= 3 GROUP BY 1),
  ab AS (SELECT document_id, coalesce(bk.features, sc.features) AS features, coalesce(bk.parts, sc.parts) AS parts, coalesce(bk.ix, sc.ix) AS ix FROM bk FULL JOIN sc USING (document_id)),
  ay AS (SELECT document_id, 'address' AS field_name, list_reduce(parts, lambda a, b: concat(a, CASE WHEN ends_with(a, ',') OR ends_with(a, '-') THEN ' '
      WHEN starts_with(b, ',') THEN '' ELSE ', ' END, b)) AS value, round(least(1.0E0, 0.65E0 + least(0.30E0, features * 0.10E0)), 4) AS confidence,
    array_to_string(ix, ',') AS token_indices, 'header_address_block' AS rule FROM ab)"""


@query("extract_address", f"WITH {TOK}, {COMPANY}, {ADDRESS} SELECT * FROM ay")
def _(t):
    tokens = t.once(t.receipt_tokens, "tokens")
    return flat(X.extract_address(tokens, X.extract_company(tokens)))


@query("extract_fields", f"""WITH {TOK}, {COMPANY}, {ADDRESS}, fd AS (WITH {DATE}), ft AS ({TOTAL}),
  al AS (SELECT document_id, 'company' AS field_name, t AS value, confidence, idx::VARCHAR AS token_indices, 'header_legal_heuristic' AS rule FROM ck WHERE rn = 1
    UNION ALL SELECT * FROM ay UNION ALL SELECT * FROM fd UNION ALL SELECT * FROM ft) SELECT * FROM al WHERE confidence >= 0.2""")
def _(t):
    """The tokens are written once: every field reads them."""
    return flat(X.extract_fields(t.once(t.receipt_tokens, "tokens")))


@query("candidate_rank", f"""WITH {TOK}, {COMPANY} SELECT document_id, idx, t AS value, confidence, rn AS rank FROM ck""")
def _(t):
    ranked = X.ranked_candidates(X.company_candidates(t.receipt_tokens))
    return ranked.select("document_id", "idx", "value", "confidence", "rank")


@query("neighbor_keyword", f"""WITH {TOK} SELECT document_id, idx, coalesce({any_sql('pu', FULL['date'])}, false) AS after_date,
    coalesce({any_sql('pu', FULL['total'])} AND NOT {any_sql('pu', FULL['total_negative'])}, false) AS after_total FROM tk""")
def _(t):
    u = F.upper("text")
    date, total = contains_any(u, FULL["date"]), contains_any(u, FULL["total"]) & ~contains_any(u, FULL["total_negative"])
    flags = X._next_flags(t.receipt_tokens, date | total, after_date=date, after_total=total)
    return t.receipt_tokens.select("document_id", "idx").join(flags, ["document_id", "idx"], "left").na.fill(False)


BOXES = "bx AS (SELECT document_id, idx, idx % 3 * 40.0E0 / 200 AS x0, y_min / 100 AS y0, (idx % 3 * 40 + 35.0E0) / 200 AS x1, (y_min + 10) / 100 AS y1 FROM {receipt_tokens})"


@query("field_union_bbox", f"""WITH {TOK}, {BOXES}, {COMPANY}, pk AS (SELECT document_id, 'company' AS field_name, idx FROM ck WHERE rn = 1)
  SELECT document_id, field_name, round(min(x0), 5) AS x_min, round(min(y0), 5) AS y_min, round(max(x1), 5) AS x_max, round(max(y1), 5) AS y_max
  FROM pk JOIN bx USING (document_id, idx) GROUP BY 1, 2""")
def _(t):
    x = F.col("idx") % 3 * 40.0
    boxes = t.receipt_tokens.select(
        "document_id", "idx", (x / 200).alias("x_min"), (F.col("y_min") / 100).alias("y_min"), ((x + 35.0) / 200).alias("x_max"),
        ((F.col("y_min") + 10) / 100).alias("y_max"))
    return X.field_union_bbox(X.extract_company(t.receipt_tokens), boxes)


def _boxes(t):
    return t.page_tokens.select(
        "document_id", "idx", "text", "x_min", ((F.col("idx") / 2).cast("int") * 12.0 + F.col("idx") % 2 * 3 + F.col("document_id") % 5).alias("y_min")
    ).withColumn("y_max", F.col("y_min") + 10.0)


# Each token is compared with the mean centre of the line before it, one token of every document per step.
@query("reading_order", """WITH RECURSIVE b AS (SELECT document_id, idx, trim(text) AS t, x_min, idx // 2 * 12.0E0 + idx % 2 * 3 + document_id % 5 AS y_min FROM {page_tokens}),
  s AS (SELECT *, y_min + 5 AS yc, row_number() OVER (PARTITION BY document_id ORDER BY y_min, x_min, idx) AS k FROM b),
  f AS (SELECT document_id, k, yc AS total, 1 AS n, 1 AS line FROM s WHERE k = 1
    UNION ALL
    SELECT s.document_id, s.k, CASE WHEN abs(s.yc - f.total / f.n) <= 5.0E0 THEN f.total + s.yc ELSE s.yc END,
      CASE WHEN abs(s.yc - f.total / f.n) <= 5.0E0 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(s.yc - f.total / f.n) <= 5.0E0 THEN f.line ELSE f.line + 1 END
    FROM f JOIN s ON s.document_id = f.document_id AND s.k = f.k + 1),
  l AS (SELECT document_id, line, min(y_min) AS top, string_agg(t, ' ' ORDER BY x_min, y_min, idx) FILTER (t <> '') AS text
    FROM f JOIN s USING (document_id, k) GROUP BY 1, 2)
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY top, line)::INTEGER AS line_no, text FROM l WHERE text IS NOT NULL""")
def _(t):
    return X.reading_order(_boxes(t))


@query("reading_order_fast", """WITH b AS (SELECT document_id, idx, trim(text) AS t, x_min, idx // 2 * 12.0E0 + idx % 2 * 3 + document_id % 5 AS y_min FROM {page_tokens}),
  c AS (SELECT *, y_min + 5 AS yc FROM b),
  g AS (SELECT *, coalesce((yc - lag(yc) OVER w > 5.0)::INT, 0) AS cut FROM c WINDOW w AS (PARTITION BY document_id ORDER BY yc, x_min, idx)),
  s AS (SELECT *, sum(cut) OVER (PARTITION BY document_id ORDER BY yc, x_min, idx ROWS UNBOUNDED PRECEDING) AS seg FROM g),
  l AS (SELECT document_id, seg, min(y_min) AS top, string_agg(t, ' ' ORDER BY x_min, y_min, idx) AS text FROM s GROUP BY 1, 2)
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY top, seg) AS line_no, text FROM l""")
def _(t):
    return X.reading_order(_boxes(t), exact=False)


@query("polygon_to_bbox", """SELECT document_id, idx, document_id % 90 - 5.0E0 AS x_min, idx * 12.0E0 AS y_min, 120.0E0 AS x_max,
    CASE WHEN idx % 2 = 0 THEN idx * 12.0E0 + 1 ELSE idx * 12.0E0 + 10 END AS y_max FROM {receipt_tokens}""")
def _(t):
    x, y = F.col("document_id") % 90 - 5.0, F.col("idx") * 12.0
    low = y + F.when(F.col("idx") % 2 == 0, 0.0).otherwise(10.0)
    quad = F.array(x, y, F.lit(120.0), y, F.lit(120.0), low, x, low)
    return t.receipt_tokens.select("document_id", "idx", quad_to_bbox(quad, widen=True).alias("b")).select("document_id", "idx", "b.*")


@query("normalize_bbox", """SELECT document_id, idx, round(least(a, b), 5) AS x_min, round(greatest(a, b), 5) AS x_max, round(least(c, d), 5) AS y_min,
    round(greatest(c, d), 5) AS y_max FROM (SELECT document_id, idx, greatest(0, least(1, (idx * 37 - 20) / 130.0E0)) AS a, greatest(0, least(1, (document_id % 150) / 130.0E0)) AS b,
    greatest(0, least(1, y_min / 70)) AS c, greatest(0, least(1, (y_min + 10) / 70)) AS d FROM {receipt_tokens})""")
def _(t):
    box = F.struct((F.col("idx") * 37 - 20.0).alias("x_min"), (F.col("document_id") % 150 * 1.0).alias("x_max"), F.col("y_min").alias("y_min"), (F.col("y_min") + 10).alias("y_max"))
    return t.receipt_tokens.select("document_id", "idx", scale_bbox(box, F.lit(130.0), F.lit(70.0)).alias("b")).select("document_id", "idx", "b.*")


@query("token_confidence_filter", """SELECT document_id, idx, trim(text) AS text, greatest(0.0E0, least(1.0E0, coalesce(TRY_CAST(confidence AS DOUBLE), 0) * 1.2E0 - 0.1E0)) AS confidence
  FROM {page_tokens} WHERE greatest(0.0E0, least(1.0E0, coalesce(TRY_CAST(confidence AS DOUBLE), 0) * 1.2E0 - 0.1E0)) >= 0.5""")
def _(t):
    """One-token arrays keep the row key; the function takes arrays of any length."""
    score = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) * 1.2 - 0.1
    tokens = F.array(F.struct("text", score.alias("confidence")))
    return t.page_tokens.select("document_id", "idx", F.explode(confident_tokens(tokens, 0.5)).alias("k")).select("document_id", "idx", "k.*")


@query("keyword_flags", f"""SELECT document_id, idx, {any_sql('upper(text)', FULL['location'])} AS location, {any_sql('upper(text)', FULL['address_negative'])} AS contact,
    round(len(regexp_extract_all(text, '[0-9]')) / length(text)::DOUBLE, 4) AS digits, text = upper(text) AND regexp_matches(text, '[A-Z]') AS caps FROM {{receipt_tokens}}""")
def _(t):
    u, x = F.upper("text"), F.col("text")
    return t.receipt_tokens.select(
        "document_id", "idx", contains_any(u, FULL["location"]).alias("location"), contains_any(u, FULL["address_negative"]).alias("contact"),
        F.round(digit_ratio(x), 4).alias("digits"), is_upper(x).alias("caps"))


@query("humanize", "SELECT event_id, concat(upper(x[1]), lower(x[2:])) AS label FROM (SELECT event_id, replace(action, '_', ' ') AS x FROM {audit_events})")
def _(t):
    return t.audit_events.select("event_id", humanize(F.col("action")).alias("label"))


@query("sanitize_filename", """SELECT page_id, CASE WHEN v = '' THEN concat('document_', page_id::VARCHAR) ELSE v END AS name FROM (SELECT page_id,
    trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9_\\s.-]', '_', 'g'), '\\s+', '_', 'g'), '._') AS v FROM {pages})""")
def _(t):
    return t.pages.select("page_id", sanitize_filename(F.col("url"), F.col("page_id").cast("string")).alias("name"))


# Uploads derived from the pages: first bytes by rule, then the page's own text.
HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425056", "25504446", "49492A00", "4D4D002A", "3C68746D6C", "89504E47"]
TYPES = ["image/jpeg", "image/png", "image/webp", "application/pdf", "image/tiff", "image/tiff", "application/octet-stream", "application/octet-stream"]
LIMIT = 20_000


def _uploads(t):
    prefix = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in HEADS]), (F.col("page_id") % len(HEADS) + 1).cast("int"))
    size = F.when(F.col("page_id") % 13 == 4, 0).otherwise(F.length("html"))
    declared = F.element_at(F.array(*[F.lit(v) for v in ("image/jpg", "image/png", "", "application/octet-stream")]), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", F.concat(prefix, F.encode(F.substring("html", 1, 40), "UTF-8")).alias("head"), declared.alias("declared"), size.alias("size"))


MIME_SQL = "[" + ", ".join(f"'{v}'" for v in TYPES) + f"][page_id % {len(TYPES)} + 1]"


@query("sniff_mime", f"SELECT page_id, {MIME_SQL} AS mime FROM {{pages}}")
def _(t):
    return _uploads(t).select("page_id", sniff_mime(F.col("head")).alias("mime"))


@query("upload_check", f"""WITH u AS (SELECT page_id, {MIME_SQL} AS sniffed, CASE WHEN page_id % 13 = 4 THEN 0 ELSE length(html) END AS size,
    ['image/jpg', 'image/png', '', 'application/octet-stream'][page_id % 4 + 1] AS declared FROM {{pages}}),
  c AS (SELECT *, CASE WHEN size <= 0 THEN 'File is empty.' WHEN size > {LIMIT} THEN 'File size exceeds maximum limit of {LIMIT} bytes.'
    WHEN sniffed = 'application/octet-stream' THEN 'Unrecognized or unsupported file format signature.' ELSE '' END AS message FROM u)
  SELECT page_id, message = '' AS is_valid, CASE WHEN size > 0 AND size <= {LIMIT} THEN sniffed ELSE '' END AS mime, message,
    message = '' AND declared NOT IN ('', 'application/octet-stream') AND replace(declared, 'jpg', 'jpeg') <> sniffed AS mismatch FROM c""")
def _(t):
    return _uploads(t).select("page_id", upload_check(F.col("head"), F.col("declared"), F.col("size"), LIMIT).alias("u")).select("page_id", "u.*")

