"""The registered queries of the subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscore.llm import (
    ball_tree, exact_dedup, html_extract, language, mixing, near_dedup, packing, periodic, pii, quality, repeats, suffix_lm,
    token_counts,
)
from leafscore.llm.common import read, stored

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
         2.0::DOUBLE * source_size AS cap FROM sums),
levels AS (
  SELECT *, cap / weight AS fill,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
water AS (SELECT level FROM levels WHERE level < fill ORDER BY fill, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level >= fill THEN cap ELSE (SELECT level FROM water) * weight END AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                               < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # Only the identifier goes on from the row; the text is pruned from the exchange.
    return exact_dedup.exact_groups(docs, keep="largest").select(
        "row.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.fit_language(docs.where("NOT held_out"))
    return language.identify(docs.drop("lang"), model, ["doc_id", "held_out"])


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def packed(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place; of the ids, their CRC goes on."""
    pieces = packing.token_pieces(docs, ["doc_id"])
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    training = docs.where("NOT held_out")
    counts = suffix_lm.word_counts(training)
    model = suffix_lm.fit_suffix_tree(training, counts)
    return suffix_lm.score_texts(docs, counts, model, ["doc_id", "held_out"])


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after personal data is replaced by the name of its kind."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = stored(token_counts.count_trees(docs), "count-trees")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    spans = pii.find_pii(hashed, keep=("doc_id", "text_hash")).select("doc_id", "text_hash", F.explode("spans").alias("s"))
    edits = spans.select("doc_id", "text_hash", "s.start", "s.end", F.concat(F.lit("["), F.upper("s.kind"), F.lit("]")).alias("replacement"))
    edited = token_counts.recount(docs, trees, edits).select(
        "doc_id", "text_hash", "n_edits", F.col("n_tokens").alias("edited"), "n_encoded").dropDuplicates(["doc_id", "text_hash"])
    none = F.lit(0).cast("bigint")
    return token_counts.null_safe(trees.select("doc_id", "text_hash", "n_tokens"), edited, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_tokens", F.coalesce("n_edits", none).alias("n_edits"), F.coalesce("edited", "n_tokens").alias("n_tokens_edited"),
        F.coalesce("n_encoded", none).alias("n_encoded"))


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read(spark, sf_dir, "documents"), plant=True)
    # The first of the runs with the greatest length / period, compared as fractions.
    best = F.aggregate(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda top, run: F.when(
            top.isNull() | (run["length"] * top["period"] > top["length"] * run["period"]), run).otherwise(top))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "runs_sha256", "collapsed_sha256",
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked_search(
        read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLES["op12_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
factors AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM lengths, totals),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
repeats AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counts SEMI JOIN repeats USING (term) GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM repeats JOIN weights USING (term) JOIN counts USING (term) JOIN factors USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), texts_too=False)
