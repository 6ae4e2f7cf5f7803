"""Data-quality audit of a corpus: files, box lines, entities, isolation, triplets and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.functions.text import has_text, strip
from leafscore.operators.layout import bound

ENTITY_KEYS = ("company", "date", "address", "total")


# Parsing ----------------------------------------------------------------------------------------------------


def parse_box_lines(lines: DataFrame) -> DataFrame:
    """Box lines ``x1,y1,...,x4,y4,transcript`` parsed next to a rejection reason (null when valid).

    Blank lines are dropped. The transcript is everything after the eighth comma, verbatim. Eleven or more parts
    with a numeric ninth and tenth mean extra coordinates.
    """
    line = F.col("line")
    # The pattern runs only over lines that can match it.
    marked = line.startswith("\ufeff") | line.contains("\r") | line.contains("\n")
    text = F.when(marked, F.regexp_replace("line", "^\\x{FEFF}|[\\r\\n]+$", "")).otherwise(line)
    rows = bound(lines, _t=text).where(has_text(F.col("_t")))
    rows = bound(rows, _p=F.split("_t", ","))
    number = lambda v: F.trim(v).try_cast("double")
    part = lambda i: number(F.get("_p", F.lit(i)))
    rows = bound(rows, _c=F.when(F.size("_p") >= 9, F.transform(F.slice("_p", 1, 8), number)))
    coords = [F.get("_c", F.lit(i)) for i in range(8)]
    any_of = lambda test: reduce(lambda a, b: a | b, [test(c) for c in coords])
    extra = (F.size("_p") >= 11) & part(8).isNotNull() & part(9).isNotNull()
    reason = (
        F.when(F.size("_p") < 9, "too_few_parts")
        .when(any_of(lambda c: c.isNull()), "non_numeric")
        .when(any_of(lambda c: F.isnan(c) | (F.abs(c) == float("inf"))), "non_finite")
        .when(extra, "extra_coordinates")
    )
    keep = [c for c in lines.columns if c != "line"]
    rows = bound(rows, reason=reason)
    valid = F.col("reason").isNull()
    # The transcript starts after the eighth comma; the array keeps it verbatim when joined again.
    return rows.select(
        *keep,
        "reason",
        F.when(valid, F.array_join(F.slice("_p", 9, 2**31 - 1), ",")).alias("transcript"),
        F.when(valid, F.least(*coords[0::2])).alias("x_min"),
        F.when(valid, F.least(*coords[1::2])).alias("y_min"),
        F.when(valid, F.greatest(*coords[0::2])).alias("x_max"),
        F.when(valid, F.greatest(*coords[1::2])).alias("y_max"),
    )


def parse_entities(files: DataFrame) -> DataFrame:
    """Entity JSON parsed next to a rejection reason (null when valid); extra keys are kept as metadata."""
    rows = files.withColumn("_v", F.try_parse_json(F.regexp_replace("body", "^\\x{FEFF}", "")))
    kind = F.schema_of_variant("_v")
    keyed = {k: F.try_variant_get("_v", f"$.{k}", "variant") for k in ENTITY_KEYS}
    missing = reduce(lambda a, b: a | b, [v.isNull() for v in keyed.values()])
    wrong = reduce(lambda a, b: a | b, [F.schema_of_variant(v) != "STRING" for v in keyed.values()])
    reason = (
        F.when(F.col("_v").isNull(), "malformed_json")
        .when(~kind.startswith("OBJECT"), "not_an_object")
        .when(missing, "missing_keys")
        .when(wrong, "not_a_string")
    )
    keep = [c for c in files.columns if c != "body"]
    valid = F.col("reason").isNull()
    table = F.from_json("body", "map<string,string>")
    extras = F.map_filter(table, lambda k, _: ~k.isin(*ENTITY_KEYS))
    return rows.withColumn("reason", reason).select(
        *keep,
        "reason",
        *[F.when(valid, F.try_variant_get("_v", f"$.{k}", "string")).alias(k) for k in ENTITY_KEYS],
        F.when(valid, F.to_json(extras)).alias("metadata"),
    )


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a parsed frame."""
    return parsed.where("reason IS NULL").drop("reason"), parsed.where("reason IS NOT NULL")


def record_checks(rows: DataFrame) -> DataFrame:
    """Violation codes per token row: id, confidence number and range, box order and finiteness."""
    conf = F.col("confidence").try_cast("double")
    nan = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    box = [F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_max")]
    bad_box = reduce(lambda a, b: a | b, [nan(c) for c in box])

    def code(when: Column, name: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(name))

    checks = F.array_compact(
        F.array(
            code(F.col("document_id").isNull() | (strip(F.col("document_id").cast("string")) == ""), "empty_id"),
            code(F.col("confidence").isNotNull() & conf.isNull(), "confidence_not_a_number"),
            code(nan(conf), "confidence_not_finite"),
            code(~conf.between(0.0, 1.0), "confidence_out_of_range"),
            code(bad_box, "box_not_finite"),
            code((box[2] < box[0]) | (box[3] < box[1]), "box_inverted"),
        )
    )
    return rows.withColumn("violations", checks)


# Checks over file listings ``(split, kind, stem, size)`` ------------------------------------------------------


def corpus_triplet(files: DataFrame) -> DataFrame:
    """Per (split, stem): which of image, boxes and entities exist and what is missing or extra."""
    has = {k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)) for k in ("img", "box", "entities")}
    rows = files.groupBy("split", "stem").agg(*[v.alias(k) for k, v in has.items()])
    img, box, ent = F.col("img"), F.col("box"), F.col("entities")
    return rows.select(
        "split",
        "stem",
        (img & box & ent).alias("paired"),
        (~img & (box | ent)).alias("missing_image"),
        (img & ~box).alias("missing_ocr"),
        (img & ~ent).alias("missing_kie"),
        (box & ~img).alias("extra_ocr"),
        (ent & ~img).alias("extra_kie"),
        (img & ~(box & ent)).alias("extra_image"),
    )


def triplet_counts(triplets: DataFrame) -> DataFrame:
    """Per split: the number of ids in each situation."""
    names = [c for c in triplets.columns if c not in ("split", "stem")]
    return triplets.groupBy("split").agg(*[F.count_if(n).alias(n) for n in names])


def split_leakage(files: DataFrame) -> DataFrame:
    """Stems present in both train and test, found with one grouping instead of two distinct sets."""
    seen = files.groupBy("stem").agg(
        F.bool_or(F.col("split") == "train").alias("_a"), F.bool_or(F.col("split") == "test").alias("_b")
    )
    return seen.where("_a AND _b").select("stem")


def duplicate_stems(files: DataFrame) -> DataFrame:
    """Files that share split, kind and stem."""
    return files.groupBy("split", "kind", "stem").agg(F.count("*").alias("copies")).where("copies > 1")


def _check(rows: DataFrame, code: str, name: str, severity: str, bad: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("checked"), F.count_if(bad).alias("violations")).select(
        F.lit(code).alias("check"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), "checked", "violations"
    )


def audit_files(files: DataFrame) -> DataFrame:
    """C-01, C-04, C-07: image, box and entity files are not empty. One pass over the listing."""
    table = {"img": "C-01", "box": "C-04", "entities": "C-07"}
    names = {"img": "image_file_exists", "box": "ocr_file_exists", "entities": "kie_file_exists_and_valid_json"}
    pick = lambda t: F.create_map(*[F.lit(x) for p in t.items() for x in p])[F.col("kind")]
    return files.where(F.col("kind").isin(*table)).groupBy("kind").agg(
        F.count("*").alias("checked"), F.count_if(F.col("size") <= 0).alias("violations")
    ).select(pick(table).alias("check"), pick(names).alias("name"), F.lit("error").alias("severity"), "checked", "violations")


def audit_polygons(parsed: DataFrame) -> DataFrame:
    """C-05: eight finite coordinates and no more."""
    return _check(parsed, "C-05", "ocr_polygons_valid", "error", F.col("reason").isNotNull())


def audit_boxes(parsed: DataFrame, sizes: DataFrame) -> DataFrame:
    """C-06: box order is an error, leaving the page frame only a warning."""
    rows = parsed.where("reason IS NULL").join(sizes, "document_id", "left")
    inverted = (F.col("x_max") < F.col("x_min")) | (F.col("y_max") < F.col("y_min"))
    outside = (
        (F.col("x_min") < 0) | (F.col("y_min") < 0) | (F.col("x_max") > F.col("width")) | (F.col("y_max") > F.col("height"))
    )
    facts = rows.agg(
        F.count("*").alias("checked"), F.count_if(inverted).alias("inverted"), F.count_if(outside).alias("outside")
    )
    entry = lambda sev, c: F.struct(F.lit(sev).alias("severity"), F.col(c).alias("violations"))
    return facts.select("checked", F.explode(F.array(entry("error", "inverted"), entry("warning", "outside"))).alias("e")).select(
        F.lit("C-06").alias("check"), F.lit("bbox_geometry_bounds").alias("name"), "e.severity", "checked", "e.violations"
    )


def audit_entities(parsed: DataFrame) -> DataFrame:
    """C-07: a JSON object; C-08: four required keys, all strings."""
    broken = F.coalesce(F.col("reason").isin("malformed_json", "not_an_object"), F.lit(False))
    keys = F.coalesce(F.col("reason").isin("missing_keys", "not_a_string"), F.lit(False))
    facts = parsed.agg(F.count("*").alias("n"), F.count_if(broken).alias("c07"), F.count_if(keys).alias("c08"))
    entry = lambda code, name, n, bad: F.struct(
        F.lit(code).alias("check"), F.lit(name).alias("name"), F.lit("error").alias("severity"), n.alias("checked"),
        bad.alias("violations"),
    )
    rows = F.array(
        entry("C-07", "kie_file_exists_and_valid_json", F.col("n"), F.col("c07")),
        entry("C-08", "kie_required_keys_and_string_values", F.col("n") - F.col("c07"), F.col("c08")),
    )
    return facts.select(F.explode(rows).alias("e")).select("e.*")


def audit_isolation(files: DataFrame) -> DataFrame:
    """C-09: no stem in both splits, no duplicate image stem."""
    stems = files.select("stem").distinct().agg(F.count("*").alias("checked"))
    leaks = split_leakage(files).agg(F.count("*").alias("_a"))
    copies = duplicate_stems(files.where("kind = 'img'")).agg(F.count("*").alias("_b"))
    return stems.crossJoin(leaks).crossJoin(copies).select(
        F.lit("C-09").alias("check"), F.lit("id_uniqueness_and_split_isolation").alias("name"),
        F.lit("error").alias("severity"), "checked", (F.col("_a") + F.col("_b")).alias("violations"),
    )


def audit_triplets(files: DataFrame) -> DataFrame:
    """C-10: every id has image, boxes and entities."""
    bad = F.col("missing_image") | F.col("missing_ocr") | F.col("missing_kie")
    return _check(corpus_triplet(files), "C-10", "cross_file_triplet_consistency", "error", bad)


def audit_counts(files: DataFrame, expected: dict[str, int], strict: bool = False) -> DataFrame:
    """Paired documents per split against the expected number: an error when strict, else a warning."""
    want = F.create_map(*[F.lit(x) for p in expected.items() for x in p])
    rows = triplet_counts(corpus_triplet(files)).where(F.col("split").isin(*expected))
    return rows.select(
        "split",
        F.col("paired").alias("actual"),
        want[F.col("split")].cast("long").alias("expected"),
        F.lit("error" if strict else "warning").alias("severity"),
        (F.col("paired") == want[F.col("split")]).alias("ok"),
    )


def audit_report(*checks: DataFrame) -> DataFrame:
    """One row per check: errors, warnings and PASSED/FAILED (warnings do not fail)."""
    rows = reduce(lambda a, b: a.unionByName(b), checks)
    is_error = F.col("severity") == "error"
    return rows.groupBy("check", "name").agg(
        F.sum(F.when(is_error, F.col("violations")).otherwise(0)).alias("errors"),
        F.sum(F.when(~is_error, F.col("violations")).otherwise(0)).alias("warnings"),
    ).withColumn("status", F.when(F.col("errors") == 0, "PASSED").otherwise("FAILED"))


def audit_text_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The same idea on a text table: duplicates, empty texts, length mismatches, orphan labels."""
    copies = documents.groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg(F.count("*").alias("n"))
    texts = documents.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("text").isNull() | (strip("text") == "")).alias("empty"),
        F.count_if(F.char_length("text") != F.col("n_chars")).alias("length"),
    )
    dup = copies.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate"))
    orphan = labels.join(documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphan"))
    one = texts.crossJoin(dup).crossJoin(orphan)
    items = [("empty_text", "empty"), ("length_mismatch", "length"), ("duplicate_text", "duplicate"), ("orphan_label", "orphan")]
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).alias("violations")) for n, c in items])).alias("e")
    ).select("e.*")
