"""Checks of raw JSON records against the schema of their kind, before any cast.

Values stay VARIANT, so ``true`` where a number belongs, ``"5"`` where an integer belongs, a JSON null and a missing
key are told apart. Each rule gives the codes of what is wrong at its path; a record's codes come in rule order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.functions.text import strip

# Names of the splits.
SPLITS = ("train", "validation", "test")
Check = Callable[[Column, Column], Column]


def _codes(path: Column, *found: tuple[Column, str]) -> Column:
    """``path: code`` of the first condition that holds, as an array of one or none."""
    out = None
    for when, code in found:
        hit = F.array(F.concat(path, F.lit(f": {code}")))
        out = F.when(when, hit) if out is None else out.when(when, hit)
    return F.coalesce(out, F.array().cast("array<string>"))


def _shape(value: Column) -> Column:
    return F.schema_of_variant(value)


def _cast(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def text(blank: bool = True) -> Check:
    """A string; with ``blank`` false, one that is more than white space."""
    def check(value: Column, path: Column) -> Column:
        found = [(_shape(value) != "STRING", "not_a_string")]
        if not blank:
            found.append((strip(_cast(value, "string")) == "", "blank"))
        return _codes(path, *found)

    return check


def number(low: float | None = None, high: float | None = None) -> Check:
    """A finite number, never a boolean, within the bounds."""
    def check(value: Column, path: Column) -> Column:
        n = _cast(value, "double")
        outside = F.lit(False)
        if low is not None:
            outside = outside | (n < low)
        if high is not None:
            outside = outside | (n > high)
        return _codes(
            path, (~_shape(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "not_a_number"),
            (n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "not_finite"), (outside, "out_of_range"))

    return check


def integer(low: int | None = None, high: int | None = None) -> Check:
    """A whole number written as one: neither a boolean nor ``5.0``."""
    def check(value: Column, path: Column) -> Column:
        n = _cast(value, "decimal(38,0)")
        outside = F.lit(False)
        if low is not None:
            outside = outside | (n < low)
        if high is not None:
            outside = outside | (n > high)
        return _codes(path, (~_shape(value).rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$"), "not_an_integer"), (outside, "out_of_range"))

    return check


def one_of(*names: str) -> Check:
    def check(value: Column, path: Column) -> Column:
        return _codes(path, (_shape(value) != "STRING", "not_a_string"), (~_cast(value, "string").isin(*names), "unknown_value"))

    return check


def boolean(value: Column, path: Column) -> Column:
    return _codes(path, (_shape(value) != "BOOLEAN", "not_a_boolean"))


def anything(value: Column, path: Column) -> Column:
    return F.array().cast("array<string>")


def listed(item: Check) -> Check:
    """An array whose items all pass."""
    def check(value: Column, path: Column) -> Column:
        items = _cast(value, "array<variant>")
        each = F.flatten(F.transform(items, lambda v, i: item(v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(~_shape(value).startswith("ARRAY"), _codes(path, (F.lit(True), "not_a_list"))).otherwise(
            F.coalesce(each, F.array().cast("array<string>")))

    return check


def mapped(item: Check) -> Check:
    """An object whose values all pass, by key."""
    def check(value: Column, path: Column) -> Column:
        entries = F.array_sort(F.map_keys(_cast(value, "map<string,variant>")))
        values = _cast(value, "map<string,variant>")
        each = F.flatten(F.transform(entries, lambda k: item(F.element_at(values, k), F.concat(path, F.lit("."), k))))
        return F.when(~_shape(value).startswith("OBJECT"), _codes(path, (F.lit(True), "not_an_object"))).otherwise(
            F.coalesce(each, F.array().cast("array<string>")))

    return check


def record(rules: dict[str, Check], optional: tuple[str, ...] = (), nullable: tuple[str, ...] = (), also: Check | None = None) -> Check:
    """An object with the fields of ``rules``; ``optional`` may be missing, ``nullable`` may be a JSON null."""
    def check(value: Column, path: Column) -> Column:
        parts = []
        for name, rule in rules.items():
            field = F.try_variant_get(value, f"$.{name}", "variant")
            at = F.concat(path, F.lit("." + name))
            if name in optional:
                absent = F.array().cast("array<string>")
            else:
                absent = _codes(at, (F.lit(True), "missing"))
            own = F.when(field.isNull(), absent)
            if name in nullable:
                own = own.when(F.is_variant_null(field), F.array().cast("array<string>"))
            parts.append(own.otherwise(rule(field, at)))
        if also is not None:
            parts.append(also(value, path))
        return F.when(~_shape(value).startswith("OBJECT"), _codes(path, (F.lit(True), "not_an_object"))).otherwise(F.concat(*parts))

    return check


def _box_order(value: Column, path: Column) -> Column:
    """Maxima under minima; says nothing where a side is no number."""
    side = {c: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{c}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
                      F.try_variant_get(value, f"$.{c}", "double")) for c in ("x_min", "y_min", "x_max", "y_max")}
    inverted = F.coalesce(side["x_max"] < side["x_min"], F.lit(False)) | F.coalesce(side["y_max"] < side["y_min"], F.lit(False))
    return _codes(path, (inverted, "inverted"))


BOX = record({c: number() for c in ("x_min", "y_min", "x_max", "y_max")}, also=_box_order)
TOKEN = record({"text": text(), "bbox": BOX, "confidence": number(0, 1)}, optional=("confidence",), nullable=("confidence",))
OBJECT = mapped(anything)
TIMED = ("metadata", "processing_time_ms")
KINDS: dict[str, Check] = {
    "token": TOKEN,
    "recognition": record(
        {"document_id": text(False), "full_text": text(), "tokens": listed(TOKEN), "metadata": OBJECT, "processing_time_ms": number(0)},
        optional=TIMED, nullable=("processing_time_ms",)),
    "extraction": record(
        {"document_id": text(False), "fields": OBJECT, "confidences": mapped(number(0, 1)), "metadata": OBJECT, "processing_time_ms": number(0)},
        optional=("confidences", *TIMED), nullable=("confidences", "processing_time_ms")),
    "document": record(
        {"document_id": text(False), "image_path": text(False), "width": integer(1), "height": integer(1), "split": one_of(*SPLITS), "metadata": OBJECT},
        optional=("metadata",)),
    "experiment": record(
        {"experiment_id": text(False), "document_id": text(False),
         "degradation": record({"type": text(False), "severity": integer(0, 4), "parameters": OBJECT, "seed": integer()}, optional=("parameters", "seed")),
         "preprocessing": record({"enabled": boolean, "methods": listed(text(False)), "parameters": OBJECT}, optional=("enabled", "methods", "parameters")),
         "ocr_model": text(False), "kie_model": text(False), "metrics": OBJECT, "metadata": OBJECT},
        optional=("metrics", "metadata")),
}


def schema_checks(rows: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``rows`` plus ``violations``: the codes of a JSON record of one of the ``KINDS``, empty if it is sound.

    Paths begin with ``$``, as in ``$.tokens[3].bbox.x_min: not_a_number``. A text that is no JSON, or null, has the
    one code ``$: malformed_json``.
    """
    root = F.lit("$")
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    found = F.when(F.col("_v").isNull(), _codes(root, (F.lit(True), "malformed_json"))).otherwise(KINDS[kind](F.col("_v"), root))
    return parsed.withColumn("violations", found).drop("_v")
