"""Rates, clamps, dates, amounts, hashes, bounding boxes and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafscore.functions.text import strip

# Review reason code -> category; any other code is a validation reason.
REASON_CATEGORY = {
    "low_confidence": "confidence",
    "low_image_quality": "quality",
    "missing_required_field": "validation",
    "validation_failed": "validation",
    "invalid_number": "validation",
    "invalid_date": "validation",
    "empty_value": "validation",
    "document_integrity": "validation",
    "ocr_error": "pipeline",
    "kie_error": "pipeline",
    "pipeline_failure": "pipeline",
    "system_error": "pipeline",
    "none": "none",
}

# Confidence buckets as (label, inclusive low, exclusive high); 1.0 and above fall in the last.
COARSE_BUCKETS = [
    ("0.00–0.59", 0.0, 0.60),
    ("0.60–0.69", 0.60, 0.70),
    ("0.70–0.79", 0.70, 0.80),
    ("0.80–0.89", 0.80, 0.90),
    ("0.90–1.00", 0.90, 1.01),
]
FINE_BUCKETS = [
    ("0.00–0.50", 0.00, 0.50),
    ("0.50–0.70", 0.50, 0.70),
    ("0.70–0.85", 0.70, 0.85),
    ("0.85–0.95", 0.85, 0.95),
    ("0.95–1.00", 0.95, 1.001),
]

# Date shapes accepted by validation.
DATE_SHAPES = [
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$",
    r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$",
    r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$",
]


def safe_rate(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; 0 when the whole is not positive."""
    return F.when(whole > 0, F.round(part / whole * 100.0, 1)).otherwise(0.0)


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / whole, 0 when the whole is 0, rounded unless ``digits`` is None."""
    value = part / whole
    return F.when(whole > 0, value if digits is None else F.round(value, digits)).otherwise(0.0)


def harmonic(p: Column, r: Column, digits: int = 4) -> Column:
    """Harmonic mean of two rates, 0 when both are 0."""
    return F.when(p + r > 0, F.round(2.0 * p * r / (p + r), digits)).otherwise(0.0)


def mean4(value: Column | str) -> Column:
    """Aggregate mean of four-decimal values, rounded half away from zero in integers: no row-order effect."""
    col = F.col(value) if isinstance(value, str) else value
    total, n = F.sum(F.round(col * 10_000).cast("long")), F.count(col)
    size = F.floor((2 * F.abs(total) + n) / (2 * n))
    return F.when(n > 0, F.signum(total).cast("long") * size / 10_000)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def reason_category(code: Column) -> Column:
    """Category of a review reason code; unknown codes count as validation."""
    table = F.create_map(*[F.lit(x) for pair in REASON_CATEGORY.items() for x in pair])
    return F.when(code.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_element_at(table, code), F.lit("validation"))
    )


def bucket(value: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Label of the interval holding the value; null outside all of them."""
    label = F.when(value >= 1.0, edges[-1][0])
    for name, low, high in edges:
        label = label.when((value >= low) & (value < high), name)
    return label


def parse_amount(text: Column) -> Column:
    """Strict decimal after currency marks and separators; null when anything else remains."""
    s = strip(F.regexp_replace(strip(text), r"(?i)^([$€£]|RM|USD|EUR)\s*", ""))
    s = strip(F.regexp_replace(s, r"(?i)\s*([$€£]|RM|USD|EUR)$", ""))
    s = (
        F.when(s.contains(",") & ~s.contains("."), F.replace(s, F.lit(","), F.lit(".")))
        .when(s.contains(","), F.replace(s, F.lit(","), F.lit("")))
        .otherwise(s)
    )
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))


def is_date_text(text: Column) -> Column:
    """True when the text has one of the accepted date shapes and at least four characters."""
    s = strip(text)
    hit = F.lit(False)
    for shape in DATE_SHAPES:
        hit = hit | s.rlike(shape)
    return (F.char_length(s) >= 4) & hit


def plausible_date(day: Column, month: Column, year: Column, low: int = 1990, high: int = 2035) -> Column:
    """Range check only, no calendar; two-digit years are in the 2000s."""
    y = F.when(year < 100, year + 2000).otherwise(year)
    return y.between(low, high) & month.between(1, 12) & day.between(1, 31)


def derive_seed(seed: int, document: Column, degradation: Column, severity: Column, preprocessing: Column) -> Column:
    """Stable 32-bit seed of one (document, condition) cell."""
    key = F.concat_ws(
        ":", F.lit(str(seed)), document.cast("string"), degradation, severity.cast("string"), preprocessing
    )
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def signal_id(kind: Column, field: Column, document_type: Column, period: str) -> Column:
    """Identifier of a derived signal, the same in every run."""
    raw = F.concat_ws(
        ":", kind, F.coalesce(field, F.lit("global")), F.coalesce(document_type, F.lit("all")), F.lit(period)
    )
    return F.concat(F.lit("sig_"), F.lower(kind), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 10))


def quad_to_bbox(points: Column, widen: bool = False) -> Column:
    """Bounding struct of ``[x1,y1,...,x4,y4]``; ``widen`` gives zero-extent boxes one unit."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    if widen:
        x1 = F.when(x1 <= x0, x0 + 1.0).otherwise(x1)
        y1 = F.when(y1 <= y0, y0 + 1.0).otherwise(y1)
    return F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"))


def scale_bbox(box: Column, width: Column, height: Column) -> Column:
    """Page-relative box: divided by the page size, clamped to [0, 1], un-inverted, five decimals."""
    x = [clamp01(box[c] / width) for c in ("x_min", "x_max")]
    y = [clamp01(box[c] / height) for c in ("y_min", "y_max")]
    return F.struct(
        F.round(F.least(*x), 5).alias("x_min"),
        F.round(F.least(*y), 5).alias("y_min"),
        F.round(F.greatest(*x), 5).alias("x_max"),
        F.round(F.greatest(*y), 5).alias("y_max"),
    )


def confident_tokens(tokens: Column, minimum: float) -> Column:
    """Tokens ``struct<text, confidence>`` clamped to [0, 1], filtered, with stripped text."""
    cleaned = F.transform(
        tokens,
        lambda t: F.struct(
            strip(t["text"]).alias("text"), clamp01(F.coalesce(t["confidence"], F.lit(0.0))).alias("confidence")
        ),
    )
    return F.filter(cleaned, lambda t: t["confidence"] >= minimum)


def join_address(parts: Column) -> Column:
    """Join address lines: a space after ``,`` or ``-``, nothing before ``,``, else a comma and a space."""
    return F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.element_at(parts, 1),
        lambda text, part: F.concat(
            text,
            F.when(text.endswith(",") | text.endswith("-"), F.lit(" "))
            .when(part.startswith(","), F.lit(""))
            .otherwise(F.lit(", ")),
            part,
        ),
    )


def array_distortion(original: Column, changed: Column) -> Column:
    """MSE, MAE, PSNR (100 for identical arrays) and relative mean drop of two numeric arrays."""
    n = F.size(original)
    pairs = F.zip_with(original, changed, lambda a, b: (a - b).cast("double"))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mse = total(F.transform(pairs, lambda d: d * d)) / n
    mae = total(F.transform(pairs, lambda d: F.abs(d))) / n
    before, after = total(original) / n, total(changed) / n
    drop = F.when(before <= 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), (before - after) / before))
    psnr = F.when(mse == 0, 100.0).otherwise(10.0 * F.log10(F.lit(255.0 * 255.0) / mse))
    return F.struct(mse.alias("mse"), mae.alias("mae"), psnr.alias("psnr"), drop.alias("mean_drop"))
