"""Text and field normalization as JVM expressions; one Arrow UDF for Unicode composition."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the scoring protocol splits on it, and the characters stripped from field edges.
SPACE_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
EDGE_CHARS = " '\"`:,.;#~!?*[](){}"

_CONTROL = r"[\p{C}&&[^\n\r\t]]"
_BLANK_RUN = r"[\p{Z}\n\r\t]+"


@F.arrow_udf(T.StringType())
def _compose(values: pa.Array) -> pa.Array:
    if values.null_count == len(values):
        return values
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Unicode NFC. Only rows holding a non-ASCII character carry their text to Python."""
    return F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """White space of every kind (tabs, line ends, no-break spaces) cut from both ends."""
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def has_text(text: Column) -> Column:
    """Whether anything is left of the text when it is stripped."""
    return text.rlike("[^" + SPACE_CLASS[1:])


def _clean(text: Column, compose: bool) -> Column:
    value = F.coalesce(text, F.lit(""))
    return F.regexp_replace(nfc(value) if compose else value, _CONTROL, "")


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFC, control characters dropped, white space collapsed and stripped.

    ``compose=False`` keeps the expression inside whole-stage codegen, for columns known to be composed.
    """
    return F.trim(F.regexp_replace(_clean(text, compose), _BLANK_RUN, " "))


def normalize_field_text(text: Column, compose: bool = True) -> Column:
    """``normalize_text`` in lower case with quotes, punctuation and brackets stripped at both ends."""
    lowered = F.lower(_clean(text, compose))
    return F.btrim(F.trim(F.regexp_replace(lowered, _BLANK_RUN, " ")), F.lit(EDGE_CHARS))


def normalize_amount(text: Column, strict: bool = True) -> Column:
    """Canonical two-decimal amount from the first number in the text, else the lower-cased text.

    ``strict=True`` reads ``1,234.50`` as ``1`` (the scoring protocol); ``strict=False`` drops thousands commas.
    """
    s = strip(F.coalesce(text, F.lit("")))
    mark = rf"(?i)(?:RM|MYR|\$|{SPACE_CLASS})+"
    s = F.regexp_replace(F.regexp_replace(s, "^" + mark, ""), mark + "$", "")
    if not strict:
        s = F.regexp_replace(s, r"(?<=\p{Nd}),(?=\p{Nd}{3})", "")
    whole = F.regexp_extract(s, r"(\p{Nd}+)(?:\.(\p{Nd}+))?", 1)
    cents = F.regexp_extract(s, r"(\p{Nd}+)(?:\.(\p{Nd}+))?", 2)
    return F.when(whole == "", F.lower(s)).otherwise(F.concat(whole, F.lit("."), F.rpad(cents, 2, "0")))


def normalize_field(name: Column, value: Column, compose: bool = True) -> Column:
    """Amount rules for ``total``, text rules for every other field; null is the empty string."""
    return (
        F.when(value.isNull(), F.lit(""))
        .when(name == "total", normalize_amount(value))
        .otherwise(normalize_field_text(value, compose))
    )


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, SPACE_CLASS + "+")
    )


def normalized_words(text: Column) -> Column:
    """``words`` of a text that ``normalize_text`` made: it holds no white space but single spaces between words."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def humanize(code: Column) -> Column:
    """``low_confidence`` -> ``Low confidence``."""
    spaced = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.lower(F.substring(spaced, 2, 2**31 - 1)))


def contains_any(text: Column, keywords: list[str]) -> Column:
    """True when the text holds any keyword.

    One alternation instead of a chain of tests keeps generated code small; keywords that contain a shorter keyword
    add nothing and are left out.
    """
    least = [w for w in dict.fromkeys(keywords) if not any(o != w and o in w for o in keywords)]
    return text.rlike("|".join(rf"\Q{w}\E" for w in least))


def digit_ratio(text: Column) -> Column:
    """Share of characters that are decimal digits; 0 for empty text."""
    return F.when(F.char_length(text) > 0, F.regexp_count(text, F.lit(r"\p{Nd}")) / F.char_length(text)).otherwise(0.0)


def is_upper(text: Column) -> Column:
    """At least one cased character and none in lower or title case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def sanitize_filename(name: Column, fallback: Column) -> Column:
    """Base name with unsafe characters replaced and edge dots/underscores stripped; never empty."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    safe = F.regexp_replace(base, r"(?U)[^\w\s.\-]", "_")
    safe = F.btrim(F.regexp_replace(safe, r"(?U)\s+", "_"), F.lit("._"))
    return F.when(safe == "", F.concat(F.lit("document_"), fallback)).otherwise(safe)


def sniff_mime(head: Column) -> Column:
    """Media type from the first bytes of a file (hex prefixes of the published signatures)."""
    h = F.hex(head)
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .when(h.startswith("25504446"), "application/pdf")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff")
        .otherwise("application/octet-stream")
    )


def upload_check(head: Column, declared: Column, size: Column, limit: int) -> Column:
    """``struct(is_valid, mime, message, mismatch)`` of an uploaded file from its first bytes.

    Empty and oversized files fail before their format is looked at, unknown formats fail; the bytes decide the type,
    and ``mismatch`` says that another one was declared (``image/jpg`` counts as ``image/jpeg``). Null sizes count as 0.
    """
    mime = sniff_mime(F.coalesce(head, F.lit(b"")))
    named = F.coalesce(declared, F.lit(""))
    octets = "application/octet-stream"
    message = (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "File is empty.")
        .when(size > limit, f"File size exceeds maximum limit of {limit} bytes.")
        .when(mime == octets, "Unrecognized or unsupported file format signature.")
        .otherwise("")
    )
    looked_at = (F.coalesce(size, F.lit(0)) > 0) & (size <= limit)
    other = ~named.isin("", octets) & (F.when(named == "image/jpg", "image/jpeg").otherwise(named) != mime)
    return F.struct(
        (message == "").alias("is_valid"), F.when(looked_at, mime).otherwise("").alias("mime"), message.alias("message"),
        ((message == "") & other).alias("mismatch"))

