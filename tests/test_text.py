import pytest
from pyspark.sql import functions as F

from leafscore.functions import text as T



@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("  \t\n ", ""), ("a  b\tc\n", "a b c"), ("é", "é"), ("a\x00b\x07c", "abc"),
    ("a​b", "ab"), ("a  b", "a b"), ("A\r\nB", "A B"),
])
def test_normalize_text(one, raw, want):
    assert one(T.normalize_text(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    (None, ""), (' "ABC Sdn. Bhd.",', "abc sdn. bhd"), ("[x]", "x"), ("a/b-c", "a/b-c"), ("***", ""), ("(12.50)", "12.50"),
])
def test_normalize_field_text(one, raw, want):
    assert one(T.normalize_field_text(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("10", "10.00"), ("10.5", "10.50"), ("10.555", "10.55"), ("RM 10.50", "10.50"), ("$", ""),
    ("rm10 MYR", "10.00"), ("1,234.50", "1.00"), ("Free", "free"), ("  12.3  ", "12.30"),
])
def test_normalize_amount(one, raw, want):
    assert one(T.normalize_amount(F.col("x")), x=raw) == want


def test_amount_without_strictness_drops_thousands(one):
    assert one(T.normalize_amount(F.col("x"), strict=False), x="1,234.50") == "1234.50"


@pytest.mark.parametrize("raw", ["", " ", "a", " a  b\tc ", "x y", "line\nline two"])
def test_words_match_python_split(one, raw):
    assert one(T.words(F.col("x")), x=raw) == raw.split()


@pytest.mark.parametrize("raw, want", [("ABC", True), ("A1", True), ("12", False), ("Abc", False), ("", False)])
def test_is_upper(one, raw, want):
    assert one(T.is_upper(F.col("x")), x=raw) is want


def test_humanize_and_keywords(one):
    assert one(T.humanize(F.col("x")), x="low_image_quality") == "Low image quality"
    assert one(T.contains_any(F.col("x"), ["GRAND TOTAL", "TOTAL", "NO."]), x="SUBTOTAL 3") is True
    assert one(T.contains_any(F.col("x"), ["NO."]), x="NOX") is False


@pytest.mark.parametrize("name, want", [
    ("a/b/../x y?.pdf", "x_y_.pdf"), ("...", "document_7"), ("scan 1.PDF", "scan_1.PDF"),
])
def test_sanitize_filename(one, name, want):
    assert one(T.sanitize_filename(F.col("x"), F.lit("7")), x=name) == want


@pytest.mark.parametrize("head, want", [
    (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"RIFF0000WEBP", "image/webp"),
    (b"RIFF0000WAVE", "application/octet-stream"), (b"%PDF-1.7", "application/pdf"), (b"II*\x00", "image/tiff"),
])
def test_sniff_mime(spark, head, want):
    row = spark.createDataFrame([(bytearray(head),)], "b binary").select(T.sniff_mime(F.col("b"))).first()
    assert row[0] == want
