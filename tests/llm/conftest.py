import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = "row string, size long, target double, node long, score double, length long, draw double, kept boolean"


@pytest.fixture(scope="session")
def make(spark):
    """Build a documents table from (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""

    def build(rows, extra=True):
        schema = COLUMNS + (", " + CLASHES if extra else "")
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((doc_id, text, lang, source, None if text is None else len(text))
                        + (("x", 1, 2.0, 3, 4.0, 5, 6.0, True) if extra else ()))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, long texts, texts without letters."""
    long = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor. " * 4000
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, "123 456 !!", None, "a"),
        (5, "one two three four five six seven", "en", None), (5, "one two three four five six seven", "en", None),
        (5, "another text under a number already used", "en", "b"), (None, "one two three four five six seven", "en", "a"),
        (None, None, "en", "c"), (6, long, "en", "a"), (7, "x" * 300_000, "de", "b"), (8, " " * 300_000 + "é", "fr", "c"),
        (9, "line\nline\n\nline\n \nother", "de", "a"),
    ]
