import random
import re

import numpy as np
import pytest

from leafscore.operators import extraction as X

FULL = X.VOCABULARY["full"]


def frame(spark, *documents):
    rows = [(d, i, t) for d, tokens in enumerate(documents) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "document_id int, idx int, text string")


def by_doc(df):
    return {r["document_id"]: r for r in df.collect()}


def test_date_patterns_and_bonus(spark):
    got = by_doc(X.extract_date(frame(
        spark,
        ["ABC", "DATE", "25/12/2018 10:00"],
        ["25 Dec 2018"],
        ["2018-12-25 or 24/12/2018"],
        ["99/99/2018", "x 31.12.18 y"],
        ["01/02/1980"],
        ["DT: 1/2/2019", "3 March 2019"],
        ["123/12/20189"],
    )))
    want = {
        0: ("25/12/2018", 0.95, "regex_dmy"), 1: ("25 Dec 2018", 0.75, "regex_named_month"),
        2: ("2018-12-25", 0.7, "regex_ymd"), 3: ("31.12.18", 0.7, "regex_dmy"), 5: ("3 March 2019", 1.0, "regex_named_month"),
    }
    assert {d: (r["value"], r["confidence"], r["rule"]) for d, r in got.items()} == want


def test_two_dates_in_one_token(spark):
    rows = X.date_candidates(frame(spark, ["from 1/2/2019,3/4/2019 on"])).collect()
    assert sorted(r["value"] for r in rows) == ["1/2/2019", "3/4/2019"]


def test_total_rules(spark):
    got = by_doc(X.extract_total(frame(
        spark,
        ["SUBTOTAL 10.00", "TOTAL 12.00", "CASH 50.00"],
        ["GRAND TOTAL", "RM 9.50", "TOTAL 20.00"],
        ["TOTAL", "12.345", "5.00"],
        ["SUBTOTAL", "7.00"],
        ["TOTAL 8.00 9.00"],
    )))
    assert (got[0]["value"], got[0]["confidence"], got[0]["token_indices"]) == ("12.00", 0.85, [1])
    assert (got[1]["value"], got[1]["confidence"], got[1]["token_indices"]) == ("9.50", 0.95, [0, 1])
    assert 2 not in got and 3 not in got and got[4]["value"] == "9.00"


def test_total_fallback(spark):
    tokens = frame(spark, ["10.00", "CASH 30.00"], ["TOTAL 5.00", "thanks", "70.00"])
    assert 0 not in by_doc(X.extract_total(tokens))
    got = by_doc(X.extract_total(tokens, fallback_largest=True, fallback_penalty=0.4))
    assert (got[0]["value"], got[0]["confidence"], got[0]["rule"]) == ("30.00", 0.6, "fallback_largest_amount")
    assert got[1]["value"] == "5.00"


def test_company(spark):
    got = by_doc(X.extract_company(frame(
        spark, ["TAX INVOICE", "Happy Shop", "ABC SDN BHD"], ["12345678", "ab"], ["plain name"] , ["T"] * 10 + ["LATE SDN BHD"],
    )))
    assert (got[0]["value"], got[0]["confidence"]) == ("ABC SDN BHD", 0.99)
    assert 1 not in got and 3 not in got
    assert (got[2]["value"], got[2]["confidence"]) == ("plain name", 0.85)


def test_vocabulary_is_an_argument(spark):
    tokens = frame(spark, ["Corner CAFE", "MASA 1/2/2019"])
    assert by_doc(X.extract_company(tokens, "short"))[0]["confidence"] == 0.85
    assert by_doc(X.extract_date(tokens, "short"))[0]["confidence"] == 0.7
    assert by_doc(X.extract_date(tokens))[0]["confidence"] == 0.95


def plain_address(tokens, start, limit=6):
    """Sequential reading of the address rules, for comparison."""
    place = re.compile("|".join(map(re.escape, FULL["location"])))
    skip = re.compile("|".join(map(re.escape, FULL["address_negative"])))
    code = re.compile(r"\b\d{5}\b")
    score = lambda t: bool(place.search(t.upper())) + bool(code.search(t))
    picked, features = [], 0
    for i in range(start, min(len(tokens), start + 3 * limit)):
        t = tokens[i].strip()
        if any(w in t.upper() for w in X.ADDRESS_STOP):
            break
        if skip.search(t.upper()):
            continue
        digits = sum(c.isdigit() for c in t)
        if score(t):
            picked.append((i, t))
            features += score(t)
        elif picked and len(t) > 3 and digits / len(t) <= 0.6 and len(picked) < limit:
            picked.append((i, t))
    if not picked:
        hits = [(i, t.strip()) for i, t in enumerate(tokens) if score(t.strip()) and not skip.search(t.upper())][:3]
        picked, features = hits, len(hits)
    if not picked:
        return None
    text = picked[0][1]
    for _, t in picked[1:]:
        text += (" " if text[-1] in ",-" else "" if t.startswith(",") else ", ") + t
    return text, round(min(1.0, 0.65 + min(0.3, features * 0.1)), 4), [i for i, _ in picked]


ADDRESSES = [
    ["ABC SDN BHD", "NO. 1 JALAN ABC,", "TAMAN X 43000", "TEL 0312345", "near the river", "TOTAL 5.00", "JALAN LATE"],
    ["ABC SDN BHD", "TOTAL 3.00", "LOT 5", "KLANG", "50000 KL", "JALAN Z"],
    ["ABC SDN BHD", "hello", "world"],
    ["LOT 9-", "x", "12345678", "some words here", ", extra"],
    ["ABC SDN BHD"] + ["JALAN %d" % i for i in range(9)] + ["plain tail"],
    ["FAX NO. 1", "EMAIL JALAN"],
    ["ABC SDN BHD"] + ["filler"] * 20 + ["JALAN FAR", "PENANG"],
]


def test_address_matches_the_sequential_reading(spark):
    tokens = frame(spark, *ADDRESSES)
    company = X.extract_company(tokens)
    start = {r["document_id"]: max(r["token_indices"]) + 1 for r in company.collect()}
    got = by_doc(X.extract_address(tokens, company))
    for d, doc in enumerate(ADDRESSES):
        want = plain_address(doc, start.get(d, 0))
        have = (got[d]["value"], got[d]["confidence"], got[d]["token_indices"]) if d in got else None
        assert have == want, d


def test_extract_fields_and_boxes(spark):
    tokens = frame(spark, ["ABC SDN BHD", "NO. 1 JALAN ABC", "DATE 1/2/2019", "TOTAL 5.00"])
    rows = X.extract_fields(tokens)
    assert {r["field_name"]: r["value"] for r in rows.collect()} == {
        "company": "ABC SDN BHD", "address": "NO. 1 JALAN ABC, DATE 1/2/2019", "date": "1/2/2019", "total": "5.00"}
    boxes = spark.createDataFrame([(0, i, 0.1 * i, 0.2 * i, 0.1 * i + 0.05, 0.2 * i + 0.1) for i in range(4)],
                                  "document_id int, idx int, x_min double, y_min double, x_max double, y_max double")
    got = {r["field_name"]: r for r in X.field_union_bbox(rows, boxes).collect()}
    assert (got["address"]["x_min"], got["address"]["y_max"]) == (0.1, 0.5)


def test_lines_stand_in_for_missing_tokens(spark):
    tokens = frame(spark, ["only"])
    pages = spark.createDataFrame([(0, "ignored"), (5, " TOTAL 4.00 \n\n ABC ")], "document_id int, full_text string")
    rows = sorted(map(tuple, X.tokens_or_lines(tokens, pages).collect()))
    assert rows == [(0, 0, "only"), (5, 0, "TOTAL 4.00"), (5, 1, "ABC")]


BOXES = "document_id int, idx int, text string, x_min double, y_min double, y_max double"


def plain_lines(tokens):
    heights = sorted(b - a for _, _, _, _, a, b in tokens if b > a)
    n = len(heights)
    mid = 15.0 if not n else heights[n // 2] if n % 2 else (heights[n // 2 - 1] + heights[n // 2]) / 2
    tol = max(1.0, 0.5 * max(1.0, mid))
    lines, centres = [], []
    for t in sorted(tokens, key=lambda t: ((t[4] + t[5]) / 2, t[3])):
        c = (t[4] + t[5]) / 2
        if centres and abs(c - sum(centres) / len(centres)) <= tol:
            lines[-1].append(t)
            centres.append(c)
        else:
            lines.append([t])
            centres = [c]
    lines.sort(key=lambda line: min(t[4] for t in line))
    return [" ".join(t[2].strip() for t in sorted(line, key=lambda t: (t[3], t[4], t[1])) if t[2].strip()) for line in lines]


@pytest.mark.parametrize("drift", [0.0, 1.5, 3.0, 4.9, 7.0])
def test_reading_order_matches_the_sequential_reading(spark, drift):
    tokens = [(1, i, f"w{i} ", float((i * 37) % 100), i * drift + (i % 5) * 20.0, i * drift + (i % 5) * 20.0 + 10 + i % 3) for i in range(25)]
    tokens += [(1, 25, " ", 500.0, 0.0, 10.0)]
    got = X.reading_order(spark.createDataFrame(tokens, BOXES)).orderBy("line_no").collect()
    assert [r["text"] for r in got] == [t for t in plain_lines(tokens) if t]


def test_fast_reading_order_differs_only_on_drift(spark):
    level = [(1, i, f"w{i}", float(i), (i % 3) * 30.0, (i % 3) * 30.0 + 10) for i in range(9)]
    df = spark.createDataFrame(level, BOXES)
    assert [tuple(r) for r in X.reading_order(df, exact=False).orderBy("line_no").collect()] == [
        tuple(r) for r in X.reading_order(df).orderBy("line_no").collect()]


def dense_document(n):
    """One document whose tokens follow each other so closely that nothing can be cut, in steps of a sixteenth."""
    rng = random.Random(n)
    centres, y = [], 0.0
    for _ in range(n):
        y += rng.choice([0, 0, 1, 1, 2, 40]) / 16
        centres.append(y)
    return centres


def plain_line_numbers(centres, tol):
    total, n, line, out = 0.0, 0, 0, []
    for y in centres:
        if n and abs(y - total / n) > tol:
            total, n, line = 0.0, 0, line + 1
        total, n = total + y, n + 1
        out.append(line)
    return out


@pytest.mark.parametrize("cuts", [[], [1, 2, 3, 5], list(range(7, 4000, 13))])
def test_line_fold_is_the_same_however_it_is_cut(cuts):
    centres = np.array(dense_document(4000))
    found, total, n, line = [], np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int32)
    for a, b in zip([0, *cuts], [*cuts, 4000]):
        found += X.fold_lines(centres[a:b], np.array([0, b - a]), np.array([5.0]), total, n, line).tolist()
    assert found == plain_line_numbers(centres.tolist(), 5.0)


def test_many_segments_fold_at_once():
    rng = random.Random(2)
    parts = [dense_document(rng.choice([1, 2, 17, 60])) for _ in range(200)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    tol = np.array([rng.choice([1.0, 3.0, 5.0]) for _ in parts])
    zero = np.zeros(len(parts), np.int64)
    got = X.fold_lines(np.concatenate(parts), first, tol, np.zeros(len(parts)), zero, zero.astype(np.int32))
    assert got.tolist() == [v for p, t in zip(parts, tol) for v in plain_line_numbers(p, t)]


def test_a_document_of_very_many_tokens_spreads_over_slices(spark):
    """One segment in many slices, batches and partitions; line by line as the plain loop has it."""
    n = 60_000
    centres = dense_document(n)
    df = spark.createDataFrame([(1, i, f"w{i}", float(i % 7), y - 5, y + 5) for i, y in enumerate(centres)], BOXES).repartition(5)
    (rows, split), = X._by_size(df, 0.5, slices=9)
    cut = X._segments(rows, split, slices=9)
    assert cut.select("segment").distinct().count() == 1
    got = X.reading_lines(df, slices=9).select("idx", "line").toPandas().set_index("idx")["line"]
    order = sorted(range(n), key=lambda i: (centres[i], i % 7, i))
    want = plain_line_numbers([centres[i] for i in order], 5.0)
    assert got.loc[order].tolist() == want
    lines = X.reading_order(df, slices=9).orderBy("line_no").select("line_no").collect()
    assert [r[0] for r in lines] == list(range(1, want[-1] + 2))


def test_reading_order_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, "b", 9.0, 0.0, 10.0), (None, 2, "a", 1.0, 1.0, 11.0), (4, 1, " ", 0.0, 0.0, 0.0)], BOXES)
    assert [tuple(r) for r in X.reading_order(df).collect()] == [(None, 1, "a b")]
    assert X.reading_order(df.limit(0)).count() == 0


def test_large_and_small_documents_together(spark, monkeypatch):
    monkeypatch.setattr(X, "LARGE_DOCUMENT", 50)
    tokens = [(d, i, f"w{i}", float(i % 3), y - 5, y + 5) for d, n in ((1, 300), (2, 40), (3, 51)) for i, y in enumerate(dense_document(n))]
    df = spark.createDataFrame(tokens, BOXES)
    assert [split for _, split in X._by_size(df, 0.5, None)] == [False, True]
    got = sorted(map(tuple, X.reading_order(df).collect()))
    monkeypatch.setattr(X, "LARGE_DOCUMENT", 10_000)
    assert got == sorted(map(tuple, X.reading_order(df).collect()))
