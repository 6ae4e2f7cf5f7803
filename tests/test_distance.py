import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafscore.functions import distance as D
from leafscore.operators import compare as C
from leafscore.operators import scoring as S


def table(a, b):
    """Textbook distance table."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_sequence_distance_matches_table(a, b):
    assert D.sequence_distance(a, b) == table(a, b)
    assert D.sequence_distance(a.split(), b.split()) == table(a.split(), b.split())


def test_long_sequences():
    rng = random.Random(3)
    for size in (63, 64, 65, 300):
        a = "".join(rng.choice("abcdef") for _ in range(size))
        b = "".join(c for c in a if rng.random() > 0.1) + "zz"
        c = "".join(rng.choice("abcdef") for _ in range(size // 2))
        assert D.sequence_distance(a, b) == table(a, b)
        assert D.sequence_distance(a, c) == table(a, c)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=3, max_size=30), st.text("abc", max_size=34), st.integers(1, 12))
def test_band_is_exact_up_to_its_width(a, b, k):
    if not (k < len(a) <= len(b) <= len(a) + k):
        return
    want, got = table(a, b), D._banded_distance(a, b, k)
    assert got == want if want <= k else got > k


def test_band_is_used_for_long_sequences(monkeypatch):
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2600))
    for b in (a.replace("e", "c"), "".join(c for c in a if rng.random() > 0.03) + "x" * 9, a[::-1]):
        assert D.sequence_distance(a, b) == D._full_distance(*sorted((a, b), key=len))


EDGES = [("", ""), ("", "abc"), ("abc", ""), ("abc", "abc"), ("abcdef", "abc"), (" ", "a b"), ("é", "e"), ("a b c", "a x c d")]


def rates(p, g):
    d, w = table(p, g), table(p.split(), g.split())
    n, m = len(g), len(g.split())
    cer = (0.0 if not p else 1.0) if n == 0 else d / n
    wer = (0.0 if not p.split() else 1.0) if m == 0 else w / m
    ned = 1.0 if not p and not g else 0.0 if not p or not g else max(0.0, 1 - d / max(len(p), n))
    return cer, wer, ned


@pytest.mark.parametrize("long_texts", [True, False])
def test_rates_on_edge_rows(spark, long_texts):
    p, g = F.col("p"), F.col("g")
    rows = spark.createDataFrame(EDGES, "p string, g string").select(
        "p", "g", D.cer(p, g, long_texts), D.wer(p, g, long_texts), D.char_ned(p, g, long_texts)).collect()
    for r in rows:
        assert tuple(r)[2:] == pytest.approx(rates(r[0], r[1])), r


def test_whole_documents_against_the_table(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "béta", "gamma", "delta", "the", "other"]
    pairs = []
    for i in range(6):
        words = [rng.choice(vocabulary) for _ in range(60 + 20 * i)]
        g = " ".join(words)
        p = g if i == 0 else "".join(c for c in g if rng.random() > 0.05).replace("e", "c")
        pairs.append((i, p, g))
    out = S.score_text(spark.createDataFrame(pairs, "document_id int, pred string, gt string")).collect()
    for r in out:
        cer, wer, ned = rates(r["pred"], r["gt"])
        assert (r["cer_raw"], r["wer_raw"], r["char_ned_raw"]) == pytest.approx((cer, wer, ned), abs=5.1e-5)
        assert r["char_edit_distance_raw"] == table(r["pred"], r["gt"])


def test_null_and_control_characters_only_count_raw(spark):
    row = S.score_text(spark.createDataFrame([(1, None, "a\x07b"), (2, "ab", "a\x07b")], "document_id int, pred string, gt string"))
    got = {r["document_id"]: r for r in row.collect()}
    assert got[1]["cer_raw"] == 1.0 and got[1]["char_ned_normalized"] == 0.0
    assert got[2]["cer_normalized"] == 0.0 and got[2]["cer_raw"] == pytest.approx(0.3333)


def test_run_compare(spark):
    a = "the quick brown fox " * 20
    b = a.replace("quick", "quack")
    rows = spark.createDataFrame([(1, a, b, 3, 5), (2, a, a + "  ", 3, 3)], "document_id int, text_a string, text_b string, tokens_a int, tokens_b int")
    got = {r["document_id"]: r for r in C.run_compare(rows).collect()}
    assert not got[1]["exact_text_match"] and got[1]["token_diff"] == 2
    assert got[1]["cer"] == pytest.approx(20 / len(a.strip()), abs=1e-4) and got[1]["wer"] == 0.25
    assert got[2]["exact_text_match"] and got[2]["ned"] == 1.0
    one = C.run_agreement(C.run_compare(rows)).first()
    assert one["exact_text_match_rate"] == 0.5 and one["token_count_diff_sum"] == 2



def test_rows_with_very_many_words_take_the_long_form(spark):
    """More distinct words than the dictionary alphabet: exact, in the same column as short rows."""
    many = [f"w{i}" for i in range(3000)]
    other = many[:1000] + ["x"] + many[1200:]
    rows = [(" ".join(many), " ".join(other)), ("a b", "a c"), ("a", "a"), (None, "a"), ("w " * 3000, "w " * 2999)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(
        D.word_distance(F.col("a"), F.col("b"), long_texts=False)).collect()]
    assert got == [200, 1, 0, None, 1]
