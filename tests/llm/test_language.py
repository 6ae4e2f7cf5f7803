import random

import numpy as np
import pyarrow as pa
import pytest

from leafscore.llm.language import DIMENSIONS, fit_language, identify, presence
from leafscore.llm.words import texts_of

SYLLABLES = {"xx": ["ka", "ro", "mi", "te"], "yy": ["scht", "ü", "berg", "ein"], "zz": ["ção", "lhe", "nha", "em"]}


def rows(n, seed, start=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40)))
        out.append((start + k, text, lang, "s"))
    return out


def test_held_out_accuracy(make):
    model = fit_language(make(rows(600, 1)), sample_per_language=60, landmarks_per_language=8)
    held = rows(300, 2, 10_000)
    found = {r.doc_id: r for r in identify(make(held), model, ["doc_id"]).collect()}
    right = sum(found[k].lang_pred == lang for k, _, lang, _ in held)
    assert right >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_presence_is_a_set_kernel():
    x = presence(texts_of(pa.array(["abab", "ab", "abababab", "", None])))
    assert x.shape == (5, DIMENSIONS)
    assert np.allclose(x[0], x[2]) and np.allclose((x[:3] ** 2).sum(1), 1) and not x[3:].any()


def test_odd_rows(make, odd_rows):
    docs = make(odd_rows + rows(60, 3, 100))
    model = fit_language(docs)
    got = identify(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows) + 60
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3, 4))
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (5, 6, 7, 8, 9))


def test_nothing_to_learn_from(make):
    empty = fit_language(make([]))
    assert empty.names == ()
    assert [r.lang_pred for r in identify(make([(1, "abc", "en", None)]), empty, ["doc_id"]).collect()] == ["und"]
    assert identify(make([]), empty, ["doc_id"]).count() == 0
    single = fit_language(make([(1, "abc", "en", None)]))
    assert [r.lang_pred for r in identify(make([(1, "abc", None, None)]), single, ["doc_id"]).collect()] == ["en"]


def test_no_language_is_left_out_silently(make):
    docs = make(rows(60, 6) + [(900, "solo words", "ww", "s")])
    assert fit_language(docs, max_languages=4).names == ("ww", "xx", "yy", "zz")
    with pytest.raises(ValueError, match="4 languages"):
        fit_language(docs, max_languages=3)
