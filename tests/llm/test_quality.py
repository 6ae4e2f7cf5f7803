import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from leafscore.llm.quality import fit_calibration, fit_quality, margins, measures, quality_rules, vectors
from leafscore.llm.words import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def labelled(make, spark, n=400):
    rng = random.Random(4)
    good = [(k, " ".join(rng.choice(["river", "stone", "garden", "morning", "quiet"]) + rng.choice(["", "s", "."]) for _ in range(80))) for k in range(n)]
    bad = [(n + k, " ".join(rng.choice(["buy", "###", "$$$", "click", "|"]) + rng.choice(["!", "%"]) for _ in range(80))) for k in range(n // 2)]
    labels = spark.createDataFrame([(k, int(k < n), 0) for k, _ in good + bad if k % 2] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    return make(good + bad), labels


def test_measures_match_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "é#", "c|"]) + rng.choice(["", "\n", "\n\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "\n\n", "a\na\n a\na"]
    found = measures(texts_of(pa.array(texts)))
    for k, t in enumerate(texts):
        assert tuple(int(v[k]) for v in found.values()) == brute(t)


def test_margins_equal_vectors_times_weights(make, spark):
    docs, labels = labelled(make, spark)
    model = fit_quality(docs, labels)
    texts = texts_of(pa.array(["river stone stone stone", "", None, "ab", "### buy"]))
    want = vectors(texts) @ np.concatenate([model.word, model.char]) + model.bias
    assert np.allclose(margins(texts, model), want, atol=1e-4)


def test_unlabelled_rows_are_told_apart_with_calibrated_probabilities(make, spark):
    docs, labels = labelled(make, spark)
    found = quality_rules(docs, fit_quality(docs, labels)).collect()
    assert all(r.kept == (r.doc_id < 400) for r in found if not r.base_failed)
    assert all(0 <= r.quality <= 1 for r in found)


def test_calibration_recovers_a_sigmoid():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = fit_calibration(x, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1


def test_odd_rows_and_labels(make, spark, odd_rows):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_rules(make(odd_rows), fit_quality(make(odd_rows), nothing)).collect()
    assert len(found) == len(odd_rows)
    assert all(r.base_failed and not r.kept for r in found if r.n_words < 50)
    one_kind = spark.createDataFrame([(6, 1), (6, 1), (7, 1)], "doc_id long, quality int")
    assert fit_quality(make(odd_rows), one_kind).shift > 0
    assert quality_rules(make([]), fit_quality(make([]), nothing)).count() == 0
