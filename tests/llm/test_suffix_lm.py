import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafscore.llm import suffix_lm
from leafscore.llm.suffix_lm import END, contexts, fit_suffix_tree, score_texts, stream, token_scores, word_counts
from leafscore.llm.words import Words, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n, seed, start=0):
    """A second-order source: the next word depends on the last two."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["go"]
        for _ in range(rng.randint(5, 60)):
            last = words[-1]
            words.append({"new": "york" if rng.random() < 0.9 else "car", "york": "city" if words[-2:-1] == ["new"] else "ham"}.get(
                last, rng.choice(["new", "old", "York", "red", f"w{rng.randint(0, 300)}"])))
        out.append((start + k, " ".join(words)))
    return out


def fitted(docs):
    counts = word_counts(docs)
    return counts, fit_suffix_tree(docs, counts, context_share=1e-3)


def test_stream_and_contexts_stay_within_texts():
    tokens = stream(texts_of(pa.array(["a b", "", None, "A"])))
    assert tokens.doc.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert [h == END for h in tokens.hash] == [False, False, True, True, True, False, True]
    assert tokens.hash[0] == tokens.hash[5]
    assert contexts(tokens, 1)[1].tolist() == [1, 2, 6] and contexts(tokens, 2)[1].tolist() == [2]


def test_base_scores_match_brute_force_and_the_tree_beats_them(make, odd_rows):
    rows, held = corpus(400, 1), corpus(60, 2, 10_000) + [(r[0] and r[0] + 20_000, r[1]) for r in odd_rows]
    counts, model = fitted(make(rows))
    tokens = {t: [*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows + held}
    seen = Counter(w for _, t in rows for w in tokens[t])
    total, distinct = sum(seen.values()), len(seen)
    gain = 0
    for r in score_texts(make(rows + held), counts, model, ["doc_id", "text"]).collect():
        words = tokens[r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(seen[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in words), abs=1e-6)
        if r.doc_id and 10_000 <= r.doc_id < 20_000:
            gain += r.score - r.base_score
    assert gain > 60
    assert len(model.levels) == 2 and len(model.levels[1].states)


def test_probabilities_of_a_context_add_up_to_one(make):
    counts, model = fitted(make(corpus(400, 3)))
    vocabulary = [(int(r.key), r.n) for r in counts.collect()]
    root = {k: (n - model.discount) / model.tokens for k, n in vocabulary}
    unseen = model.discount * model.distinct / model.tokens
    assert sum(root.values()) + unseen == pytest.approx(1)
    for history in (["new"], ["york"], ["new", "york"], ["w1"], ["nowhere"]):
        h = stream(texts_of(pa.array([" ".join(history)]))).hash[: len(history)]
        total = 0.0
        for key, p in [*root.items(), (12345, unseen)]:
            hashes = np.append(h, np.array([key], np.int64).view(np.uint64))
            n = np.arange(len(hashes))
            score, open_, _ = token_scores(Words(n, n, np.zeros(len(hashes), int), hashes), model)
            total += 10 ** score[-1] * (p if open_[-1] else 1)
        assert total == pytest.approx(1, abs=1e-6)


def test_nothing_to_learn_from(make, odd_rows):
    counts, model = fitted(make([]))
    found = score_texts(make(odd_rows), counts, model, ["doc_id"]).collect()
    assert len(found) == len(odd_rows)
    assert all((r.base_score, r.score, r.n_known, r.train_tokens) == (0, 0, 0, 0) for r in found)
    assert score_texts(make([]), counts, model, ["doc_id"]).count() == 0


def test_what_the_tree_keeps_does_not_depend_on_shares_of_the_corpus(make):
    """A context seen a few times stays a state, and its long context too, however much other text there is."""
    rng = random.Random(5)
    told = [(k, f"alpha beta gamma delta{k % 2} omega beta zeta delta{k % 2}") for k in range(8)]
    rest = [(100 + k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(200))) for k in range(300)]
    docs = make(told + rest)
    counts = word_counts(docs)
    model = fit_suffix_tree(docs, counts)
    states = {int(h) for level in model.levels for h in level.states}
    for history in ("alpha", "alpha beta", "omega beta", "gamma"):
        h = stream(texts_of(pa.array([history])))
        length = len(history.split())
        assert int(contexts(h, length)[0][0]) in states
    scored = {r.doc_id: r.score for r in score_texts(make(told + [(1000, told[0][1])]), counts, model, ["doc_id"]).collect()}
    by_token = token_scores(stream(texts_of(pa.array([told[0][1]]))), model)[0].sum()
    root = {int(r.key): (r.n - model.discount) / model.tokens for r in counts.collect()}
    root_sum = sum(math.log10(root[int(h)]) for h in stream(texts_of(pa.array([told[0][1]]))).hash.view(np.int64))
    assert scored[1000] == pytest.approx(scored[0]) == pytest.approx(by_token + root_sum)
    assert by_token > 10


def test_rare_keys_meet_the_tree_in_rounds(make, monkeypatch):
    """Whatever the number of rounds, each takes a part of the keys, and together they give the same scores."""
    rows = corpus(120, 7)
    docs = make(rows + corpus(20, 8, 1000))
    counts = word_counts(make(rows))
    model = fit_suffix_tree(make(rows), counts, frequent=0.05)
    made, plain = [], suffix_lm.stored
    monkeypatch.setattr(suffix_lm, "stored", lambda df, label: made.append((label, out := plain(df, label))) or out)
    scores = []
    for bits in (1, 3):
        monkeypatch.setattr(suffix_lm, "ROUND_BITS", bits)
        made.clear()
        scores.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in score_texts(docs, counts, model, ["doc_id"]).collect()})
        rounds = [out for label, out in made if label.startswith("rare-sums")]
        assert len(rounds) == 2**bits and all(out.count() for out in rounds)
    assert len(scores[0]) == 140
    assert all(scores[1][k] == pytest.approx(v) for k, v in scores[0].items())


def test_pairs_are_counted_across_flushes_tasks_and_parts(make, odd_rows):
    docs = make(corpus(60, 9) + odd_rows).repartition(3)

    def pairs(tokens):
        at = np.flatnonzero(tokens.doc[:-1] == tokens.doc[1:])
        return tokens.hash[:-1][at], tokens.hash[1:][at]

    want = Counter()
    for r in docs.collect():
        found = stream(texts_of(pa.array([r.text], pa.string())))
        want.update(zip(*(v.view(np.int64).tolist() for v in pairs(found)), strict=True))
    for least in (1, 3):
        out = suffix_lm.tallied(docs, pairs, least)
        assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()  # no row for a pair that goes
        rows = out.collect()
        assert {(r.context, r.suffix): r.n for r in rows} == {k: n for k, n in want.items() if n >= least} and len(rows) == len({r.key for r in rows})
        first, last = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in range(2))
        assert (suffix_lm.pair_hash(first, last).view(np.int64) == [r.key for r in rows]).all()
    rng = np.random.default_rng(1)
    first, last = rng.integers(0, 9, 5_000).astype(np.uint64), rng.integers(0, 40, 5_000).astype(np.uint64)
    tally, got = suffix_lm.Tally(4, limit=100), Counter()
    batches = [b for i in range(0, 5_000, 70) for b in tally.add(first[i: i + 70], last[i: i + 70])] + list(tally.flush())
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            c = len(packed) // 20
            a, b = (np.frombuffer(packed, np.uint64, c, 8 * k * c) for k in range(2))
            assert (suffix_lm.pair_hash(a, b) >> np.uint64(60) == part).all()
            for x, y, n in zip(a.tolist(), b.tolist(), np.frombuffer(packed, np.uint32, c, 16 * c).tolist(), strict=True):
                got[x, y] += n
    assert len(batches) > 3 and got == Counter(zip(first.tolist(), last.tolist(), strict=True))
    assert list(suffix_lm.Tally(4).flush()) == [] and suffix_lm.tallied(make([]), pairs).count() == 0
