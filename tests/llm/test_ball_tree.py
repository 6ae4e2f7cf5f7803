import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leafscore.llm import ball_tree
from leafscore.llm.ball_tree import build_tree, length_factors, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        rows = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def collection(rng, n):
    words = ["la", "De", "été", "字", "x1", "Straße", "foo", "bar"] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        size = rng.choice([0, 1, 3, 20, 60])
        rows.append((k, rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(size))))
    for k in range(40):  # copies, so many equal scores
        rows.append((n + k, rows[k % 7 + 3][1]))
    return rows


@pytest.mark.parametrize("seed,docs,leaf", [(1, 2048, 32), (2, 16, 3), (3, 64, 1)])
def test_search_matches_brute_force(make, spark, odd_rows, monkeypatch, seed, docs, leaf):
    rng = random.Random(seed)
    rows = collection(rng, 260) + [(r[0], r[1]) for r in odd_rows]
    items = [(k, " ".join(rng.choice(rows)[1].split()[:30]) if k % 3 else f"Été w{k} w{k} de ß") for k in range(25) if k != 7]
    items = [(i, t or "") for i, t in items] + [(90, None), (91, ""), (92, "nothing-known 12345678901"), (93, "w1 " * 50)]
    monkeypatch.setattr(ball_tree, "TREE_DOCS", docs)
    monkeypatch.setattr(ball_tree.build_tree, "__defaults__", (leaf,))
    asked = spark.createDataFrame(items + items[:1], "item_id long, text string")
    found = sorted(map(tuple, ranked_search(make(rows), asked).collect()), key=str)
    assert found == brute(rows, items)
    by_block = sorted(map(tuple, ranked_search(make(rows), asked, top=5, block_bytes=200).collect()), key=str)
    assert by_block == brute(rows, items, 5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    width, rows = 200, []
    for k in range(600):
        rows.append((20 * (k % 10) + np.arange(8), 500_000 + 10_000 * (k % 7) + rng.integers(0, 5_000, 8)))
    bounds = np.arange(601) * 8
    columns, exact = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    tree = build_tree(bounds, columns, exact.astype(float), width)
    full = np.zeros((600, width), np.int64)
    full[np.repeat(np.arange(600), 8), columns] = exact
    assert sorted(tree.order.tolist()) == list(range(600))
    for node in range(len(tree.low)):
        own = tree.order[tree.low[node]: tree.high[node]]
        assert (np.linalg.norm(full[own] - tree.centroid[:, node], axis=1) <= tree.radius[node]).all()
    items = ball_tree.Items([0], np.arange(width, dtype=np.uint64), np.array([0, 20]), np.arange(20), np.ones(20, np.int64))
    best = [ball_tree._Best(20)]
    opened = ball_tree.search(
        tree, bounds, columns, exact, list(range(600)), items, np.full(width, 5000), np.ones(width), best)
    scores = 5000 * full[:, :20].sum(axis=1)
    assert sorted(e[0] for e in best[0].heap) == sorted(scores.tolist())[-20:]
    assert opened < (tree.child < 0).sum() / 2


def test_length_factors_of_any_size():
    n = np.array([1, 10**9])
    assert length_factors(n, 3 * 10**10, 10**13).tolist() == [75, 75 + 25 * 10**9 * 3 * 10**10 // 10**13]


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(make([]), some).count() == 0
    assert ranked_search(make([(1, "a b")]), none).count() == 0
    assert ranked_search(make([(1, None), (2, "...")]), some).count() == 0
