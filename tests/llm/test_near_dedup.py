import os
import random
import re
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest

from leafscore.llm import near_dedup as nd
from leafscore.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k: k + size]) for k in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [(k, shingles(t, size)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_root, b_root = root(a), root(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {k: (len(s), root(k)) for k, s in sets}


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
    return " ".join(words)


def near_rows(seed):
    """Groups of copies of several degrees, short texts, and unrelated texts that share a long passage."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 6, 30, 150, 400]))]
        rows += [varied(rng, base, rng.choice([0, 0, 1, 2, 5, 9])) for _ in range(rng.randint(2, 9))]
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(rng.choice([8, 15, 30, 200]))]
        rows.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2:]))
    rows += ["a b", "a b", "A B", "b a", "", None, " ", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,size,rounds", [(1, 4, 3), (2, 5, 3), (3, 4, 0), (4, 4, 1)])
def test_components_match_brute_force(make, monkeypatch, seed, size, rounds):
    if seed % 2:  # small sketches, so that the sets exceed them
        for name, value in (("RETAINED", 32), ("LISTED", 48), ("ESTIMATED", 40)):
            monkeypatch.setattr(nd, name, value)
    rows = near_rows(seed)
    want = brute(rows, size, 80)
    found = nd.near_groups(make(rows), size=size, star_rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_star_of_copies_that_are_not_alike_among_themselves(make):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    rows = list(enumerate([varied(rng, base, 8) for _ in range(80)]))
    rows.insert(40, (1000, " ".join(base)))
    found = nd.near_groups(make(rows), size=5).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in brute(rows, 5, 80).items()}


def test_long_lists_go_block_by_block(make, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "LISTED", 100)
    rows = near_rows(5)
    found = nd.near_groups(make(rows), size=4, star_rounds=0).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in brute(rows, 4, 80).items()}


def test_many_copies_that_are_not_linked_make_few_rows(make, spark, monkeypatch):
    """Copies of one long text that differ too much from each other, and some that do not: rows stay in proportion."""
    monkeypatch.setattr(nd, "BLOCK", 32)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(900)]
    rows = [(k, varied(rng, base, 20)) for k in range(120)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(10)]
    made = []
    plain = nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, label: made.append((label, out := plain(df, label))) or out)
    found = nd.near_groups(make(rows), size=5, star_rounds=0).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in brute(rows, 5, 80).items()}
    assert dict(made)["links"].count() < len(rows)


def test_sketches_travel_for_open_pairs_only_and_spent_tables_go(make, monkeypatch):
    """A member that all others of a list meet under an earlier value brings no sketch; sketches and sets do not stay on disk."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, varied(rng, base, 12)) for k in range(60)]
    made = []
    plain = nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, label: made.append((label, out := plain(df, label))) or out)
    found = nd.near_groups(make(rows), size=5, star_rounds=0).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: c for k, (_, c) in brute(rows, 5, 80).items()}
    tables = dict(made)
    assert 0 < tables["open-members"].count() < tables["open-lists"].count()
    assert not [label for label in ("sketches", "sets") for f in tables[label].inputFiles() if os.path.exists(urlparse(f).path)]


def test_low_bits_never_put_what_sketches_share_too_low():
    """Values that are alike in the low bits, in one sketch or in two, count at least as often as whole values would."""
    shared = [[7, 7, 8, 9], [7, 7, 8, 10], [1, 2, 3, 4]]
    group = pa.table({
        "component": [0, 1, 2], "block": [0, 0, 0], "low": [0] * 3, "high": [0] * 3, "n": [4, 4, 4], "node": [0, 1, 2],
        "earlier": pa.array([[], [], []], pa.list_(pa.int64())), "sketch": pa.array(shared, pa.list_(pa.int32()))})
    assert nd.near_members(group, 60, 512).column("node").to_pylist() == [0, 1]


def test_common_sizes_in_parts():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(300), rng.randint(0, 80))) for _ in range(40)]
    left, right = np.arange(25), np.arange(25, 40)
    got = nd.common_sizes(pa.array(sets, pa.list_(pa.int64())), left, right, columns=7)
    assert got.tolist() == [[len(set(sets[a]) & set(sets[b])) for b in right] for a in left]


def test_odd_rows_and_empty_table(make, odd_rows):
    found = nd.near_groups(make(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for r in found if r.doc_id in (1, 2, 3))
    docs = make(odd_rows + [(70, "one two three four five six seven")])
    stay = nd.near_dedup(docs)
    assert stay.columns == docs.columns and 70 not in {r.doc_id for r in stay.collect()}
    assert nd.near_groups(make([])).count() == 0 and nd.near_dedup(make([])).count() == 0


def test_sure_overlap_is_the_binomial_bound():
    assert nd.sure_overlap(0.8, 80, 1e-10) == 38 and nd.sure_overlap(1.0, 10, 1e-10) == 10
    assert nd.sure_overlap(0.8, nd.LISTED) > 0.6 * nd.LISTED


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 180)] + [(300, 300), (400, 401), (401, 400)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(51)) and all(found[k] == 100 for k in range(100, 180))
    assert found[401] == found[400] == 400 and 300 not in found


def test_a_repeated_id_loses_only_the_text_that_is_a_copy(make):
    first, other = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = [(1, first), (5, first + " end"), (5, other), (9, other + " end")]
    assert {(r.doc_id, r.text) for r in nd.near_dedup(make(rows)).collect()} == {rows[0], rows[2]}
