import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from leafscore.llm.periodic import find_runs, lyndon, runs_of, stretches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lyndon(x, sign):
    """Distance to the next smaller suffix, the end being smallest."""
    y = [sign * c for c in x]
    return [next((j - i for j in range(i + 1, len(y)) if y[j:] < y[i:]), len(y) - i) for i in range(len(y))]


def brute_runs(x, exponent=4, shortest=6):
    found, n = {}, len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text, exponent=4):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return runs, [w for i, w in enumerate(words) if i not in gone]


def looping(rng, size, letters):
    out = []
    while len(out) < size:
        block = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            block = block * rng.randint(1, 3) + block[: rng.randint(0, len(block))]
        out += (block * rng.randint(1, 7))[: rng.randint(1, 60)]
    return out[:size]


@pytest.mark.parametrize("seed", range(6))
def test_lyndon_arrays_match_brute_force(seed):
    rng = random.Random(seed)
    parts = [looping(rng, rng.randint(0, 60), range(1, 1 + rng.randint(1, 4))) for _ in range(40)]
    codes = np.array([c for p in parts for c in p], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for sign in (1, -1):
        length, group = lyndon(sign * codes, bounds)
        assert length.tolist() == [v for p in parts for v in brute_lyndon(p, sign)]
        for k, p in enumerate(parts):
            words = [tuple(p[i: i + length[bounds[k] + i]]) for i in range(len(p))]
            numbers = group[bounds[k]: bounds[k + 1]].tolist()
            assert len(set(words)) == len(set(numbers)) == len(set(zip(words, numbers, strict=True)))


@pytest.mark.parametrize("seed", range(8))
def test_runs_match_brute_force(seed):
    rng = random.Random(100 + seed)
    parts = [looping(rng, rng.randint(0, 150), range(1, 1 + rng.randint(1, 5))) for _ in range(30)]
    parts += [[1] * 40, [1, 2] * 3 + [1], [1, 1, 1, 2] * 9, list(range(50)), list(range(20)) * 4, (list(range(20)) * 4)[:-1]]
    codes = np.array([c + 1000 for p in parts for c in p], np.uint64)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    base = np.cumsum([0] + [len(p) for p in parts])
    want = sorted((int(base[k]) + s, n, q) for k, p in enumerate(parts) for s, n, q in brute_runs(p))
    found = runs_of(codes, *stretches(codes, doc))
    assert sorted(zip(found.start.tolist(), found.length.tolist(), found.period.tolist(), strict=True)) == want


def test_rows_match_brute_force_with_planted_loops(make, odd_rows):
    rng = random.Random(5)
    vocabulary = ["la", "de", "été", "字", "x", "Y."]
    rows = [(k, rng.choice([" ", "\n", " \t "]).join(looping(rng, rng.randint(0, 120), vocabulary[: rng.randint(1, 6)])) + rng.choice(["", " "]))
            for k in range(300)]
    rows += odd_rows + [(10**15 + 7, "loop it " * 5), (77, "a" * 100 + " b" * 5000)]
    table = make(rows)
    found = find_runs(table, keep=("doc_id", "text"), plant=True).collect()
    assert len(found) == len(rows)
    for r in found:
        runs, kept = brute_row(r.doc_id, r.text) if (r.text or "").count(" ") < 6000 else (None, None)
        if runs is None:
            continue
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
        assert r.n_words == len(WORD.findall(r.text or ""))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_one_very_long_period(make):
    words = [f"w{k}" for k in range(3000)]
    found = find_runs(make([(3, " ".join(words * 4 + words[:17]))])).first()
    assert [tuple(x) for x in found.runs] == [(0, 12017, 3000)]
    assert found.collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_empty_table_and_bad_argument(make):
    assert find_runs(make([])).count() == 0
    with pytest.raises(ValueError):
        find_runs(make([]), exponent=2)


def test_query_reports_the_greatest_exponent(spark, tmp_path, make):
    from leafscore.llm.queries import op13_runs

    rng = random.Random(9)
    rows = [(k, " ".join(looping(rng, rng.randint(0, 100), "abc"))) for k in range(200)] + [(None, None), (500, "")]
    make(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_runs(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        runs, _ = brute_row(r.doc_id, texts[r.doc_id])
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
