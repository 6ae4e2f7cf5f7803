import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from leafscore.llm import repeats
from leafscore.llm.repeats import LENGTH, PLACES, cut, remove_repeats


def brute(rows):
    """One row per document in order: sizes, removed bytes, stretches and what is left."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            passage = data[i: i + LENGTH]
            if passage in seen:
                gone[i: i + LENGTH] = b"\1" * LENGTH
            seen.add(passage)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), spans, left))
    return out


def collection(rng, n):
    def prose(k):
        return " ".join(rng.choice(["la", "de", "été", "que", "tion", "mentre", "字", "sh", "onn", f"w{rng.randint(0, 99)}"]) for _ in range(k))

    shared = [prose(rng.randint(20, 90)) for _ in range(6)]
    whole = [prose(150) for _ in range(4)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.2:
            text = rng.choice(whole)
        elif kind < 0.3:  # near copies
            text = list(rng.choice(whole))
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice("xyz")
            text = "".join(text)
        elif kind < 0.7:  # passages in different surroundings, and twice in one text
            text = prose(rng.randint(0, 60)) + rng.choice(shared) + prose(rng.randint(0, 40)) + rng.choice(shared)[rng.randint(0, 30):]
        elif kind < 0.8:
            text = rng.choice(["=", "ab", "abc ", "0123456789"]) * rng.randint(1, 120)
        else:
            text = prose(rng.randint(0, 80))
        rows.append((k, text))
    return rows


def check(rows, found):
    want = {k: v for k, *v in brute(sorted(rows, key=lambda r: r[0]))}
    assert len(found) == len(rows)
    for r in found:
        n, removed, spans, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, spans), r.doc_id
        assert bytes(r.kept) == left and r.kept_sha256 == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("seed,frequent", [(1, 64), (2, 3), (3, 10)])
def test_matches_brute_force(make, monkeypatch, seed, frequent):
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rng = random.Random(seed)
    rows = collection(rng, 260)
    rows += [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "é" * 400), (1005, "q" * 50_000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    check(rows, remove_repeats(make(shuffled).repartition(5)).collect())


def test_edges_of_a_common_passage(make, monkeypatch):
    """A passage in many documents with other words before and after each time, with and without frequent anchors."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(k, "".join(rng.choice("ijklmn ") for _ in range(rng.randint(0, 200))) + passage + "".join(rng.choice("opq ") for _ in range(90)))
            for k in range(150)]
    for frequent in (10, 10_000):
        monkeypatch.setattr(repeats, "SAMPLED", 1)
        monkeypatch.setattr(repeats, "FREQUENT", frequent)
        check(rows, remove_repeats(make(rows)).collect())


def test_null_and_repeated_ids(make):
    rng = random.Random(3)
    a, b, c = ("".join(rng.choice("abcdef ") for _ in range(250)) for _ in range(3))
    rows = [(None, a), (5, a + b), (5, a + b), (5, c), (None, c + "!"), (7, b)]
    found = {(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(make(rows)).collect()}
    assert (None, 250, 250) in found and (None, 251, 250) in found and (7, 250, 250) in found
    assert (5, 500, 0) in found and (5, 250, 0) in found
    assert remove_repeats(make(rows)).count() == 6


def test_a_text_in_parts_and_empty_table(make, monkeypatch):
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(5000)).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    first, last, at, block, whole = cut(data, offsets)
    assert (np.diff(first) > 0).all() and (last[:-1] + 1 == first[1:]).all() and last[-1] == len(data) - LENGTH
    assert ((at >= last) & (at <= first + PLACES - 1)).all()
    monkeypatch.setattr(repeats, "PART_BYTES", 700)
    part = pa.RecordBatch.from_arrays([pa.array([data.tobytes().decode()]), pa.array([1])], names=["text", "ord"])
    pieces = [x for p in repeats._strings(np.zeros(0, np.uint64), False)([part]) for x in p.column("place").to_pylist()]
    covered = sorted(s for p in pieces for s in range(p >> 16, (p >> 16) + (p & 0xFF) + 1))
    assert covered == list(range(len(data) - LENGTH + 1))
    assert remove_repeats(make([])).count() == 0


def test_query_carries_the_digest_columns(spark, tmp_path, make):
    from leafscore.llm.queries import op11_repeats

    make(collection(random.Random(4), 80), extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_repeats(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
