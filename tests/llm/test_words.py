import random
import re

import numpy as np
import pyarrow as pa

from leafscore.llm.words import HASH_BLOCK, ngrams, seen_before, slices, span_hashes, texts_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def samples(seed, n=200):
    rng = random.Random(seed)
    alphabet = ["a", "B", "é", "字", " ", "\n", "\t", "\x0b", "\x1f", " ", "ab"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, ""]


def test_words_and_hashes_match_python():
    texts = samples(1)
    words = words_of(texts_of(pa.array(texts)), lower=False)
    want = [(d, w) for d, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert words.doc.tolist() == [d for d, _ in want]
    by_word = {}
    for (_, w), h in zip(want, words.hash.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_lower_case_is_ascii_only():
    words = words_of(texts_of(pa.array(["AbC É", "abc é"])), lower=True)
    a, b, c, d = words.hash.tolist()
    assert a == c and b != d


def test_ngrams_stay_within_texts():
    words = words_of(texts_of(pa.array(["a b c", "a b", "c a b c"])))
    at, hashes = ngrams(words, 3)
    assert words.doc[at].tolist() == [0, 2, 2]
    assert hashes[0] == hashes[2] != hashes[1]
    assert len(ngrams(words, 9)[0]) == 0


def test_hash_of_a_word_longer_than_a_block_and_of_offset_arrays():
    long = "y" * (3 * HASH_BLOCK)
    column = pa.array(["skip", f"a {long} b", long, "skip"]).slice(1, 2)
    words = words_of(texts_of(column))
    assert words.hash[1] == words.hash[3] and len(set(words.hash.tolist())) == 3


def test_span_hashes_do_not_depend_on_position():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = span_hashes(data, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert len(set(h.tolist())) == 1


def test_seen_before_counts_within_a_text():
    earlier, times = seen_before(np.array([0, 0, 1, 0]), np.array([7, 8, 7, 7], np.uint64))
    assert earlier.tolist() == [False, False, False, True] and times.tolist() == [2, 1, 1, 2]


def test_slices_hold_every_row_once():
    texts = ["a" * 10, None, "b" * 500, "", "c" * 30, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "text"])
    parts = list(slices(batch, 40))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 40 or p.num_rows <= 3 for p in parts)
