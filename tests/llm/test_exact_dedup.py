import hashlib
import random

import pytest

from leafscore.llm.exact_dedup import exact_dedup, exact_groups


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("runs,fan_in", [(1, 2), (7, 2), (256, 16)])
def test_groups_match_brute_force(make, keep, runs, fan_in):
    rng = random.Random(runs)
    rows = [(k, rng.choice(["hot", "hot", "x", "", None, f"text {rng.randint(0, 60)}", "Hot"])) for k in range(600)]
    rng.shuffle(rows)
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    found = exact_groups(make(rows), keep, runs=runs, fan_in=fan_in).select(
        "row.doc_id", "row.text", "digest", "keep_id", "group_size", "kept").collect()
    assert len(found) == len(rows)
    for r in found:
        ids = groups[r.text or ""]
        best = min(ids) if keep == "smallest" else max(ids)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
        assert bytes(r.digest).hex() == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_repeated_rows_and_null_ids(make):
    docs = make([(3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "a")])
    stay = exact_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in stay) == [(False, 3, "a"), (True, None, "b")]
    assert exact_dedup(docs).columns == docs.columns


def test_odd_rows_and_empty_table(make, odd_rows):
    assert exact_dedup(make([])).count() == 0
    found = exact_dedup(make(odd_rows)).collect()
    assert len({r.text or "" for r in found}) == len(found) == len({t or "" for _, t, *_ in odd_rows})


def test_bad_arguments(make):
    with pytest.raises(ValueError):
        exact_groups(make([]), "first")
