import pytest

from leafscore.llm.mixing import mix, plan_mix


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated re-sharing, in code point order with null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets_and_copies(make):
    rows = [(k, "w " * (1 + k % 40), None, [f"s{k % 7}", "S", None, "é"][k % 4]) for k in range(3000)]
    found = plan_mix(make(rows)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    want = water_fill(sizes)
    for r in found:
        assert r["size"] == 1 + r.doc_id % 40
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.15)


def test_reruns_agree_and_rows_keep_their_columns(make):
    docs = make([(k, "a b c", "en", "xyz"[k % 3]) for k in range(200)])
    first, again = (sorted(r.doc_id for r in mix(docs).collect()) for _ in range(2))
    assert first == again
    assert mix(docs).columns == docs.columns


def test_odd_rows(make, odd_rows):
    found = plan_mix(make(odd_rows)).select("row.doc_id", "row.source", "size", "copies").collect()
    assert len(found) == len(odd_rows)
    assert {r["size"] for r in found if r.doc_id in (1, 2, 3)} == {0}
    assert len({r.copies for r in found if r.doc_id == 5 and r.source is None}) == 1


def test_empty_and_wordless_tables(make):
    assert plan_mix(make([])).count() == 0 and mix(make([])).count() == 0
    found = plan_mix(make([(1, None, None, "a"), (2, "", None, None)])).select("target", "copies").collect()
    assert [tuple(r) for r in found] == [(0.0, 0), (0.0, 0)]


def test_bad_shares_are_refused(make):
    with pytest.raises(ValueError):
        plan_mix(make([]), share=3.0, most=2.0)
