from hypothesis import given, settings
from hypothesis import strategies as st

from leafscore.llm.queries import QUERIES
from leafscore.llm.token_counts import CountTree, EditedText, count_trees, leaves_of, recount
from leafscore.llm.tokens import VOCABULARY, _tokenizer, encode

piece = st.sampled_from([" ", "  ", "\n", "a", "the", "'s", "'ll", "1", "23", "é", "!", "?? ", "\t", "　", "x y", "'", "\x1c", "字"])
text_of = st.lists(piece, max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(text_of, st.sampled_from([1, 4, 20]), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 30), text_of), max_size=4))
def test_edits_keep_the_count_exact(text, leaf, edits):
    leaves = leaves_of(text, leaf)
    assert "".join(leaves) == text
    tree = CountTree.build(leaves, VOCABULARY)
    assert tree.tokens[1] == len(encode(text))
    edited = EditedText(text, tree)
    for start, length, new in edits:
        start = min(start, len(text))
        end = min(start + length, len(text))
        text = text[:start] + new + text[end:]
        edited.edit(start, end, new)
        assert "".join(edited.leaves) == text
        assert (edited.tree.chars[1], edited.tree.tokens[1]) == (len(text), len(encode(text)))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_give_the_same_ids(text):
    assert encode(text).tolist() == _tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_a_small_edit_encodes_little():
    text = "some words in a row, " * 5000
    edited = EditedText(text, CountTree.build(leaves_of(text), VOCABULARY))
    edited.edit(50_000, 50_004, "changed")
    assert edited.encoded < 2000


def test_recount_matches_whole_encoding(make, spark, odd_rows):
    docs = make(odd_rows)
    trees = count_trees(docs)
    assert all(r.n_tokens == len(encode(t or "")) for r, t in zip(trees.collect(), [t for _, t, *_ in odd_rows], strict=True))
    edits = spark.createDataFrame(
        [(5, 0, 3, "ONE"), (5, 2, 6, "overlaps"), (5, 1000, 2000, " end"), (1, 0, 5, "new"), (8, 10, 200_000, None), (None, 0, 1, "x"),
         (99, 0, 1, "x")], "doc_id long, start long, end long, replacement string")
    found = {(r.doc_id, r.n_edits, r.n_tokens) for r in recount(docs, trees, edits).collect()}
    texts = {"one two three four five six seven": "ONE two three four five six seven end",
             "another text under a number already used": "ONEther text under a number already used end"}
    want = {(5, 2, len(encode(t))) for t in texts.values()} | {(1, 1, len(encode("new"))), (8, 1, len(encode(" " * 100_010 + "é")))}
    assert found == want


def test_empty_table(make, spark):
    edits = spark.createDataFrame([], "doc_id long, start long, end long, replacement string")
    trees = count_trees(make([]))
    assert trees.count() == 0 and recount(make([]), trees, edits).count() == 0


def test_counts_of_null_and_repeated_ids_follow_their_own_text(make, spark, tmp_path):
    texts = ["write to me@site.org please", "a longer text first, then write to some.one@other.org today", "no personal data in this"]
    rows = [(None, texts[0]), (None, texts[2]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[0])]
    make(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    redacted = [texts[0].replace("me@site.org", "[EMAIL]"), texts[1].replace("some.one@other.org", "[EMAIL]"), texts[2]]
    size = {t: (len(encode(t)), int(r != t), len(encode(r))) for t, r in zip(texts, redacted, strict=True)}
    found = QUERIES["op3_token_counts"](spark, str(tmp_path)).collect()
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(key, [(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in found])) == sorted(map(key, [(k, *size[t]) for k, t in rows]))
