import json
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from leafscore.llm.token_counts import CountTree, EditedText, leaves_of
from leafscore.llm.tokens import SPECIAL, VOCABULARY, encode, vocabulary_path

FILE = vocabulary_path(f"{VOCABULARY}.json")


def test_the_file_has_no_other_special_string():
    assert [t["content"] for t in json.loads(Path(FILE).read_text())["added_tokens"]] == [SPECIAL]


@pytest.mark.parametrize("text", [
    f"one {SPECIAL} two", SPECIAL, SPECIAL * 3, f"a  {SPECIAL}\n b", f"it{SPECIAL}'s", "<|endoftext|", f"x{SPECIAL} " * 200, " plain  text\n"])
def test_ids_are_those_of_the_unaltered_file(text):
    want = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert encode(text).tolist() == want
    for leaf in (1, 7):
        assert CountTree.build(leaves_of(text, leaf), VOCABULARY).tokens[1] == len(want)


def test_an_edit_can_make_and_break_the_special_string():
    text = "some words <|endof text|> and more words"
    edited = EditedText(text, CountTree.build(leaves_of(text, 4), VOCABULARY))
    at = text.index(" text|>")
    edited.edit(at, at + 1, "")
    whole = text[:at] + text[at + 1:]
    assert edited.tree.tokens[1] == len(encode(whole)) and SPECIAL in whole
    edited.edit(at, at, " ")
    assert edited.tree.tokens[1] == len(encode(text))
