"""Edit-aware token counts: a segment tree over pre-token runs per document; an edit re-encodes only what it touches."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import small_side, stored
from leafscore.llm.tokens import VOCABULARY, encode
from leafscore.llm.words import map_slices

#: Code points after which a leaf ends at the next place where it can.
LEAF = 256
#: A space or line feed between two visible characters begins a pre-token whatever else the text holds.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """The text in runs of whole pre-tokens of at least ``leaf`` code points; one run if it has no place to cut."""
    out, at = [], 0
    while True:
        m = _CUT.search(text, at + leaf)
        if m is None:
            return [*out, text[at:]]
        out.append(text[at: m.start()])
        at = m.start()


def holds(left: str, right: str) -> bool:
    """Whether a pre-token begins between two neighbouring runs, judged by the three characters that decide it."""
    return len(right) > 1 and right[0] in " \n" and not left[-1].isspace() and not right[1].isspace()


class CountTree:
    """Segment tree in heap order: code points and tokens of every node; leaf k is node ``width + k``."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def build(cls, leaves: list[str], vocabulary: str) -> CountTree:
        width = 1 << (len(leaves) - 1).bit_length()
        tree = cls([0] * (2 * width), [0] * (2 * width))
        for k, leaf in enumerate(leaves):
            tree.chars[width + k], tree.tokens[width + k] = len(leaf), len(encode(leaf, vocabulary))
        for k in range(width - 1, 0, -1):
            tree.chars[k] = tree.chars[2 * k] + tree.chars[2 * k + 1]
            tree.tokens[k] = tree.tokens[2 * k] + tree.tokens[2 * k + 1]
        return tree

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds the code point (the last filled one at the end of the text), and where it begins."""
        at, before = 1, 0
        position = min(position, max(self.chars[1] - 1, 0))
        while at < self.width:
            at *= 2
            if position - before >= self.chars[at]:
                before += self.chars[at]
                at += 1
        return at - self.width, before

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        """Replace a leaf's counts and the sums above it."""
        at = self.width + leaf
        more_chars, more_tokens = chars - self.chars[at], tokens - self.tokens[at]
        while at:
            self.chars[at] += more_chars
            self.tokens[at] += more_tokens
            at //= 2


class EditedText:
    """A document as leaf strings with their tree; edits change both."""

    def __init__(self, text: str, tree: CountTree, vocabulary: str = VOCABULARY) -> None:
        self.tree, self.vocabulary, self.encoded = tree, vocabulary, 0
        self.leaves, at = [], 0
        for k in range(tree.width):
            self.leaves.append(text[at: at + tree.chars[tree.width + k]])
            at += tree.chars[tree.width + k]

    def _filled(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace code points ``start`` to ``end``: the touched leaves become one, and are joined with a neighbour
        while the border to it is no longer sure to begin a pre-token. Only that one leaf is encoded again."""
        first, before = self.tree.find(start)
        last, last_before = self.tree.find(max(end - 1, start))
        new = self.leaves[first][: start - before] + replacement + self.leaves[last][end - last_before:]
        for k in range(first + 1, last + 1):
            self._put(k, "")
        left, right = self._filled(first, -1), self._filled(last, 1)
        while new and left is not None and not holds(self.leaves[left], new):
            new, taken = self.leaves[left] + new, left
            self._put(taken, "")
            left = self._filled(taken, -1)
        if not new and left is not None and right is not None and not holds(self.leaves[left], self.leaves[right]):
            new = self.leaves[left] + self.leaves[right]
            self._put(left, "")
            self._put(right, "")
            right = self._filled(right, 1)
        while new and right is not None and not holds(new, self.leaves[right]):
            new += self.leaves[right]
            self._put(right, "")
            right = self._filled(right, 1)
        self._put(first, new)

    def _put(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.encoded += len(text)
        self.tree.set(leaf, len(text), len(encode(text, self.vocabulary)) if text else 0)


def count_trees(docs: DataFrame, leaf: int = LEAF, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_tokens`` and the tree (``chars``, ``tokens``) of every whole text.

    Leaves are runs of pre-tokens, cut where a pre-token begins whatever stands around, so their counts add up to the
    text's. Null and empty texts have one empty leaf and no tokens. Repeated rows have equal trees.
    """
    def work():
        def one(part: pa.RecordBatch) -> list:
            trees = [CountTree.build(leaves_of(t or "", leaf), vocabulary) for t in part.column("text").to_pylist()]
            ints = pa.list_(pa.int32())
            return [pa.array([t.tokens[1] for t in trees], pa.int64()), pa.array([t.chars for t in trees], ints),
                    pa.array([t.tokens for t in trees], ints)]
        return one

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_slices(keyed, ["doc_id", "text_hash"], "n_tokens long, chars array<int>, tokens array<int>", work)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, nulls being equal, with the left side's keys."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def recount(docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts and trees of the edited documents: ``doc_id``, ``text_hash`` (of the text before), ``n_edits``,
    ``n_tokens``, ``n_encoded`` (code points encoded again), ``chars``, ``tokens``.

    ``edits`` has doc_id, start, end (code points of the text before) and replacement; a null replacement deletes.
    Edits are applied from the last to the first. Of overlapping ones the first by start, then end, counts; places
    outside the text are moved to its ends. Only documents with edits are read again, found by broadcast while their
    number allows it. Rows that repeat a doc_id are all edited, and edits of a null doc_id are left out, unless ``edits``
    has a ``text_hash``: then they belong to the rows with this doc_id, null or not, and this text.
    """
    keys = ["doc_id", "text_hash"] if "text_hash" in edits.columns else ["doc_id"]
    grouped = stored((edits if len(keys) > 1 else edits.where("doc_id IS NOT NULL")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("edits")), "edits")
    wanted = small_side(grouped, 200_000)
    own = null_safe(trees.drop("n_tokens"), wanted.select(*keys), keys, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ready = null_safe(null_safe(keyed, wanted, keys, "inner"), own, ["doc_id", "text_hash"], "inner")

    def work():
        def one(part: pa.RecordBatch) -> list:
            out = []
            rows = zip(*(part.column(c).to_pylist() for c in ("text", "edits", "chars", "tokens")), strict=True)
            for text, wished, chars, tokens in rows:
                edited = EditedText(text or "", CountTree(chars, tokens), vocabulary)
                size, free, todo = chars[1], 0, []
                for e in wished:
                    start = min(max(e["start"], 0), size)
                    end = min(max(e["end"], start), size)
                    if start >= free:
                        todo.append((start, end, e["replacement"]))
                        free = end
                for e in reversed(todo):
                    edited.edit(*e)
                out.append((len(todo), edited.tree.tokens[1], edited.encoded, edited.tree.chars, edited.tree.tokens))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return one

    added = "n_edits long, n_tokens long, n_encoded long, new_chars array<int>, new_tokens array<int>"
    found = map_slices(ready, ["doc_id", "text_hash", "edits", "chars", "tokens"], added, work)  # the last three are only read
    return found.select("doc_id", "text_hash", "n_edits", "n_tokens", "n_encoded",
                        F.col("new_chars").alias("chars"), F.col("new_tokens").alias("tokens"))
