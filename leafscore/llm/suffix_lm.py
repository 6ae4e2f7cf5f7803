"""Language-model scores from a probabilistic suffix tree over words.

A context of one or more preceding words becomes a state if the distribution of what follows it diverges enough from
that of its longest kept suffix. A token is scored by the longest suffix of its history that is a state.

Which contexts and continuations are kept depends on absolute counts, so what the tree gathers grows with the corpus.
It is held as written tables. A score is a sum of one value per run of words in the text: the log ratio of a kept
continuation to its suffix's probability, and the back-off weight of a state. So the tables are looked up by one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import drop_stored, free_exchanges, stored
from leafscore.llm.words import Texts, Words, map_slices, mix64, slices, texts_of, words_of

#: Hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of the filters that tell which runs of words cannot be in a table; fuller filters only let more through.
FILTER_BITS = 27
#: Bits of a key that say in which round its rows meet the tree: rare words and runs are looked up a part of the keys at a time.
ROUND_BITS = 2


class Level(NamedTuple):
    """States of one context length: hashes in order and log10 of the back-off weights."""

    states: np.ndarray
    backoff: np.ndarray


@dataclass
class SuffixModel:
    """Totals, the discount of the root, and the written tree.

    ``table`` has one row per word of the corpus and per run of words with a value: ``key``, ``n`` (how often it is a
    word), ``seen``, ``delta`` (log10 of its probability over its suffix's, less the back-off weight), ``backoff`` and
    ``length`` in words. ``words`` to ``values`` are its frequent rows, the rest is met by a join.
    """

    tokens: int
    distinct: int
    discount: float
    depth: int
    table: DataFrame
    frequent: float

    @cached_property
    def hot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, word counts and values of rows that make up a share ``frequent`` of all tokens, and of the end."""
        rows = self.table.where(self.is_hot()).select("key", "n", (F.col("delta") + F.col("backoff")).alias("value")).toArrow()
        keys = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], rows.column("n").to_numpy()[order], rows.column("value").to_numpy()[order]

    def is_hot(self) -> Column:
        return (F.col("seen") >= self.frequent * self.tokens) | (F.col("key") == F.lit(int(END.view(np.int64))))

    @cached_property
    def _whole(self) -> dict[str, np.ndarray]:
        """The whole table as arrays; for small models, to look at."""
        rows = self.table.toArrow().to_pandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
        return {c: rows[c].to_numpy() for c in rows} | {"key": rows["key"].to_numpy().view(np.uint64)}

    @property
    def levels(self) -> tuple[Level, ...]:
        """The states by context length, up to the longest; for small models, to look at."""
        t = self._whole
        out = []
        for length in range(1, self.depth + 1):
            mine = (t["length"] == length) & (t["backoff"] != 0)
            out.append(Level(t["key"][mine], t["backoff"][mine]))
        while out and not len(out[-1].states):
            out.pop()
        return tuple(out)


def stream(texts: Texts) -> Words:
    """The lower-cased words of each text with an end token after them; only text numbers and hashes are filled."""
    words = words_of(texts, lower=True)
    n = len(texts)
    per = np.bincount(words.doc, minlength=n)
    at = np.arange(len(words.doc)) + words.doc
    hashes = np.empty(len(words.doc) + n, np.uint64)
    hashes[at] = words.hash
    hashes[np.cumsum(per) + np.arange(n)] = END
    return Words(at, at, np.repeat(np.arange(n), per + 1), hashes)


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def pair_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a run of words from those of the runs without its last and without its first word."""
    return mix64(first * np.uint64(0xFF51AFD7ED558CCD) + mix64(last + np.uint64(0x632BE59BD9B4E019)))


def runs(tokens: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` tokens: hashes of the runs at every position, and whether the run is within one text."""
    hashes = tokens.hash
    for length in range(1, longest + 1):
        if length > 1:
            hashes = pair_hash(hashes[:-1], hashes[1:])
        yield hashes, tokens.doc[: len(hashes)] == tokens.doc[length - 1:]
        if len(hashes) < 2:
            break


def contexts(tokens: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``length`` tokens before a token, and the token's number, wherever the text has that many before it."""
    found = list(runs(tokens, length))
    if len(found) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, _ = found[-1]
    at = np.flatnonzero(tokens.doc[: max(len(tokens.hash) - length, 0)] == tokens.doc[length:])
    return hashes[at], at + length


class Tally:
    """Counts by a pair of 64-bit keys with a bounded number of pairs in memory; gives them by part of the pairs' hashes."""

    def __init__(self, bits: int, limit: int = 1_000_000) -> None:
        self.bits, self.limit, self.parts, self.held, self.seen = bits, limit, [], 0, 0

    def add(self, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(summed(pair_hash(first, last), first, last, np.ones(len(first), np.int64)))
        self.held += len(self.parts[-1][0])
        self.seen += len(first)
        if self.held > 2 * self.limit or self.seen > 1 << 31:
            self._merge()
            if self.held > self.limit or self.seen > 1 << 31:
                yield from self.flush()

    def _merge(self) -> None:
        self.parts = [summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            key, first, last, n = self.parts[0]
            n = n.astype(np.uint32)
            cuts = np.searchsorted(key, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
            ends = np.append(cuts, len(key))
            starts = np.concatenate([[0], cuts])
            some = np.flatnonzero(ends > starts)
            packed = [first[i:j].tobytes() + last[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(starts[some], ends[some], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "pairs"])
        self.parts, self.held, self.seen = [], 0, 0


def summed(key: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs in order of their hash ``key``, each once, with the sum of ``n``."""
    if not len(key):
        return key, first, last, n
    order = np.argsort(key, kind="stable")  # mostly runs that are in order
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], first[order[starts]], last[order[starts]], np.add.reduceat(n[order], starts)


def tallied(docs: DataFrame, pairs: Callable[[Words], tuple[np.ndarray, np.ndarray]], least: int = 1) -> DataFrame:
    """``(context, suffix, n, key)`` over the token streams of all whole texts, of pairs seen ``least`` times or more.

    Combined per task, packed by part of the pairs' hashes ``key``, and combined again where the parts of all tasks meet;
    so the exchange moves arrays, and a row is made for pairs that stay.
    """
    bits = max(12, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(bits)
        for batch in batches:
            for part in slices(batch):
                yield from tally.add(*pairs(stream(texts_of(part.column("text")))))
        yield from tally.flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                held.setdefault(part, []).append(packed)
        for part in sorted(held):
            blobs = held.pop(part)
            sizes = [len(b) // 20 for b in blobs]
            first, last = (np.concatenate([np.frombuffer(b, np.uint64, c, 8 * k * c) for b, c in zip(blobs, sizes, strict=True)]) for k in range(2))
            n = np.concatenate([np.frombuffer(b, np.uint32, c, 16 * c) for b, c in zip(blobs, sizes, strict=True)]).astype(np.int64)
            key, first, last, n = summed(pair_hash(first, last), first, last, n)
            stays = n >= least
            key, first, last = (v[stays].view(np.int64) for v in (key, first, last))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (first, last, n[stays], key)], names=["context", "suffix", "n", "key"])

    found = docs.select("text").mapInArrow(run, "part int, pairs binary")
    return found.repartition("part").mapInArrow(met, "context long, suffix long, n long, key long")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(key, n)``: how often each word, and the end of a text, occurs in the documents."""
    found = tallied(docs, lambda tokens: (np.zeros(len(tokens.hash), np.uint64), tokens.hash))
    return stored(found.select(F.col("suffix").alias("key"), "n"), "word-counts")


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of the ``key`` values modulo 2**FILTER_BITS: a fixed size, whatever the number of keys."""
    bit = F.pmod("key", F.lit(1 << FILTER_BITS)) + 1
    rows = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(
        F.bitmap_construct_agg("at").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[(bucket - 1) * 4096: bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are certainly not among those of the filter."""
    bit = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def run_counts(docs: DataFrame, length: int, shorter: DataFrame, least: int) -> DataFrame:
    """``context``, ``suffix``, ``n`` and ``key`` of all runs of ``length`` words seen ``least`` times or more.

    ``shorter`` holds the ``key`` of the runs one word shorter that were seen as often. A filter over them spares the
    exchange most runs that cannot pass; those that it lets through in error are counted and then left out like others.
    """
    bitmap = key_filter(shorter)

    def pairs(tokens: Words) -> tuple[np.ndarray, np.ndarray]:
        found = list(runs(tokens, length - 1))
        if len(found) < length - 1 or len(found[-1][0]) < 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        hashes = found[-1][0]
        known = passes(bitmap, hashes)
        inside = (tokens.doc[: len(hashes) - 1] == tokens.doc[length - 1:]) & known[:-1] & known[1:]
        return hashes[:-1][inside], hashes[1:][inside]

    out = stored(tallied(docs, pairs, least), f"runs-{length}")
    free_exchanges(docs)
    return out


def looked_up(rows: DataFrame, on: str, table: DataFrame, columns: dict[str, str], hot: float, outer: bool = False) -> DataFrame:
    """``rows`` with ``columns`` (old name: new name) of the table's row whose ``key`` is ``on``.

    The table's rows with ``n`` of at least ``hot``, a bounded number, are broadcast, so that the many rows of a frequent
    context do not meet in one task; the others are joined by an exchange.
    """
    side = table.select(F.col("key").alias("_key"), (F.col("n") >= hot).alias("_hot"), *[F.col(a).alias(b) for a, b in columns.items()])
    first = rows.join(F.broadcast(side.where("_hot")), F.col(on) == F.col("_key"), "left")
    found = first.where("_key IS NOT NULL").select(*rows.columns, *columns.values())
    rest = first.where("_key IS NULL").select(*rows.columns).join(side.where("NOT _hot"), F.col(on) == F.col("_key"), "left" if outer else "inner")
    return found.unionByName(rest.select(*rows.columns, *columns.values()))


def fit_suffix_tree(
    docs: DataFrame, counts: DataFrame, depth: int = 3, frequent: float = 1e-6, context_share: float = 0.0,
    least_context: int = 4, least_entry: int = 2, gain: float = 0.02,
) -> SuffixModel:
    """Grow the tree over all ``docs``, whose ``word_counts`` are given; one pass over the texts per level.

    A context of up to ``depth`` words is tested if it was seen ``least_context`` times (or makes up ``context_share``
    of all tokens, if that is asked for and more); its entries are the words that followed it ``least_entry`` times.
    It passes if its own distribution raises the likelihood of its training occurrences over that of its longest kept
    suffix by ``gain`` nats per occurrence and by more than the description length of its entries. Counts are discounted
    by a half; the rest of the mass goes to the suffix. All of it is tables; ``frequent`` is the share of all tokens from
    which rows travel to the driver and, as arrays, to the tasks, so at most 1 / ``frequent`` per length.
    """
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct"),
        F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    discount = min(0.95, max(0.05, (total.once + 1) / (total.once + 2 * total.twice + 2)))
    least, hot = max(least_context, context_share * total.tokens), max(1e-5 * total.tokens, 1)
    shorter = counts.select("key", "n", ((F.col("n") - discount) / max(total.tokens, 1)).alias("p"))
    parts = [counts.select("key", "n", F.col("n").alias("seen"), F.lit(0.0).alias("delta"), F.lit(0.0).alias("backoff"), F.lit(1).alias("length"))]
    none, spent = F.lit(0).cast("bigint"), []
    for length in range(1, depth + 1):
        grams = run_counts(docs, length + 1, shorter.where(F.col("n") >= least_entry), least_entry)
        tested = stored(looked_up(grams, "suffix", shorter, {"p": "lower"}, hot), f"tested-{length}")
        drop_stored(grams)
        free_exchanges(docs)
        # own = (n - 1/2) / total; the total is met once per context, after its entries have been summed.
        sums = tested.groupBy("context").agg(
            F.sum("lower").alias("under"), F.sum("n").alias("seen"), F.count(F.lit(1)).alias("entries"),
            F.sum(F.col("n") * F.log((F.col("n") - 0.5) / F.col("lower"))).alias("gained"))
        sums = sums.join(shorter.where(F.col("n") >= least).select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
        own = (F.col("seen") - 0.5 * F.col("entries")) / F.col("total")
        weight = F.greatest(1 - own, F.lit(1e-9)) / F.greatest(1 - F.col("under"), F.lit(1e-9))
        better = F.col("gained") - F.col("seen") * F.log(F.col("total").cast("double")) + (F.col("total") - F.col("seen")) * F.log(weight)
        passed = (better > gain * F.col("total")) & (better > 0.5 * (F.col("entries") + 1) * F.log(F.col("total").cast("double")))
        states = stored(sums.where(passed).select(F.col("context").alias("key"), F.col("total").alias("n"), F.log10(weight).alias("backoff")), f"states-{length}")
        free_exchanges(docs)
        placed = looked_up(tested, "context", states, {"n": "total", "backoff": "backoff"}, hot, outer=True).withColumn(
            "own", (F.col("n") - 0.5) / F.col("total"))
        p = F.when(F.col("backoff").isNotNull(), F.col("own")).otherwise(F.col("lower"))
        delta = F.coalesce(F.log10(F.col("own") / F.col("lower")) - F.col("backoff"), F.lit(0.0))
        shorter = stored(placed.select("key", "n", p.alias("p"), delta.alias("delta")), f"level-{length}")
        parts.append(states.select("key", none.alias("n"), F.col("n").alias("seen"), F.lit(0.0).alias("delta"), "backoff", F.lit(length).alias("length")))
        parts.append(shorter.where("delta != 0").select(
            "key", none.alias("n"), F.col("n").alias("seen"), "delta", F.lit(0.0).alias("backoff"), F.lit(length + 1).alias("length")))
        drop_stored(tested)
        spent += [states, shorter]
        del grams, tested, sums, placed
        free_exchanges(docs)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    table = rows.groupBy("key").agg(
        F.max("n").alias("n"), F.max("seen").alias("seen"), F.sum("delta").alias("delta"), F.sum("backoff").alias("backoff"), F.max("length").alias("length"))
    table = stored(table, "suffix-tree")
    drop_stored(*spent)
    del rows, parts, part, shorter
    free_exchanges(docs)
    return SuffixModel(total.tokens, total.distinct, discount, depth, table, frequent)


def token_scores(tokens: Words, model: SuffixModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 of what the tree adds to the root, whether the root must follow, and the row of its word or -1.

    Reads the whole table on the driver; for small models, to look at.
    """
    table = model._whole
    word = place(table["key"], tokens.hash)
    out = np.zeros(len(word))
    for length, (hashes, inside) in enumerate(runs(tokens, model.depth + 1), 1):
        at = np.flatnonzero(inside)
        row = place(table["key"], hashes[at])
        at, row = at[row >= 0], row[row >= 0]
        out[at + length - 1] += table["delta"][row]
        follows = at + length < len(word)
        follows[follows] = tokens.doc[at[follows]] == tokens.doc[at[follows] + length]
        out[at[follows] + length] += table["backoff"][row[follows]]
    return out, np.ones(len(word), bool), word


def root_logp(n: Column, model: SuffixModel) -> Column:
    """log10 probability of a word seen ``n`` times: discounted share; unseen words share what the discount frees."""
    total = float(max(model.tokens, 1))
    unseen = model.discount * model.distinct / total if model.tokens else 1.0
    return F.log10(F.when(n > 0, (n - model.discount) / total).otherwise(unseen))


def base_logp(n: Column, model: SuffixModel) -> Column:
    """log10 of the add-one unigram estimate."""
    return F.log10((n + 1) / F.lit(float(model.tokens + model.distinct + 1)))


def score_texts(docs: DataFrame, counts: DataFrame, model: SuffixModel, keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep`` plus n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``score`` is the log10 probability of the words and the end of the text under the tree, ``base_score`` that of an
    add-one unigram model; words outside the training corpus are one symbol in both. Frequent words and runs
    of words come as arrays; the rest, as far as a filter does not rule it out, is joined with the written tree and
    summed back by document, a part of the keys after the other, so that only a part's exchange is on disk. Words are compared by 64-bit hashes. Null and empty texts are just the end; rows are scored one by one,
    also if they repeat.
    """
    hot_keys, hot_counts, hot_values = model.hot
    bitmap = key_filter(model.table.where("n = 0").where(~model.is_hot()))
    depth, tokens_, distinct, discount, bits = model.depth, model.tokens, model.distinct, model.discount, ROUND_BITS

    def work():
        total = max(tokens_, 1)
        base = np.log10((hot_counts + 1) / (tokens_ + distinct + 1))
        root = np.log10(np.maximum(hot_counts - discount, 1e-12) / total)

        def one(part: pa.RecordBatch) -> list:
            texts = texts_of(part.column("text"))
            n = len(texts)
            tokens = stream(texts)
            doc = tokens.doc
            word = place(hot_keys, tokens.hash)
            known = word >= 0
            score = np.zeros(len(doc))
            score[known] = root[word[known]] + hot_values[word[known]]
            rare_doc, rare_key, is_word = [doc[~known]], [tokens.hash[~known]], [np.ones(int((~known).sum()), bool)]
            for length, (hashes, inside) in enumerate(runs(tokens, depth + 1), 1):
                if length > 1:
                    row = place(hot_keys, hashes)
                    score[: len(row)] += np.where(inside & (row >= 0), hot_values[row] if len(hot_values) else 0, 0)
                    cold = np.flatnonzero(inside & (row < 0))
                    cold = cold[passes(bitmap, hashes[cold])]
                    rare_doc.append(doc[cold])
                    rare_key.append(hashes[cold])
                    is_word.append(np.zeros(len(cold), bool))
            d, h, w = (np.concatenate(c) for c in (rare_doc, rare_key, is_word))
            order = np.lexsort((h, d))
            d, h, w = d[order], h[order], w[order]
            new = np.ones(len(order), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            group = np.cumsum(new) - 1
            sizes = np.bincount(group, minlength=int(new.sum())).astype(np.int32)
            d, h, w = d[new], h[new], w[new]
            turn = h >> np.uint64(64 - bits)
            rare = []
            for k in range(1 << bits):
                mine = turn == np.uint64(k)
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(d[mine], minlength=n), out=offsets[1:])
                entry = pa.StructArray.from_arrays(
                    [pa.array(h[mine].view(np.int64)), pa.array(sizes[mine]), pa.array(w[mine])], names=["key", "times", "word"])
                rare.append(pa.ListArray.from_arrays(pa.array(offsets), entry))
            return [
                np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc[known], minlength=n).astype(np.int64),
                np.bincount(doc[known], base[word[known]], n), np.bincount(doc, score, n), *rare]
        return one

    rounds = [f"rare_{k}" for k in range(1 << bits)]
    added = ", ".join(["n_tokens long, n_frequent long, frequent_base double, partial_score double",
                       *[f"{c} array<struct<key: long, times: int, word: boolean>>" for c in rounds]])
    kept = docs.select(F.struct(*keep).alias("kept"), "text")
    scored = stored(map_slices(kept, ["kept"], added, work).withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    free_exchanges(docs)
    values = model.table.where(~model.is_hot()).select("key", "n", (F.col("delta") + F.col("backoff")).alias("value"))
    n, times = F.coalesce(F.col("n"), F.lit(0)), F.col("times")
    found = []
    for k, column in enumerate(rounds):
        mine = values.where(F.shiftrightunsigned("key", 64 - bits) == k)
        rare = scored.select("row", F.explode(column).alias("r")).select("row", "r.*").join(mine, "key", "left")
        found.append(stored(rare.groupBy("row").agg(
            F.sum(F.when(F.col("word") & (n > 0), times).otherwise(0)).alias("rare_known"),
            F.sum(F.when(F.col("word"), times * base_logp(n, model)).otherwise(0.0)).alias("rare_base"),
            F.sum(times * (F.when(F.col("word"), root_logp(n, model)).otherwise(0.0) + F.coalesce("value", F.lit(0.0)))).alias("rare_score")),
            f"rare-sums-{k}"))
        del rare
        free_exchanges(docs)
    parts = found[0]
    for part in found[1:]:
        parts = parts.unionByName(part)
    sums = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rare_known", "rare_base", "rare_score")])
    joined = scored.drop(*rounds).join(sums, "row", "left")
    return joined.select(
        *[F.col("kept")[k].alias(k) for k in keep], "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("frequent_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("partial_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
