"""Near-duplicate documents: bottom-k sketches, inverted lists of retained values, union-sketch filter, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.llm.common import drop_stored, free_exchanges, small_side, stored
from leafscore.llm.graph import components
from leafscore.llm.words import Texts, map_slices, mix64, ngrams, texts_of, words_of

#: Values that the sketch of every document retains. A pair at the threshold 0.8 shares 38 of 48 on average.
RETAINED = 48
#: Values retained of the documents that share enough of those: for inverted lists and blocks, and to estimate a pair.
LISTED, ESTIMATED = 512, 128
#: Chance that a pair of large sets at the threshold shares fewer retained values than is relied upon.
MISS = 1e-10
#: Members of an inverted list that are compared with as many others at once, and how many values their sets have.
BLOCK, BLOCK_VALUES = 256, 1_000_000
#: Rows with a digest that may be broadcast; of node numbers alone, a million may.
WIDE_ROWS = 250_000
#: Bits of a sketch's values that travel to the blocks.
SKETCH_BITS = (1 << 31) - 1


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter text is one shingle, an empty one none."""
    words = words_of(texts, lower=True)
    at, hashes = ngrams(words, size)
    n = len(texts)
    ends = np.cumsum(np.bincount(words.doc[at], minlength=n)) if len(at) else np.zeros(n, np.int64)
    word_ends = np.cumsum(np.bincount(words.doc, minlength=n)) if len(words.doc) else np.zeros(n, np.int64)
    hashes = hashes.view(np.int64)
    out = []
    for d in range(n):
        a, b = (ends[d - 1] if d else 0), ends[d]
        if b > a:
            out.append(np.unique(hashes[a:b]))
            continue
        own = words.hash[(word_ends[d - 1] if d else 0): word_ends[d]]
        folded = np.zeros(1, np.uint64)
        for h in own:
            folded = mix64(folded + h)
        out.append(folded.view(np.int64)[: len(own[:1])])
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``digest`` of the whole shingle set, and ``sketch``: its smallest hashes, ascending."""
    retained = RETAINED

    def work():
        def one(part: pa.RecordBatch) -> list:
            sets = shingle_sets(texts_of(part.column("text")), size)
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([s[:retained] for s in sets], pa.list_(pa.int64()))]
        return one

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_slices(keyed, ["doc_id", "text_hash"], "n_shingles long, digest binary, sketch array<long>", work)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node`` and the whole shingle ``set``, ascending, of the texts whose set has the ``digest`` that comes with them."""
    def work():
        def one(part: pa.RecordBatch) -> list:
            sets = shingle_sets(texts_of(part.column("text")), size)
            return [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
        return one

    keyed = docs.select("node", F.col("digest").alias("wanted"), "text")
    return map_slices(keyed, ["node", "wanted"], "digest binary, set array<long>", work, 1 << 19).where("digest = wanted").select("node", "set")


@cache
def sure_overlap(threshold: float, retained: int, miss: float = MISS) -> int:
    """Most values that two large sets at the threshold share among the union's smallest, but for a chance ``miss``.

    Each of those values lies in the intersection with a probability of at least the threshold.
    """
    below = 0.0
    for s in range(retained + 1):
        below += math.comb(retained, s) * threshold**s * (1 - threshold) ** (retained - s)
        if below > miss:
            return s
    return retained


def needed_overlap(n: Column, threshold: float, retained: int) -> Column:
    """Retained values that a set of ``n`` shingles surely shares with any set similar to it.

    A set within the sketch size is retained whole: all similar sets share ``threshold * n`` values with it, or, if
    the other one is cut, what is left of the union's smallest values without those outside the intersection.
    """
    whole = F.ceil(F.round(n * threshold, 6))
    cut = math.floor(retained - retained * (1 - threshold) / threshold)
    return F.when(n <= retained * threshold, whole).when(n <= retained, F.least(whole, F.lit(cut))).otherwise(
        F.lit(sure_overlap(threshold, retained)))


def shared_values(postings: DataFrame) -> DataFrame:
    """``postings`` (with a ``value``) whose value others hold too, with the number ``df`` of those that do."""
    often = stored(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "value-counts")
    free_exchanges(postings)
    return postings.join(often, "value")


def class_sketches(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` and ``sketch`` of the row that stands for each class: all but the other copies, which are few as a rule.

    So the sketches stay where they are, unless there are very many copies.
    """
    held = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = classes.where("members > 1").select("digest", F.col("node").alias("first"))
    others = held.join(small_side(several, WIDE_ROWS), "digest").where("node <> first").select("node")
    return held.select("node", "sketch").join(small_side(stored(others, "other-copies"), 1_000_000), "node", "left_anti")


def candidates(firsts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The ``classes`` that share enough retained values with others for a similar one to be among them."""
    counted = shared_values(firsts.select(F.explode("sketch").alias("value"), "node")).groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    return classes.join(counted, "node").where(F.col("shared") >= needed_overlap(F.col("n_shingles"), threshold, RETAINED)).drop("shared")


def inverted_lists(sets: DataFrame, threshold: float) -> DataFrame:
    """``(value, node, shared)``: the retained values under which each document is listed, if another shares them.

    Two sketches that share s of their m values still meet if each is listed only under its m - s + 1 rarest, counted
    over all candidates. So values in very many documents, such as those of a common passage, list only documents
    that consist of little else, and no list is cut. ``shared`` is the share of a document's values that others hold.
    """
    postings = sets.select(F.explode(F.slice("set", 1, LISTED)).alias("value"), "node")
    sizes = sets.select("node", F.size("set").alias("n"), F.least(F.size("set"), F.lit(LISTED)).alias("m"))  # joined where the windows need the rows
    own = Window.partitionBy("node")  # a document's own values, at most the sketch size
    ranked = shared_values(postings).join(sizes, "node").withColumn("shared", F.count(F.lit(1)).over(own)).withColumn(
        "place", F.row_number().over(own.orderBy("df", "value")) + F.col("m") - F.col("shared"))
    listed = ranked.where(F.col("place") <= F.col("m") - needed_overlap(F.col("n"), threshold, LISTED) + 1)
    return listed.select("value", "node", (F.col("shared") / F.col("m")).alias("shared"))


def unresolved(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with their number of members and each member's component.

    Of lists with the same members, told by their number and two 64-bit hashes, one is enough; copies of a text share
    most of their values, so this leaves few.
    """
    named = stored(lists.join(labels, "node"), "named-lists")
    spread = named.groupBy("value").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other_mark"))
    still = spread.where("low <> high").groupBy("members", "mark", "other_mark").agg(F.min("value").alias("value"))
    return named.join(stored(still.select("value", "members"), "spread-lists"), "value")


def led_pairs(lists: DataFrame, labels: DataFrame, leads: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A leader for each list, outside the component of its last one, paired with all members of other components.

    The leader is the member with the largest share of retained values that others hold: in a group of copies of one
    text, the text itself. Returns the pairs and the leaders ``(value, lead)``.
    """
    able = lists
    if leads is not None:
        last = stored(leads.join(labels, F.col("lead") == F.col("node")).select("value", F.col("component").alias("led")), "last-leads")
        able = lists.join(last, "value").where("component <> led")
    best = F.max(F.struct("shared", (-F.col("node")).alias("order"), "node", "component")).alias("best")
    chosen = stored(able.groupBy("value").agg(best).select(
        "value", F.col("best.node").alias("lead"), F.col("best.component").alias("lead_component")), "leads")
    pairs = lists.join(chosen, "value").where("component <> lead_component").select(
        F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    return pairs, chosen.select("value", "lead")


def spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between numbered members reduced to a spanning forest: as connected, but fewer than the members."""
    members, number = np.unique(np.concatenate([i, j]), return_inverse=True)
    near = np.zeros((len(members), len(members)), bool)
    near[number[: len(i)], number[len(i):]] = near[number[len(i):], number[: len(i)]] = True
    fresh = np.ones(len(members), bool)
    a, b = [], []
    for start in range(len(members)):
        todo = [start] if fresh[start] else []
        fresh[start] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & fresh)
            fresh[new] = False
            a += [at] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return members[np.array(a, int)], members[np.array(b, int)]


def incidence(lists: pa.Array) -> np.ndarray:
    """How often each list has each of the values, as a matrix."""
    lengths = np.diff(lists.offsets.to_numpy())
    distinct, values = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    x = np.zeros((len(lists), len(distinct)), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(lists)), lengths), values), 1)
    return x


def to_compare(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the group's two blocks, and which pairs of them are to be compared here.

    Their components differ, their sizes allow the threshold, and they share no ``earlier`` value: such a pair is left
    to that value's list, so it is compared once, however many lists hold it.
    """
    component, block, n = (group.column(c).to_numpy() for c in ("component", "block", "n"))
    left, right = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("low", "high"))
    a, b = n[left][:, None], n[right][None, :]
    pairs = (component[left][:, None] != component[right][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    if pairs.any():
        met = incidence(group.column("earlier").combine_chunks())
        pairs &= met[left] @ met[right].T == 0
    return left, right, pairs


def paired(group: pa.Table, left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> pa.Table:
    """The group's members that are in a pair."""
    return group.take(pa.array(np.union1d(left[pairs.any(1)], right[pairs.any(0)])))


def open_members(group: pa.Table, percent: int) -> pa.Table:
    """The group's members that are to be compared with another one here; told before any sketch travels."""
    return paired(group, *to_compare(group, percent))


def near_members(group: pa.Table, percent: int, retained: int) -> pa.Table:
    """The group's members whose sketch shares with another's as much as the threshold needs.

    Sketches come as the low bits of their values. Values that these make equal count for one another, so what two
    sketches share may be put too high, and never too low.
    """
    left, right, pairs = to_compare(group, percent)
    if not pairs.any():
        return group.slice(0, 0)
    threshold = percent / 100
    x, n = incidence(group.column("sketch").combine_chunks()), group.column("n").to_numpy()
    a, b = n[left][:, None], n[right][None, :]
    exact = np.ceil(np.round((a + b) * threshold / (1 + threshold), 6))
    sure = np.minimum(sure_overlap(threshold, retained), np.ceil(np.round(np.minimum(a, b) * threshold, 6)))
    pairs &= x[left] @ x[right].T >= np.where(np.maximum(a, b) <= retained, exact, sure)
    return paired(group, left, right, pairs)


def common_sizes(sets: pa.Array, left: np.ndarray, right: np.ndarray, columns: int = 1 << 13) -> np.ndarray:
    """How many values the sets on the left share with those on the right, a bounded number of values at a time."""
    owner = np.repeat(np.arange(len(sets)), np.diff(sets.offsets.to_numpy()))
    values = sets.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    number = np.cumsum(np.append(0, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    often = np.bincount(number, minlength=1)[number] > 1  # a value that one set has is in no intersection
    owner, number = owner[often], np.unique(number[often], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        part = slice(*np.searchsorted(number, [at, at + columns]))
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[part], number[part] - at] = 1
        common += (x[left] @ x[right].T).astype(np.int64)
    return common


def exact_links(group: pa.Table, percent: int) -> pa.RecordBatch:
    """Pairs of the group with the exact similarity on whole sets, reduced to a spanning forest."""
    left, right, pairs = to_compare(group, percent)
    if pairs.any():
        n = group.column("n").to_numpy()
        common = common_sizes(group.column("set").combine_chunks(), left, right)
        pairs &= 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    i, j = np.nonzero(pairs)
    a, b = (group.column("node").to_numpy()[k] for k in spanning(left[i], right[j]))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def by_group(rows: DataFrame, keys: list[str], work: Callable, schema) -> DataFrame:
    """``work`` on each group of rows with equal keys, as Arrow tables; one group is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            code = np.stack([table.column(c).to_numpy() for c in keys])
            ends = np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1
            for at, to in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ():
                yield work(table.slice(at, to - at))
            rest = table.slice(ends[-1] if len(ends) else 0)
        if rest is not None and rest.num_rows:
            yield work(rest)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(flat, schema)


def block_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different components within the lists: a block of members against a block, in arrays.

    A list's members are dealt to blocks by hash, few enough for their whole sets, and each pair of blocks is a group,
    so no group grows with the list. Two members are compared under the smallest value that lists both. Only members
    that are in such a pair come with their sketches, once per group. Sketches say which of them have a likely partner;
    only those come with their whole sets and are compared exactly. A group gives a spanning forest of its links, so no pair of similar texts ever is a row.
    """
    keys, retained = ["value", "low", "high"], LISTED
    sizes = sets.select("node", F.size("set").alias("n"))
    met = lists.groupBy("node").agg(F.collect_set("value").alias("own")).join(sizes, "node")  # at most the sketch size
    sized = lists.join(sizes, "node").groupBy("value").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_VALUES)).cast("int").alias("blocks"))
    dealt = lists.join(stored(sized, "list-blocks"), "value").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    ready = dealt.join(met, "node").withColumn("earlier", F.filter("own", lambda v: v < F.col("value"))).drop("own")
    still = stored(by_group(ready, keys, lambda group: open_members(group, percent), ready.schema), "open-members")
    low = F.transform(F.slice("set", 1, retained), lambda v: v.bitwiseAND(SKETCH_BITS).cast("int"))
    sketched = still.join(of_nodes(still, sets).select("node", low.alias("sketch")), "node")
    likely = stored(by_group(sketched, keys, lambda group: near_members(group, percent, retained), sketched.schema), "likely-members").drop("sketch")
    free_exchanges(lists)
    whole = likely.join(of_nodes(likely, sets), "node")
    return by_group(whole, keys, lambda group: exact_links(group, percent), "a long, b long")


def of_nodes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the nodes that occur in the rows, so that only these are shuffled."""
    return sets.join(small_side(rows.select("node").distinct(), 1_000_000), "node", "left_semi")


def sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that occur in the pairs: after the first round few pairs are left."""
    return of_nodes(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), sets)


def estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and union sketch allow the threshold: enough of the union's smallest values lie in both.

    If both sets are within the sketch size, the estimate is the similarity itself.
    """
    threshold = percent / 100
    side = sets_of(pairs, sets).select("node", F.slice("set", 1, ESTIMATED).alias("sketch"), F.size("set").alias("n"))
    both = pairs.join(side.toDF("a", "sketch_a", "n_a"), "a").join(side.toDF("b", "sketch_b", "n_b"), "b").withColumn(
        "union", F.array_union("sketch_a", "sketch_b")).withColumn("common", F.array_intersect("sketch_a", "sketch_b"))
    matches = F.size(F.array_intersect("common", F.slice(F.array_sort("union"), 1, ESTIMATED)))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    least = F.least(F.lit(sure_overlap(threshold, ESTIMATED)), F.ceil(F.round(small * threshold, 6)))
    likely = F.when(large <= ESTIMATED, 100 * F.size("common") >= percent * F.size("union")).otherwise(matches >= least)
    return both.where((100 * small >= percent * large) & likely).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets have a Jaccard similarity of at least ``percent`` / 100, computed in integers."""
    whole = sets_of(pairs, sets)
    both = pairs.join(whole.toDF("a", "set_a"), "a").join(whole.toDF("b", "set_b"), "b").withColumn(
        "common", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


def near_links(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int, star_rounds: int) -> DataFrame:
    """Labels ``(node, component)`` of the classes that have candidates. ``rows`` are the sketches by node, deleted when read."""
    threshold = percent / 100
    listed = stored(candidates(class_sketches(rows, classes), classes, threshold), "candidates")
    drop_stored(rows)
    free_exchanges(docs)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wanted = small_side(listed.select("doc_id", "text_hash", "node", "digest"), WIDE_ROWS)
    sets = full_sets(keyed.join(wanted, ["doc_id", "text_hash"]), size)
    if listed.where("repeated").limit(1).count():  # rows that repeat doc_id and text alike
        sets = sets.dropDuplicates(["node"])
    sets = stored(sets, "sets")
    lists = stored(inverted_lists(sets, threshold), "lists")
    free_exchanges(docs)
    labels = listed.select("node", F.col("node").alias("component"))
    links = leads = None
    for round_number in range(star_rounds + 1):
        lists = stored(unresolved(lists, labels).select("value", "node", "shared", "component", "members"), "open-lists")
        if not lists.limit(1).count():
            break
        if round_number < star_rounds:
            pairs, leads = led_pairs(lists, labels, leads)
            likely = stored(estimated(stored(pairs.distinct(), "pairs"), sets, percent), "likely")
            found = stored(verified(likely, sets, percent), "links")
        else:
            found = stored(block_links(lists, sets, percent), "links")
        links = found if links is None else links.union(found)
        joined = components(links).select(F.col("node").alias("linked"), "component")
        labels = stored(listed.select("node").join(joined, F.col("node") == F.col("linked"), "left").select(
            "node", F.coalesce("component", "node").alias("component")), "labels")
        free_exchanges(docs)
        if round_number < star_rounds:  # a leader has met all others of its list, or is linked with them
            lists = lists.select("value", "node", "shared").join(leads.withColumnRenamed("lead", "node"), ["value", "node"], "left_anti")
    drop_stored(sets)
    return labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, star_rounds: int = 3) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked if the Jaccard similarity of their distinct lower-cased word ``size``-grams is at least
    ``percent`` / 100; a component is named after its smallest doc_id, which stays. Steps:

    1. Documents with equal sets form a class; one row stands for it from here on.
    2. Classes that share enough retained values with others are candidates, listed under the rarest values of a larger
       sketch. In each list, the member that shares most of its values leads; all others are paired with it only, so a
       list costs its length, not its square.
    3. Pairs pass the union-sketch estimate, then exact Jaccard on whole sets. The links give components.
    4. Lists that still hold several components choose a new leader outside the last one's component, for
       ``star_rounds`` rounds; then all their remaining pairs of different components are compared block by block
       (``block_links``). Pairs within a component are never formed: they change nothing.

    Sets are compared whole. A linked pair is missed with a chance of about 10^-10 if its sets exceed the sketch, and
    never if they are within it. Null and empty texts have no shingles and are linked with nothing. A null doc_id
    takes no part: component_id is null and the row is kept. Rows that repeat a doc_id are one document per text, all
    of which stay if their id names the component. An empty table gives an empty result.
    """
    return _groups(docs, size, percent, star_rounds).drop("text_hash")


def _groups(docs: DataFrame, size: int = 5, percent: int = 80, star_rounds: int = 3) -> DataFrame:
    """What ``near_groups`` returns, with the ``text_hash`` that tells rows of one doc_id apart."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs, size).withColumn("node", F.monotonically_increasing_id()), "sketches")
    copies = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "doc_id").agg(
        F.min("node").alias("node"), F.min_by("text_hash", "node").alias("text_hash"), F.min("n_shingles").alias("n_shingles"),
        F.count(F.lit(1)).alias("n"))
    classes = stored(copies.groupBy("digest").agg(
        F.min(F.struct("doc_id", "node", "text_hash", "n_shingles", (F.col("n") > 1).alias("repeated"))).alias("first"),
        F.sum("n").alias("members")).select("digest", "first.*", "members"), "classes")
    light = stored(rows.select("doc_id", "text_hash", "n_shingles", "digest"), "digests")
    labels = near_links(docs, rows, classes, size, percent, star_rounds)
    placed = stored(classes.join(labels, "node", "left").select(
        "digest", "doc_id", F.coalesce("component", "node").alias("component")), "placed")
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(placed.join(names, "component").select("digest", "component_id"), "named")
    whole = light.join(named, "digest", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the input's columns: of each component the smallest doc_id.

    Rows go by doc_id and text, so a doc_id that is repeated with another text loses only the one that is a copy.
    """
    gone = _groups(docs, **options).where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(small_side(stored(gone, "gone"), 1_000_000),
                     (F.col("doc_id") == F.col("gone")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")
