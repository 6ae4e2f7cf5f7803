"""Rule-based field extraction over token tables ``(document_id, idx, text)``.

Neighbour tests are joins on (document_id, idx) of the few tokens that carry a keyword, and the best candidate is an
aggregate, so no step gathers a whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafscore.functions.scalars import join_address, plausible_date
from leafscore.functions.text import contains_any, digit_ratio, is_upper, strip
from leafscore.operators.layout import bound, written
from leafscore.operators.slices import SLICE, carried, numbered, same, sliced, within

# Keyword lists of the configured vocabulary ("full") and of the built-in one ("short").
VOCABULARY = {
    "full": {
        "company_legal": [
            "SDN BHD", "SDN. BHD.", "BHD", "BHD.", "LTD", "LIMITED", "INC", "CORP", "ENTERPRISE", "TRADING",
            "RESTAURANT", "SUPERMARKET", "MART", "CAFE", "PHARMACY", "STORE", "MARKET", "BAKERY", "STATION", "HOTEL",
            "RETAIL",
        ],
        "company_negative": [
            "INVOICE", "RECEIPT", "TAX", "TOTAL", "DATE", "TEL", "FAX", "CASHIER", "TABLE", "BILL", "ORDER", "GST NO",
            "REG NO",
        ],
        "date": ["DATE", "TARIKH", "TIME", "MASA", "DT"],
        "total": [
            "TOTAL", "GRAND TOTAL", "AMOUNT", "AMOUNT DUE", "BALANCE DUE", "NET TOTAL", "TOTAL AMOUNT", "TOTAL RM",
            "TOTAL MYR", "JUMLAH",
        ],
        "total_negative": [
            "SUBTOTAL", "SUB TOTAL", "SUB-TOTAL", "CHANGE", "CASH", "ROUNDING", "GST", "TAX", "DISCOUNT",
            "SERVICE CHARGE", "ITEMS", "QTY", "TOTAL ITEM", "TOTAL ITEMS", "BALANCE", "TENDER", "VISA", "MASTER",
            "DEBIT", "CREDIT",
        ],
        "location": [
            "NO.", "NO ", "LOT", "JALAN", "JLN", "LORONG", "STREET", "ROAD", "RD", "TAMAN", "BANDAR", "SEKSYEN",
            "SELANGOR", "KUALA LUMPUR", "PENANG", "JOHOR", "MALAYSIA", "PERAK", "PAHANG", "MELAKA", "KEDAH",
            "NEGERI SEMBILAN", "SARAWAK", "SABAH", "WILAYAH PERSEKUTUAN", "PUCHONG", "PETALING JAYA", "SUBANG JAYA",
            "KLANG", "SHAH ALAM",
        ],
        "address_negative": [
            "TEL", "FAX", "EMAIL", "WWW", "HTTP", "GST NO", "REG NO", "ROC", "TAX INVOICE", "CASHIER",
        ],
    },
    "short": {
        "company_legal": ["SDN BHD", "SDN. BHD.", "BHD", "LTD", "ENTERPRISE", "RESTAURANT"],
        "company_negative": ["INVOICE", "RECEIPT", "TAX", "TOTAL", "TEL", "FAX", "CASHIER", "GST NO"],
        "date": ["DATE", "TARIKH", "TIME"],
        "total": ["TOTAL", "GRAND TOTAL", "AMOUNT", "AMOUNT DUE", "BALANCE DUE", "NET TOTAL", "JUMLAH"],
        "total_negative": [
            "SUBTOTAL", "SUB TOTAL", "CHANGE", "CASH", "ROUNDING", "GST", "TAX", "DISCOUNT", "ITEMS", "QTY",
        ],
        "location": [
            "NO.", "LOT", "JALAN", "JLN", "LORONG", "STREET", "ROAD", "TAMAN", "BANDAR", "SELANGOR", "KUALA LUMPUR",
            "MALAYSIA", "PENANG",
        ],
        "address_negative": [
            "TEL", "FAX", "EMAIL", "WWW", "HTTP", "GST NO", "REG NO", "ROC", "TAX INVOICE", "CASHIER", "TOTAL",
        ],
    },
}
# Words that end the address block, and the month abbreviations.
ADDRESS_STOP = ["TOTAL", "SUBTOTAL", "AMOUNT DUE", "RECEIPT", "INVOICE NO"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Date and amount patterns.
NAMED_DATE = r"(\d{1,2})[\s\-\.](Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s\-\.](\d{2,4})"
YMD_DATE = r"(\d{4})[/\-\.](\d{1,2})[/\-\.](\d{1,2})"
DMY_DATE = r"(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})"
AMOUNT = r"(?i)(?:RM|MYR|\$)?\s*([0-9]{1,6}\.[0-9]{2})\b"
POSTCODE = r"\b\d{5}\b"

COLUMNS = ["document_id", "field_name", "value", "confidence", "token_indices", "rule"]


def tokens_or_lines(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens, and for documents without any the non-blank lines of ``pages.full_text`` as tokens."""
    bare = pages.join(tokens.select("document_id").distinct(), "document_id", "left_anti")
    lines = F.filter(F.transform(F.split("full_text", r"\R"), lambda s: strip(s)), lambda s: s != "")
    extra = bare.select("document_id", F.posexplode(lines).alias("idx", "text"))
    return tokens.select("document_id", "idx", "text").unionByName(extra)


def _next_flags(tokens: DataFrame, keep: Column, **flags: Column) -> DataFrame:
    """Flags of the kept tokens, keyed by the position of the token after them."""
    return tokens.where(keep).select(
        "document_id", (F.col("idx") + 1).alias("idx"), *[c.alias(name) for name, c in flags.items()]
    )


def _matches(pattern: str, rule: str, rank: int, base: float, build) -> Column:
    """All matches of one date pattern in ``t`` as candidate structs; implausible ones are null."""
    found = F.regexp_extract_all("t", F.lit(rf"(?i)(?<!\d){pattern}(?!\d)"), F.lit(0))

    def part(text: Column, k: int) -> Column:
        return F.regexp_extract(text, "(?i)" + pattern, k)

    return F.transform(
        found,
        lambda m, i: F.when(
            build(lambda k: part(m, k)),
            F.struct(F.lit(base).alias("base"), F.lit(rank).alias("rank"), i.alias("pos"), strip(m).alias("value"),
                     F.lit(rule).alias("rule")),
        ),
    )


def date_candidates(tokens: DataFrame, vocabulary: str = "full", low: int = 1990, high: int = 2035) -> DataFrame:
    """Every plausible date in every token with its confidence; a date keyword here or just before adds 0.25."""
    words = VOCABULARY[vocabulary]["date"]
    keyed = contains_any(F.upper("text"), words)
    number = lambda c: c.cast("int")
    month = lambda c: F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(c), 1, 3)
    ).cast("int")

    def named(g):
        return plausible_date(number(g(1)), month(g(2)), number(g(3)), low, high)

    def ymd(g):
        return plausible_date(number(g(3)), number(g(2)), number(g(1)), low, high)

    def dmy(g):
        y = number(g(3))
        return plausible_date(number(g(1)), number(g(2)), y, low, high) | plausible_date(
            number(g(2)), number(g(1)), y, low, high
        )

    found = F.array_compact(
        F.concat(
            _matches(NAMED_DATE, "regex_named_month", 0, 0.75, named),
            _matches(YMD_DATE, "regex_ymd", 1, 0.70, ymd),
            _matches(DMY_DATE, "regex_dmy", 2, 0.70, dmy),
        )
    )
    rows = (
        tokens.withColumn("t", strip("text"))
        .where(F.col("t").rlike(r"\d"))
        .select("document_id", "idx", keyed.alias("here"), F.explode(found).alias("c"))
    )
    before = _next_flags(tokens, keyed, before=F.lit(True))
    bonus = F.when(F.col("here") | F.coalesce("before", F.lit(False)), 0.25).otherwise(0.0)
    return rows.join(before, ["document_id", "idx"], "left").select(
        "document_id",
        "idx",
        F.col("c.rank").alias("rank"),
        F.col("c.pos").alias("pos"),
        F.lit("date").alias("field_name"),
        F.col("c.value").alias("value"),
        F.round(F.least(F.lit(1.0), F.col("c.base") + bonus), 4).alias("confidence"),
        F.array("idx").alias("token_indices"),
        F.col("c.rule").alias("rule"),
    )


def best(candidates: DataFrame, *order: Column) -> DataFrame:
    """The first candidate per document in the given order (partial aggregation, no window)."""
    pick = F.min_by(F.struct(*COLUMNS[1:]), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    return candidates.groupBy("document_id").agg(pick.alias("c")).select("document_id", "c.*")


def extract_date(tokens: DataFrame, vocabulary: str = "full") -> DataFrame:
    """Most confident date; earlier tokens, then named month, year-first and day-first patterns, break ties."""
    c = date_candidates(tokens, vocabulary)
    return best(c, -F.col("confidence"), F.col("idx"), F.col("rank"), F.col("pos"))


def extract_total(
    tokens: DataFrame, vocabulary: str = "full", fallback_largest: bool = False, fallback_penalty: float = 0.5
) -> DataFrame:
    """Amount next to a total keyword, preferring grand totals and then larger amounts.

    A token holding a negative keyword never yields an amount. The optional fallback takes a document's largest
    amount at a penalized confidence when no keyword matches.
    """
    positive, negative = VOCABULARY[vocabulary]["total"], VOCABULARY[vocabulary]["total_negative"]
    upper = F.upper("text")
    good, bad, grand = contains_any(upper, positive), contains_any(upper, negative), upper.contains("GRAND")
    amounts = tokens.withColumn("t", strip("text")).select(
        "document_id",
        "idx",
        good.alias("good"),
        bad.alias("bad"),
        grand.alias("grand"),
        F.posexplode(F.regexp_extract_all("t", F.lit(AMOUNT), F.lit(1))).alias("pos", "value"),
    )
    before = _next_flags(tokens, (good & ~bad) | grand, prev_total=good & ~bad, prev_grand=grand)
    joined = amounts.join(before, ["document_id", "idx"], "left")
    prev = F.coalesce("prev_total", F.lit(False))
    big = F.col("grand") | F.coalesce("prev_grand", F.lit(False))
    keyword = joined.where(~F.col("bad") & (F.col("good") | prev)).select(
        "document_id",
        "idx",
        "pos",
        F.lit("total").alias("field_name"),
        "value",
        F.when(big, 0.95).otherwise(0.85).alias("confidence"),
        F.when(prev, F.array(F.col("idx") - 1, F.col("idx"))).otherwise(F.array("idx")).alias("token_indices"),
        F.lit("keyword_proximity").alias("rule"),
    )
    value = F.col("value").cast("double")
    out = best(keyword, -F.col("confidence"), -value, F.col("idx"), F.col("pos"))
    if not fallback_largest:
        return out
    largest = amounts.select(
        "document_id",
        "idx",
        "pos",
        F.lit("total").alias("field_name"),
        "value",
        F.lit(round(max(0.0, min(1.0, 1.0 - fallback_penalty)), 4)).alias("confidence"),
        F.array("idx").alias("token_indices"),
        F.lit("fallback_largest_amount").alias("rule"),
    )
    rest = best(largest, -value, F.col("idx"), F.col("pos")).join(out.select("document_id"), "document_id", "left_anti")
    return out.unionByName(rest)


def company_candidates(tokens: DataFrame, vocabulary: str = "full", header_lines: int = 5) -> DataFrame:
    """Header lines among the first ``2 * header_lines`` tokens that may name the company, scored."""
    legal, negative = VOCABULARY[vocabulary]["company_legal"], VOCABULARY[vocabulary]["company_negative"]
    v, upper = F.col("value"), F.col("_upper")
    rows = bound(tokens.where(F.col("idx") < header_lines * 2), value=strip("text"))
    rows = bound(rows.where(F.char_length(v).between(3, 100) & (digit_ratio(v) <= 0.35)), _upper=F.upper(v))
    rows = rows.where(~contains_any(upper, negative))
    score = (
        F.greatest(F.lit(0.4), 0.85 - F.col("idx") * 0.08)
        + F.when(contains_any(upper, legal), 0.25).otherwise(0.0)
        + F.when(is_upper(v) & (F.char_length(v) > 4), 0.05).otherwise(0.0)
    )
    return rows.select(
        "document_id",
        "idx",
        F.lit("company").alias("field_name"),
        "value",
        F.round(F.least(F.lit(1.0), score), 4).alias("confidence"),
        F.array("idx").alias("token_indices"),
        F.lit("header_legal_heuristic").alias("rule"),
    )


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their rank in the document: most confident first, then by position. For a few per document."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("confidence"), "idx")))


def extract_company(tokens: DataFrame, vocabulary: str = "full", header_lines: int = 5) -> DataFrame:
    """Best header line among the first ``2 * header_lines`` tokens."""
    return best(company_candidates(tokens, vocabulary, header_lines), -F.col("confidence"), F.col("idx"))


def _address_frame(blocks: DataFrame) -> DataFrame:
    parts = F.col("parts")
    score = F.least(F.lit(1.0), 0.65 + F.least(F.lit(0.30), F.col("features") * 0.10))
    return blocks.select(
        "document_id",
        F.lit("address").alias("field_name"),
        join_address(F.transform(parts, lambda p: p["t"])).alias("value"),
        F.round(score, 4).alias("confidence"),
        F.transform(parts, lambda p: p["idx"]).alias("token_indices"),
        F.lit("header_address_block").alias("rule"),
    )


def extract_address(
    tokens: DataFrame, company: DataFrame, vocabulary: str = "full", max_lines: int = 6
) -> DataFrame:
    """Address block below the company line, else the first three address-like tokens anywhere.

    The block search sees at most ``3 * max_lines`` tokens per document, the fallback keeps three.
    """
    location, negative = VOCABULARY[vocabulary]["location"], VOCABULARY[vocabulary]["address_negative"]
    start = company.select("document_id", (F.array_max("token_indices") + 1).alias("start"))
    upper = F.upper(F.col("t"))
    digits = digit_ratio(F.col("t"))
    marked = tokens.withColumn("t", strip("text")).select(
        "document_id",
        "idx",
        "t",
        contains_any(upper, ADDRESS_STOP).alias("stop"),
        contains_any(upper, negative).alias("skip"),
        (contains_any(upper, location).cast("int") + F.col("t").rlike(POSTCODE).cast("int")).alias("hits"),
        (~(upper.contains("TEL") | (digits > 0.6)) & (F.char_length("t") > 3)).alias("plain"),
    )
    header = marked.join(start, "document_id", "left").where(
        (F.col("idx") >= F.coalesce("start", F.lit(0)))
        & (F.col("idx") < F.coalesce("start", F.lit(0)) + max_lines * 3)
    )
    ordered = header.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "t", "stop", "skip", "hits", "plain"))).alias("rows")
    )
    # Up to the first stop word, without contact lines, from the first address-like line on.
    end = F.array_position(F.transform("rows", lambda r: r["stop"]), True).cast("int")
    ordered = ordered.withColumn("rows", F.filter(
        F.when(end > 0, F.slice("rows", F.lit(1), end - 1)).otherwise(F.col("rows")), lambda r: ~r["skip"]))
    begin = F.array_position(F.transform("rows", lambda r: r["hits"] > 0), True).cast("int")
    ordered = ordered.where(begin > 0).withColumn("rows", F.filter(
        F.slice("rows", begin, F.size("rows")), lambda r: (r["hits"] > 0) | r["plain"]))
    # Plain continuation lines count only while the block is shorter than max_lines; address-like ones always do.
    later = F.slice("rows", F.lit(max_lines + 1), F.greatest(F.size("rows") - max_lines, F.lit(0)))
    kept = F.concat(F.slice("rows", 1, max_lines), F.filter(later, lambda r: r["hits"] > 0))
    blocks = ordered.select(
        "document_id",
        F.aggregate(kept, F.lit(0), lambda acc, r: acc + r["hits"]).alias("features"),
        F.transform(kept, lambda r: F.struct(r["idx"].cast("int").alias("idx"), r["t"].alias("t"))).alias("parts"),
    )
    first = Window.partitionBy("document_id").orderBy("idx")
    scattered = (
        marked.where((F.col("hits") > 0) & ~F.col("skip"))
        .withColumn("_k", F.row_number().over(first))
        .where("_k <= 3")
        .groupBy("document_id")
        .agg(
            F.count("*").cast("int").alias("_features"),
            F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "t"))).alias("_parts"),
        )
    )
    # Both are computed once; the scattered lines serve the documents without a block.
    return _address_frame(
        blocks.join(scattered, "document_id", "full").select(
            "document_id", F.coalesce("features", "_features").alias("features"), F.coalesce("parts", "_parts").alias("parts")
        )
    )


def extract_fields(
    tokens: DataFrame, vocabulary: str = "full", min_confidence: float = 0.2, fallback_largest: bool = False
) -> DataFrame:
    """All four fields as long rows with confidence, source tokens and rule."""
    company = extract_company(tokens, vocabulary)
    frames = [
        company,
        extract_date(tokens, vocabulary),
        extract_address(tokens, company, vocabulary),
        extract_total(tokens, vocabulary, fallback_largest),
    ]
    out = frames[0].select(*COLUMNS)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*COLUMNS))
    return out.where(F.col("confidence") >= min_confidence)


def field_union_bbox(fields: DataFrame, boxes: DataFrame) -> DataFrame:
    """Union box of each field's source tokens, five decimals; indices without a token are ignored."""
    picked = fields.select("document_id", "field_name", F.explode("token_indices").alias("idx"))
    return (
        picked.join(boxes, ["document_id", "idx"])
        .groupBy("document_id", "field_name")
        .agg(
            F.round(F.min("x_min"), 5).alias("x_min"),
            F.round(F.min("y_min"), 5).alias("y_min"),
            F.round(F.max("x_max"), 5).alias("x_max"),
            F.round(F.max("y_max"), 5).alias("y_max"),
        )
    )


# Reading order ----------------------------------------------------------------------------------------------


def _tolerances(boxes: DataFrame, factor: float) -> DataFrame:
    """``(document_id, tol, tokens)``: the share of the median token height by which a token may miss its line's centre.

    Heights are counted per document first, so a document's median is taken over its different heights.
    """
    height = F.col("y_max") - F.col("y_min")
    counted = boxes.groupBy("document_id", F.when(height > 0, height).alias("height")).agg(F.count(F.lit(1)).alias("n"))
    median = F.coalesce(F.percentile("height", F.lit(0.5), F.col("n")), F.lit(15.0))
    return counted.groupBy("document_id").agg(
        F.greatest(F.lit(1.0), factor * F.greatest(F.lit(1.0), median)).alias("tol"), F.sum("n").alias("tokens"))


CENTRE_ORDER = ["yc", "x_min", "idx"]
#: Documents of more tokens are ordered by slices, so that they spread over tasks; smaller ones by plain windows.
LARGE_DOCUMENT = 200_000


def _by_size(boxes: DataFrame, factor: float, slices: int | None) -> list[tuple[DataFrame, bool]]:
    """Tokens with their centre and tolerance, in two parts: of documents for one task each, and of larger ones.

    The second part is left out if there is none. With ``slices`` all documents count as large.
    """
    tolerances = written(_tolerances(boxes, factor), "tolerances")
    rows = boxes.withColumn("yc", (F.col("y_min") + F.col("y_max")) / 2.0).alias("b")
    large = F.col("tokens") > (LARGE_DOCUMENT if slices is None else 0)
    met = lambda own: rows.join(tolerances.where(own).alias("t"), same("b", "t", ["document_id"])).select("b.*", "t.tol")
    if not tolerances.where(large).limit(1).count():
        return [(met(~large), False)]
    return [(met(large), True)] if slices is not None else [(met(~large), False), (met(large), True)]


def _segments(rows: DataFrame, split: bool, slices: int | None = None) -> DataFrame:
    """Tokens with a segment: the centre of its first token.

    Sorted by centre, a step wider than the tolerance always starts a new line, so it is a safe place to cut. With
    ``split`` the order is by slices, otherwise a document is one.
    """
    doc = ["document_id"]

    def earlier(rows: DataFrame, value: str, name: str) -> DataFrame:
        if split:
            return carried(rows, doc, [F.max(value).alias("last")], {name: F.max("last")})
        return rows.withColumn(name, F.lit(None).cast("double"))

    cut = sliced(rows, doc, CENTRE_ORDER, "reading-slices", slices) if split else rows.withColumn(SLICE, F.lit(0))
    own = within(doc, CENTRE_ORDER)
    cut = earlier(cut, "yc", "_last")
    step = F.col("yc") - F.coalesce(F.lag("yc").over(own), F.col("_last"))
    starts = F.when(step.isNull() | (step > F.col("tol")), F.col("yc"))
    cut = cut.withColumn("_start", F.max(starts).over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_last")
    return earlier(cut, "_start", "_from").withColumn("segment", F.coalesce("_start", "_from")).drop("_start", "_from", SLICE)


LINE_COLUMNS = ["document_id", "idx", "text", "x_min", "y_min", "segment"]
LOOK_AHEAD = 16


def fold_lines(yc: np.ndarray, first: np.ndarray, tol: np.ndarray, total: np.ndarray, n: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The line of every token: it joins its segment's line within the tolerance of that line's mean centre.

    Segment ``k`` has the tokens from ``first[k]`` to ``first[k + 1]``. ``total``, ``n`` and ``line`` are the open lines'
    sums, sizes and numbers; they are brought up to date. A round looks at the next few tokens of all segments.
    """
    out = np.empty(len(yc), np.int32)
    at, end = first[:-1].copy(), first[1:]
    left = np.flatnonzero(at < end)
    ahead = np.arange(LOOK_AHEAD)
    while len(left):
        place = at[left, None] + ahead
        inside = place < end[left, None]
        y = np.where(inside, yc[np.minimum(place, len(yc) - 1)], 0.0)
        sums = np.cumsum(np.concatenate([total[left, None], y], axis=1), axis=1)
        size = n[left, None] + ahead
        far = inside & (size > 0) & (np.abs(y - sums[:, :-1] / np.maximum(size, 1)) > tol[left, None])
        breaks = far.any(axis=1)
        take = np.where(breaks, far.argmax(axis=1), inside.sum(axis=1))
        joins = ahead < take[:, None]
        out[place[joins]] = np.repeat(line[left], take)
        at[left] += take
        total[left] = np.where(breaks, 0.0, sums[np.arange(len(left)), take])
        n[left] = np.where(breaks, 0, n[left] + take)
        line[left] += breaks
        left = left[at[left] < end[left]]
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of tokens that come sorted by document, segment and centre; what is open at a batch's end is carried over."""
    state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, segment, yc, tol = (batch.column(c) for c in ("document_id", "segment", "yc", "tol"))
        number = pc.fill_null(doc.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        place = segment.to_numpy(zero_copy_only=False)
        new = np.ones(len(yc), bool)
        new[1:] = (number[1:] != number[:-1]) | (place[1:] != place[:-1])
        heads = np.flatnonzero(new)
        total, n, line = np.zeros(len(heads)), np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int32)
        if state is not None and state[0] == (doc[0].as_py(), place[0]):
            total[0], n[0], line[0] = state[1:]
        found = fold_lines(yc.to_numpy(zero_copy_only=False), np.append(heads, len(yc)), tol.to_numpy(zero_copy_only=False)[heads], total, n, line)
        state = (doc[-1].as_py(), place[-1]), total[-1], n[-1], line[-1]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in LINE_COLUMNS], pa.array(found)], names=[*LINE_COLUMNS, "line"])


def _lines_of(rows: DataFrame, split: bool, exact: bool, slices: int | None) -> DataFrame:
    cut = _segments(rows, split, slices)
    if not exact:
        return cut.select(*LINE_COLUMNS, F.lit(0).alias("line"))
    kept = cut.select(*LINE_COLUMNS, "yc", F.col("tol").cast("double"))
    ordered = kept.repartition("document_id", "segment").sortWithinPartitions("document_id", "segment", *CENTRE_ORDER)
    return ordered.mapInArrow(_lines, kept.select(*LINE_COLUMNS, F.lit(0).alias("line")).schema)


def reading_lines(boxes: DataFrame, factor: float = 0.5, exact: bool = True, slices: int | None = None) -> DataFrame:
    """Token -> line assignment ``(document_id, idx, text, x_min, y_min, segment, line)``.

    ``exact`` compares each token with its line's running mean centre: tokens stream by in order and a segment's open
    line is a sum, a size and a number, so work is linear and memory is a batch, also for a document of one segment.
    Otherwise a segment is a line, which differs on slowly drifting lines.
    """
    return reduce(DataFrame.unionByName, [_lines_of(rows, split, exact, slices) for rows, split in _by_size(boxes, factor, slices)])


def reading_order(boxes: DataFrame, factor: float = 0.5, exact: bool = True, slices: int | None = None) -> DataFrame:
    """Lines of text top to bottom: ``(document_id, line_no, text)``; blank lines are dropped."""
    words = F.array_sort(F.collect_list(F.struct("x_min", "y_min", "idx", strip("text").alias("t"))))
    kept = F.filter(F.transform(words, lambda s: s["t"]), lambda s: s != "")
    order, parts = ["top", "segment", "line"], []
    for rows, split in _by_size(boxes, factor, slices):
        out = _lines_of(rows, split, exact, slices).groupBy("document_id", "segment", "line").agg(
            F.min("y_min").alias("top"), F.array_join(kept, " ").alias("text")
        ).where("text <> ''")
        if split:
            out = numbered(out, ["document_id"], order, "line_no", "reading-lines", slices)
        else:
            out = out.withColumn("line_no", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
        parts.append(out.select("document_id", "line_no", "text"))
    return reduce(DataFrame.unionByName, parts)
