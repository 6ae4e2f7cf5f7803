"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.llm.words import map_slices

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of international bank account numbers (spaces removed, upper case)."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


# Domain after the at sign; the part before it is found by walking back, so a long run without an at sign costs nothing.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a digit run starts; possessive runs keep the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[Span]:
    """The longest part from a start, up to a space or the end of the match, that passes: other words may follow."""
    at = 0
    while (m := _IBAN.search(text, at)) is not None:
        start, end, at = m.start(), m.end(), m.start() + 1
        while end > start:
            compact = text[start:end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def ssns(text: str) -> Iterator[Span]:
    for m in _SSN.finditer(text):
        yield m.span()


class Kind(NamedTuple):
    """A finder, whether its spans stand without context, its start score, and words nearby that raise the score."""

    find: Callable[[str], Iterator[Span]]
    base: bool
    score: float
    near: tuple[str, ...]


#: In the order in which spans with the same start are listed.
KINDS: dict[str, Kind] = {
    "email": Kind(emails, True, 0.9, ("mail", "contact", "write")),
    "ip": Kind(ips, True, 0.8, ("ip", "host", "server", "address")),
    "card": Kind(cards, True, 0.8, ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte")),
    "phone": Kind(phones, True, 0.8, ("phone", "call", "tel", "mobile", "fax")),
    "iban": Kind(ibans, False, 0.8, ("iban", "bank", "account", "konto", "cuenta", "compte")),
    "ssn": Kind(ssns, False, 0.3, ("ssn", "social", "security")),
}
WORDS_NEAR = re.compile(r"[^\W\d_]+")


def find_spans(text: str, window: int, threshold: float, boost: float) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score), sorted. Kinds that are not base need ``threshold``, context included."""
    found = []
    dotted = "." in text
    digit = re.search("[0-9]", text) is not None
    for number, (name, kind) in enumerate(KINDS.items()):
        if not (("@" in text) if name == "email" else digit and (dotted or name != "ip")):
            continue
        for start, end in kind.find(text):
            around = f"{text[max(0, start - window): start]} {text[end: end + window]}".lower()
            near = any(w.startswith(kind.near) for w in WORDS_NEAR.findall(around))
            score = min(1.0, kind.score + boost * near)
            if kind.base or score >= threshold:
                found.append((start, number, end, score))
    return sorted(found)


def find_pii(
    docs: DataFrame, window: int = 40, threshold: float = 0.6, boost: float = 0.4, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep`` and ``spans``, an array of (kind, start, end, score) in code points, of every whole text.

    Emails, addresses, cards (Luhn) and phones are always kept once their checks pass; bank accounts (mod 97) and
    social security numbers need the ``threshold``, to which words within ``window`` characters add ``boost``. Spans
    are ordered by start, then kind. Null and empty texts have none; repeated rows give equal results.
    """
    names = list(KINDS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work():
        def one(part: pa.RecordBatch) -> list:
            rows = [
                [{"kind": names[k], "start": s, "end": e, "score": p} for s, k, e, p in find_spans(t, window, threshold, boost)]
                if t else [] for t in part.column("text").to_pylist()]
            return [pa.array(rows, kind)]
        return one

    return map_slices(
        docs.select(*keep, "text"), [*keep], "spans array<struct<kind: string, start: long, end: long, score: double>>", work)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` and the text with each span replaced by its kind in brackets; overlapping spans become one, the first's."""
    names = list(KINDS)

    def work():
        def one(part: pa.RecordBatch) -> list:
            out = []
            for text in part.column("text").to_pylist():
                pieces, at = [], 0
                for s, k, e, _ in find_spans(text or "", options.get("window", 40), options.get("threshold", 0.6), options.get("boost", 0.4)):
                    if s >= at:
                        pieces += [text[at:s], f"[{names[k].upper()}]"]
                    at = max(at, e)
                out.append(None if text is None else "".join([*pieces, text[at:]]))
            return [pa.array(out, pa.string())]
        return one

    return map_slices(docs.select("doc_id", "text"), ["doc_id"], "redacted string", work)
