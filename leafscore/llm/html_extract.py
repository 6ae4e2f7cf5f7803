"""Main text of web pages by template deduction: tokens with equal occurrence vectors over a host's pages form the template."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.llm.common import small_side, stored
from leafscore.llm.words import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
#: Elements whose text is never part of an article.
OUTSIDE = frozenset(
    "aside button canvas dialog footer form frameset head header iframe input menu nav noembed noframes noscript object script select "
    "style svg template textarea title".split())
#: Class, id and role words that mark parts outside the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Words that name a box and not what it holds: with a listed word they still mark a part outside the article.
BOX_NAMES = frozenset(
    "area bar block bottom box btn button buttons column container content form global group holder icons inner item items left link "
    "links list main module outer page panel posts primary right row secondary section site slot text title top unit wrap wrapper".split())
#: First words of class names that tell of a layout.
LAYOUT_NAMES = frozenset("has is no not with without".split())
RAW = frozenset(("script", "style", "textarea", "title", "noembed", "noframes", "iframe", "xmp"))
#: An opening tag on the left ends an open element on the right, up to the nearest list or table around it.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "menu"))

_TOKEN = re.compile(
    r"<!--|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    """A run of text between block-level tags: where it stands, its text and what encloses it."""

    path: str
    text: str
    main: bool
    outside: bool
    linked: int
    form: bool = False  # outside only for the form around it


def _named_outside(name: str) -> bool:
    """Whether a class, id or role word marks a part outside the article: each of its parts is listed or names a box."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return (bool(parts) and parts[0] not in LAYOUT_NAMES and any(p in OUTSIDE_NAMES for p in parts)
            and all(p in OUTSIDE_NAMES or p in BOX_NAMES or p.isdigit() for p in parts))


def _outside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element is outside the article for its tag (a form apart) or for being hidden, and for its name."""
    if tag in OUTSIDE and tag != "form":
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    for m in _NAMES.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
        named = named or name in ("class", "id", "role") and any(_named_outside(v) for v in value.split())
    return False, named


def parse(html: str) -> tuple[list[Block], Counter]:
    """The text blocks of a page in order, and how often each element path occurs. Broken markup is read leniently.

    A name or a form never excludes a main element, or an article element that is not inside another (as comments are),
    nor does one around it.
    """
    blocks: list[Block] = []
    paths: Counter = Counter()
    # tag, path, main, outside, link; outside also without forms; outside also without forms and names; inside an article
    stack: list[tuple[str, str, bool, bool, bool, bool, bool, bool]] = []
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            _, path, main, outside, _, named, *_ = stack[-1] if stack else ("", "", False, False, False, False)
            blocks.append(Block(path, text, main, outside, linked, outside and not named))
        linked = 0

    def close(at: int) -> None:
        """End the element at the position and all inside it; the text so far belongs where it stands."""
        if any(tag in BLOCK for tag, *_ in stack[at:]):
            flush()
        del stack[at:]

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if stack and stack[-1][4]:
            linked += len(text)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None or m.start() > at:
            add(unescape(html[at: m.start() if m else size]))
            if m is None:
                break
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            if m.group() in ("<!--", "<![CDATA["):
                end = html.find("-->" if m.group() == "<!--" else "]]>", at)
                at = size if end < 0 else end + 3
            continue
        tag, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            flush()
        if tag in ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS[tag]:
                    close(k)
                elif stack[k][0] in SCOPE:
                    break
        _, above, main, outside, link, named, hard, article = stack[-1] if stack else ("", "", *[False] * 6)
        title = main and outside and tag in ("h1", "h2", "h3") and stack[-1][0] == "header" and not stack[-2][3]
        path = f"{above}/{tag}"
        paths[path] += 1
        if tag in VOID:
            continue
        own, by_name = _outside(tag, attributes)
        if title:
            outside = named = hard = False
        elif tag == "main" or tag == "article" and not article:
            outside = named = hard = hard or own
        else:
            hard, named, outside = hard or own, named or own or by_name, outside or own or by_name or tag == "form"
        stack.append((tag, path, main or tag in ("article", "main"), outside, link or tag == "a", named, hard, article or tag == "article"))
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            stack.pop()
            at = size if end is None else end.start()
    flush()
    return blocks, paths


def _code(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(host, page, token, n)``: element paths and placed texts of every page and how often each occurs on it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, token, n = [], [], []
                for k, html in enumerate(part.column("text").to_pylist()):
                    blocks, paths = parse(html or "")
                    found = Counter({_code(p): c for p, c in paths.items()})
                    found.update(_code(b.path, b.text) for b in blocks)
                    found[_code("")] = 1  # the page itself
                    row += [k] * len(found)
                    token += found.keys()
                    n += found.values()
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(token, pa.int64()), pa.array(n, pa.int64())],
                    names=["host", "page", "token", "n"])

    return pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").alias("page"), F.col("html").alias("text")).mapInArrow(
        run, "host string, page long, token long, n long")


def host_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.9, min_class: int = 3) -> DataFrame:
    """``(host, template)``: the tokens of each host's template.

    A token's occurrence vector says how often it occurs on each page of the host. Vectors are compared by an
    order-free digest, so a token is one row after partial aggregation, however many pages its host has. Tokens of a
    host with the same vector are an equivalence class. A class is valid if it has ``min_class`` tokens and occurs on
    at least ``min_pages`` pages and a share ``min_share`` of the host's pages. Paths contain their ancestors' paths,
    which occur wherever they do, so valid classes nest along the element tree into one template. A page has all but
    a share of 1 - ``min_share`` of the template's tokens on average, which bounds the template by the size of a page.
    A host with fewer than ``min_pages`` pages has no template: equal texts on so few may be chance, and its pages are
    read by their elements and names alone.
    """
    tokens = page_tokens(pages).groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    tokens = stored(tokens.where(F.col("support") >= min_pages), "page-tokens")
    sizes = tokens.where(F.col("token") == _code("")).select("host", F.col("support").alias("pages"))
    classes = tokens.groupBy("host", "vector", "support").agg(
        F.count(F.lit(1)).alias("size"), F.collect_list(F.when(F.col("support") >= min_pages, F.col("token"))).alias("tokens"))
    valid = classes.join(sizes, "host").where((F.col("size") >= min_class) & (F.col("support") >= min_share * F.col("pages")))
    return valid.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("template"))


def content(html: str, template: frozenset[int]) -> str:
    """The article's text: what stands in the slots that the template leaves, outside the parts around the article.

    With an article or main element, the slots are the blocks inside it. Otherwise they are the blocks whose placed
    text is not itself part of the template and that do not consist mostly of links; the links of an article stay.
    A page whose text is all in forms is read as if they were not there.
    """
    blocks, _ = parse(html)
    inside = [b for b in blocks if not b.outside] or [b for b in blocks if b.form]
    article = [b for b in inside if b.main]
    # Without a template (few pages on the host) an article element speaks for itself.
    if article and (not template or any(_code(p) in template for p in {_article_path(b.path) for b in article})):
        slots = article
    else:
        slots = [b for b in article or inside if _code(b.path, b.text) not in template and (b.main or 2 * b.linked <= len(b.text))] or article
    return "\n".join(b.text for b in slots)


def _article_path(path: str) -> str:
    m = re.match(r".*?/(?:article|main)(?=/|\Z)", path)
    return m.group() if m else path


def extract_text(pages: DataFrame, **options) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page, read from the whole html.

    Templates are deduced per host from all its pages and joined to them: broadcast while a count shows few hosts,
    otherwise by host and a salt, so that a host with a third of all pages spreads over tasks. Null or empty html gives
    an empty text; a page without a host belongs to the host without a name; pages that repeat an id are read one by one.
    """
    templates = stored(host_templates(pages, **options), "templates")
    rows = pages.select("page_id", "url", F.col("html").alias("text"), host_of(F.col("url")).alias("host"),
                        F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int").alias("salt"))
    few = small_side(templates)
    if few is templates:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = rows.join(salted, ["host", "salt"], "left")
    else:
        joined = rows.join(few, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, frozenset[int]] = {}
        for batch in batches:
            for part in slices(batch):
                out = []
                hosts, templates = part.column("host").to_pylist(), part.column("template")
                for k, html in enumerate(part.column("text").to_pylist()):
                    if hosts[k] not in cache:
                        if len(cache) >= 256:
                            cache.clear()
                        cache[hosts[k]] = frozenset(templates[k].as_py() or ())
                    out.append(content(html or "", cache[hosts[k]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "host", "template", "text").mapInArrow(run, "page_id long, url string, text string")
