import pytest

from leafscore.llm.html_extract import content, extract_text, host_templates, parse

ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a href=x>Home</a></nav>
<header><h1>Site</h1></header><article class="post"><header><h1>Title</h1><p>by me</p></header><p>First  &amp;
<b>bold</b> text<br>line &lt;3 &#65;<p>Second<script>var a = "</p><p>";</script> part<aside>no</aside><div class="ad-box">buy</div>
<section class=comments><p>nice!</section><!-- <p>hidden</p> --><p hidden>secret</p></article><footer>f</footer></body></html>"""


def test_article_without_what_stands_around_it():
    assert content(ARTICLE, frozenset()) == "Title\nFirst & bold text line <3 A\nSecond part"


@pytest.mark.parametrize("html,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b</p>c", "a\nb\nc"), ("<article><p><b>a<br><p>b", "a\nb"),
    ("<article>cut off &am", "cut off &am"), ("<article><p>x <3 y</p>", "x <3 y"), ("<article>a<script>never closed", "a"),
    ("<article>a<!-- never closed <p>b", "a"), ("<ul><li>a<li>b</ul>", "a\nb"), ("</div></p>a</b>", "a"),
    ("<article><p title='a>b'>x</p><img src=\"<p>\">y", "x\ny"), ("<table><tr><td>a<td>b</table>", "a\nb"),
    ("<article><P>A</P><FOOTER>x</FOOTER>", "A"), ("<article>&nbsp; a &nbsp;b", "a b"), ("<a href=\"x>broken", ""),
])
def test_lenient_reading(html, want):
    assert content(html, frozenset()) == want


def page(k, body):
    return f"<html><body><div class=top><span>Welcome to the site</span></div><div>{body}</div><p>All rights kept by us</p></body></html>"


def test_template_texts_of_a_host_are_left_out(spark):
    rows = [(k, f"http://a.example/{k}", page(k, f"<p>Story number {k} goes like this</p><p>It ends well for {k}</p>")) for k in range(20)]
    rows += [(100 + k, f"https://user@B.example:80/{k}", page(k, f"<p>Tale {k}</p>")) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    templates = {r.host: r.template for r in host_templates(pages).collect()}
    assert set(templates) == {"a.example"}
    found = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert found[3] == "Story number 3 goes like this\nIt ends well for 3"
    assert found[100] == "Welcome to the site\nTale 0\nAll rights kept by us"  # two pages make no template


def test_equal_articles_on_one_host_stay_whole(spark):
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", ARTICLE) for k in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extract_text(pages).collect()} == {content(ARTICLE, frozenset())}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x.example", "<p>a"), (2, "not a url", "<p>b"), (2, "not a url", "<p>b"),
            (3, "http://x.example", "<p>" + "long words " * 200_000), (4, "http://x.example", "<div>" * 20_000 + "deep")]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, text string, salt int")
    found = extract_text(pages).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 1), (1, 0), (2, 0), (2, 1), (2, 1), (3, 2_199_999), (4, 4)]
    assert extract_text(pages.where("false")).count() == 0


def test_blocks_know_what_encloses_them():
    blocks, paths = parse("<body><main><p>a <a href=x>link</a></p></main><nav>b</nav>")
    assert [(b.text, b.main, b.outside, b.linked) for b in blocks] == [("a link", True, False, 4), ("b", False, True, 0)]
    assert paths["/body/main/p"] == 1


@pytest.mark.parametrize("html", [
    "<article class='post with-sidebar'><p>kept</article>", "<main class='no-sidebar'><p>kept</main>", "<article class='sponsored'><p>kept</article>",
    "<article><div class='share-enabled content'><p>kept</div></article>", "<article><div class='search-result'>kept</div></article>",
    "<article><div class='header-image'>kept</div></article>", "<form id=aspnet><article><p>kept</article></form>",
    "<div class='widget'><main><article class=share><p>kept</article></main></div>", "<body><form><p>kept</p></form></body>",
    "<div class=comments><article><header><h1>kept</h1></header></article></div>",
])
def test_names_and_forms_lose_no_article(html):
    assert content(html, frozenset()) == "kept"


@pytest.mark.parametrize("html", [
    "<article>kept<section class=comments><article class=comment>no</article></section></article>", "<article>kept<div class='ad-box-2'>no</div></article>",
    "<article>kept<form>no</form></article>", "<article>kept<div class='share-buttons'>no</div></article>",
    "<div hidden><article>no</article></div><article>kept</article>",
])
def test_parts_outside_an_article_still_go(html):
    assert content(html, frozenset()) == "kept"


def test_an_article_outside_the_template_keeps_its_links():
    html = "<article><p>words</p><p><a href=x>a list of links</a></p></article>"
    assert content(html, frozenset({1})) == "words\na list of links"
