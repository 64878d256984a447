"""Pages: main text and URL templates."""

import re

import pytest
from pyspark.sql import functions as F

from smeltry.llm import html_text, url_templates

PAGE = """<html><head><title>no</title></head><body class="has-sidebar nav"><header><h2>Site</h2></header><nav><a href=1>x</a></nav>
<div id="cookie-notice">We use cookies, lots, of, them, really.</div><div class="wrap"><div class="content"><h1>T &amp; U</h1>
<p>First para, with text <a href=x>link</a>  and
more.<p>Second, para.<ul><li>item one</li><li>item two</li></ul><div class="share"><a>tw</a></div><form><p>a,b,c,d,e,f</form><p>End.</div>
<aside><p>Side, text, here, many, commas, you, know</aside><div class="comments"><p>I, reader, say, so, many, many, things, indeed</div></div><footer>c</footer>"""


def test_article_without_its_surroundings():
    assert html_text.main_text(PAGE) == "T & U\nFirst para, with text link and more.\nSecond, para.\nitem one\nitem two\nEnd."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("plain text, only", "plain text, only"), ("<p>a<b>c", "ac"), ("<!-- x", ""),
        ("<div><div><p>hi", "hi"), ("<script>x", ""), ("<div>" * 20000 + "x", "x"), ("<p>a&lt;b&gt;&#233;&nbsp;c", "a<b>é c"),
        ("<article><p>one<p>two</article><p>out", "one\ntwo"), ('<p title="a>b">in</p>', "in"), ("<p>a<br>b", "a b"), ("<ul><li><a>x</a><li><a>y</a></ul>", ""),
    ],
)
def test_odd_pages(page, text):
    got = html_text.main_text(page)
    assert got == text or page.startswith("<ul>") and got in ("", "x\ny")


def paragraphs(n, word="word"):
    return [f"{word} {k}, " + "some text that goes on, " * 5 + "end." for k in range(n)]


def tagged(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


LONG, FEW = paragraphs(20), paragraphs(3, "few")


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<article><h1>T</h1><div class=body>{tagged(LONG)}</div><p>Short end.</p></article>", ["T", *LONG, "Short end."]),
        (f"<nav>n</nav><article><section>{tagged(LONG)}</section><section><h2>S</h2>{tagged(FEW[:1])}</section></article><p>x", [*LONG, "S", *FEW[:1]]),
        (f"<main><h1>T</h1><article><header><h2>U</h2></header><div>{tagged(LONG)}</div></article></main>", ["T", "U", *LONG]),
        (f"<div class=w><div class=c><h1>T</h1><div class=b>{tagged(LONG)}</div><div>Short end.</div></div></div><footer>f</footer>", ["T", *LONG, "Short end."]),
        (f"<h1>T</h1><div>{tagged(LONG)}</div><p>Short end.</p><div>{tagged(FEW)}</div>", ["T", *LONG, "Short end.", *FEW]),
        (f"<article>{tagged(FEW)}<ul><li><a>Ann: First title</a>, in print, 2001<li><a>Bob: Second title</a>, a book, 2002</ul><ul><li><a>up</a><li><a>down</a></ul></article>", [*FEW, "Ann: First title, in print, 2001", "Bob: Second title, a book, 2002"]),
    ],
)
def test_nothing_of_an_article_is_lost(page, lines):
    assert html_text.main_text(page).split("\n") == lines


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div class="overflow-hidden">', "</div>"), ('<article class="post has-sidebar">', "</article>"), ('<main class="no-sidebar">', "</main>"), ('<div id="content-with-related">', "</div>"),
        ('<div title="Hidden costs" data-id="ad">', "</div>"), ('<div class="sidebar">', "</div>"), ('<form id="aspnet"><div class="form">', "</div></form>"), ('<div class="alert"><article class="promo">', "</article></div>"),
        ('<div class="widget"><aside><main role="banner">', "</main></aside></div>"), ('<article><div class="widget">', "</div></article>"), ("<header><article>", "</article>"),
    ],
)
def test_names_do_not_lose_the_article(before, after):
    around = '<nav><a>n</a></nav><div class="cookie-notice">We use cookies.</div>', '<div class="share"><a>s</a></div><footer>f</footer>'
    assert html_text.main_text(f"{around[0]}{before}{tagged(LONG)}{after}{around[1]}").split("\n") == LONG


def test_named_parts_beside_the_article_are_left_out():
    parts = '<div class="site-notice"><p>a, b, c</div>', '<div id=comments>' + tagged(LONG) + "</div>", "<p hidden>h</p>", '<p title="Hidden costs">' + FEW[0] + "</p>"
    assert html_text.main_text(f"<div>{parts[0]}{tagged(FEW)}{parts[1]}{parts[2]}{parts[3]}</div>").split("\n") == [*FEW, FEW[0]]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>x</title><body><article><p>a</article>", "a"), ("<head><meta charset=a><p>a<p>b", "a\nb"), ("<head><title>x</title><div>a</div></head>", "a"), ("<head><title>x</title>a", "a"),
        ("<head><style>p{}</style><template><p>x</template><link rel=a></head>\n<body>a", "a"),
    ],
)
def test_a_head_without_end(page, text):
    assert html_text.main_text(page) == text


def test_unclosed_quotes_take_linear_time():
    assert html_text.main_text("<a " + '"' * 20001 + "<p>" * 2000) is not None


def test_frame_and_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    docs = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert all(" ".join(r.text.split("\n")[1:]) in docs for r in rows)  # the first line is the heading
    assert html_text.extract(pages.limit(0)).collect() == []


def brute_rule(host, path):
    best = (None, None)
    for v, h, p in url_templates.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, v)
    return best


def test_urls_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x=/en/", "https://example.org/en/17", "https://notexample.org/es/1", "http://x.com/fr/1#a",
        "http://x.com?q=/fr/", "http://x.com/de/", "http://x.com/DE/", "ftp://É.com/fr/", "a://b://c/d", "http://org/", "http://org", "//x.com/fr/1", "http://x.com/a//b/c/d/e",
    ] * 2
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_templates.judged(pages, None, url_templates.RULES).collect():
        host, path = "", ""
        if urls[r.page_id] and "://" in urls[r.page_id]:
            host, path = re.match(r"([^/?#]*)([^?#]*)", urls[r.page_id].split("://", 1)[1]).groups()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_templates_and_purity(spark):
    rows = [(k, f"http://a.net/{'bad' if k % 4 == 0 else 'good'}/{k}") for k in range(400)] + [(1000 + k, f"http://b.net/x/{k}") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None)], "id long, bad int")
    got = url_templates.judged(pages, labels, []).collect()
    assert {(r.host, r.template, r.verdict) for r in got} == {("a.net", "/bad/*", "block"), ("a.net", "/good/*", "allow"), ("b.net", "/+/*", "allow")}
    assert all(r.rule is None for r in got) and len(got) == 450
    assert url_templates.judged(pages.limit(0), labels, []).collect() == []


def test_similar_branches_are_merged(spark):
    rows = [(k, f"http://a.net/{'en' if k % 2 else 'fr'}/{k}") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 10 < 2)) for k in range(400)], "id long, bad int")
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string"), labels, []).select("template").distinct().collect()
    assert [r.template for r in got] == ["/+/*"]


def test_branches_by_their_own_evidence(spark):
    rows = [(k, f"http://a.net/s{k % 60}/{k}") for k in range(1200)]
    rows += [(2000 + k, f"http://b.net/2024/05/{12 + k % 2}/{'casino' if k % 20 < 4 else 'news'}/x/{2000 + k}") for k in range(400)]
    rows += [(3000 + k, "http://c.net" + "/d" * 300) for k in range(6)] + [(4000, "http://d.net/a/b/c/d/e")]
    labels = spark.createDataFrame([(k, int(k % 60 == 7)) for k in range(1200)] + [(2000 + k, int(k % 20 < 4)) for k in range(400)], "id long, bad int")
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string"), labels, []).collect()
    assert len(got) == len(rows)
    assert {(r.host, r.template, r.verdict) for r in got} == {
        ("a.net", "/s7/*", "block"), ("a.net", "/+/*", "allow"), ("b.net", "/+/+/+/casino/+/*", "block"), ("b.net", "/+/+/+/news/+/*", "allow"),
        ("c.net", "/+" * 300, "allow"), ("d.net", "/*" * 5, "allow"),
    }
