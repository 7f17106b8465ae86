"""Url rules and main text of pages."""

import re

import pytest

from watchgrid.llm import html_text, url_rules


def plain_judgement(url, rules=url_rules.RULES):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0, "", ""), (len(rule), verdict, rule))
    return host, path, best and best[2], best[1] if best else "allow"


URLS = [None, "", "no scheme", "http://Example.ORG/es/x", "http://a.example.org/en/1999?x#y", "https://example.org", "http://org/", "x://com/fr/",
        "http://shop.com/de/1", "http://shop.com/fr/de/", "http://notexample.org/es/", "http://a..com/de/?q=http://b.com/fr/", "://com/de/",
        "http://h.com?x=/de/", "http://h.com#/de/", "http://\u00c4.org/\u00e9", "http://x.com:80/de/", "http://h.com/DE/"]


def test_rules_match_plain_judgement(spark):
    df = spark.createDataFrame([(i, u, "x", 3) for i, u in enumerate(URLS + URLS)], "page_id int, url string, host string, verdict int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got == {i: plain_judgement(u) for i, u in enumerate(URLS + URLS)}
    assert url_rules.judge(df.where("1 = 0")).count() == 0


def test_equal_rules_and_null_ids(spark):
    df = spark.createDataFrame([(None, "http://a.b/c"), (None, "http://a.b/c")], "page_id int, url string")
    rows = url_rules.judge(df, (("b/", "allow"), ("b/", "block"))).collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [("b/", "block")] * 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   block.<br><p>Second&nbsp;block with <a href="x">a link</a> &eacute;.</p><p>Third.</p>
<form><input name=q>Subscribe</form><div class="comments"><p>Reader says hi there to all</p></div></article>
<aside>Side</aside><footer>&copy; host</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_text.extract(PAGE) == "Title & more First block. Second block with a link \u00e9. Third."


def test_attributes_are_read_whole():
    body = "".join(f"<p>Sentence number {i} of the text, long enough to be dense.</p>" for i in range(6))
    want = " ".join(f"Sentence number {i} of the text, long enough to be dense." for i in range(6))
    for attrs in ('style="overflow:hidden"', 'title="The hidden cost"', 'data-hidden="false"', "data-class='nav'", "data-x=id=menu",
                  'class="text" class="nav"', 'aria-hidden="false"', "style = 'a' data-id = menu"):
        assert html_text.extract(f"<body><div {attrs}>{body}</div>") == want, attrs
    linked = body.replace("number 3", '<a href="/x?id=search">number 3</a>')
    assert html_text.extract(f"<body><div>{linked}</div>") == want
    for attrs in ("hidden", "data-x='1'hidden", "HIDDEN=''", "id = menu", 'class="top nav"', "role=search", "aria-hidden='true'"):
        assert html_text.extract(f"<body><div>{body}</div><div {attrs}>{body}</div>") == want, attrs


def test_plain_divisions_and_broken_markup():
    body = "".join(f"<p>Sentence number {i} of the text, long enough to be dense.</p>" for i in range(6))
    page = f"<body><div class='menu'><a href=a>A</a> <a href=b>B</a></div><div class='content'>{body}</div><div class='footer'>Foot</div>"
    assert html_text.extract(page) == " ".join(f"Sentence number {i} of the text, long enough to be dense." for i in range(6))
    for broken in ("", "<", "<p", "text only", "<p>a<p>b</div></p>", "<script>", "<!--", "<a href='", "&bogus; &#x41;", "<b><i>x</b></i>"):
        assert isinstance(html_text.extract(broken), str)
    assert html_text.extract("text only") == "text only"
    assert html_text.extract("<p>a<p>b") == "a b"


def test_given_pages_keep_their_article(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    import html

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)
        want = " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)>", " ", inner.group(1)).replace("<b>", "").replace("</b>", "")).split())
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_awkward_pages(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<p>x</p>", None), (2, "u", "<p>x</p>", None),
                                (3, "u", "<div>" * 5000 + "deep", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract_pages(df).collect()) == ["", "", "deep", "x", "x"]
    assert html_text.extract_pages(df.where("1 = 0")).count() == 0


FRAMES = ['<div class="content-sidebar-wrap">%s</div>', '<div class="with-sidebar">%s</div>', '<div class="has-related">%s</div>',
          '<div class="entry share-enabled">%s</div>', '<div class="ad-free story">%s</div>', '<div class="post public-notice">%s</div>',
          '<div id="search-results-article">%s</div>', '<form action="/x">%s</form>']


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_frames_with_telling_names_keep_their_article(frame, tag):
    body = "Some plain text of the story. " * 10
    name = "entry-header" if tag == "article" else "entry-title"  # the heading of an article stays whatever its frame is called
    story = f"<{tag}><div class='{name}'><h1>Title here</h1></div><p>{body}</p><p>More of it, <b>bold</b> words</p></{tag}>"
    page = ("<html><body><nav><a href=/>Home</a></nav>" + frame % story + "<div class='comments'><p>first comment</p></div>"
            "<div class='site-footer'>Foot words</div></body></html>")
    assert html_text.extract(page) == f"Title here {body}More of it, bold words"


def test_density_finds_the_article_without_its_tag(sf):


    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet", columns=["html"])["html"].to_pylist()
    for page in pages:
        assert html_text.extract(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)) == html_text.extract(page)
