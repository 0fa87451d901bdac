"""URL verdicts and main text of pages."""

import math

import pytest

from tidepanel.llm import density, urls

URLS = [
    (1, "HTTP://WWW.Example.NET/en/1?x=1#y"), (2, "https://blog.example.net/fr/"), (3, "http://a.example.com/de/9.html"), (4, "https://x.org/fr/1"), (5, None), (6, "no scheme/at/all"),
    (7, "http://"), (8, "http://cheap-pills.example.com/en/5"), (9, "http://quiet-garden.example.com/en/5"), (10, "http://notexample.net?q"), (11, "a://b://c/d"), (None, "http://net/x"),
    (1, "HTTP://WWW.Example.NET/en/1?x=1#y"), (12, "http://ÄXÄ.example.com/ÄB?#"), (13, "http://h.example.com/" + "p/" * 5000),
]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_model_by_brute_force(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in URLS], "page_id long, url string, host string, path string")
    weights, intercept = urls.train(urls.labelled_urls(spark))
    assert len(weights) == urls.BUCKETS
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == len(URLS)
    grams = {r["url"]: r["g"] for r in spark.createDataFrame([(u,) for _, u in URLS], "url string").select("url", urls.gram_buckets(*urls.host_and_path(F.col("url"))).alias("g")).collect()}
    found = {(r["page_id"], r["host"], r["path"]): r for r in rows}
    for page, url in URLS:
        host, path = cut(url)
        row = found[page, host, path]
        rule, verdict = rule_of(host, path)
        score = 1 / (1 + math.exp(-(intercept + sum(weights[b] for b in grams[url])))) if host or path else 0.0
        assert row["rule"] == rule and abs(row["score"] - score) < 1e-9
        assert row["verdict"] == (verdict or ("block" if score > 0.5 else "allow"))
    assert found[8, "cheap-pills.example.com", "/en/5"]["verdict"] == "block"
    assert found[9, "quiet-garden.example.com", "/en/5"]["verdict"] == "allow"
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_very_long_urls_take_linear_time(spark):
    import time

    rows = [(1, "https://example.com/" + "a1-é😀" * 200_000), (2, "https://" + "h.x" * 300_000 + "/p")]
    start = time.monotonic()
    found = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(found[1]["path"]) == 1_000_001 and len(found[2]["host"]) == 900_000
    assert time.monotonic() - start < 90


def test_model_separates_its_examples(spark):
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls.LABELLED)], "page_id long, url string")
    rows = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules=()).collect()}
    assert sum((rows[k] == "block") == bool(b) for k, (_, b) in enumerate(urls.LABELLED)) >= len(urls.LABELLED) - 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- note <p>hidden</p> -->
<div class="cookie-notice">We use cookies and more cookies than anyone ever asked for in a very long sentence.</div>
<div class="ad">Buy this now, it is so very cheap.</div><article><h1>The &amp; title</h1><p><b>First   line<br>second<p>Next&nbsp;one &lt;b&gt; &#233;
<ul><li>item<li>other</ul><form>Name <input></form><table><tr><td>a<td>b<tr><td>c</table><section class="comments"><p>A reader says a lot about nothing at all here.</p></section></article>
<aside>More to read</aside><footer>&copy; me &middot; imprint</footer></body></html>"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "The & title\nFirst line second\nNext one <b> é\nitem\nother\na b\nc"),
    (PAGE[:PAGE.index("<ul><li>item")], "The & title\nFirst line second\nNext one <b> é"),
    ("<article><p>Short.</p></article><footer>A footer that is much longer than the article itself is.</fo", "Short."),
    ("just text", "just text"), ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<p>a < b and c", "a < b and c"),
    ('<p title="never ends>some words</p><p>more', "some words\nmore"),
    ("<div><div><p>" + "deep <div>" * 3000 + "end", "deep\n" * 3000 + "end"),
    ("<main><header><h1>Head</h1></header><p>Body of the page.</main>", "Head\nBody of the page."),
    ("<p>x</p><script>if (a<b) {'<p>no</p>'}</script><p>y", "x\ny"),
])
def test_main_text(page, text):
    assert density.main_text(page) == text


@pytest.mark.parametrize("attributes, stays", [
    ('style="overflow:hidden"', True), ('title="Hidden costs"', True), ("title='a hidden gem'", True), ('href="/guides/hidden-gems"', True), ("href=/p?hidden", True),
    ('data-hidden="false"', True), ('data-id="share-7"', True), ('href="/p?id=related"', True), ('alt="class=menu"', True), ('aria-label = "role=menu id=nav"', True),
    ('class="text" class="menu"', True), ('title="', True), ("title", True), ("hidden", False), ("HIDDEN", False), ('hidden=""', False), ('title="x"hidden', False),
    ('aria-hidden = "true"', False), ('aria-hidden="false"', True), ('style="a"class="menu"', False), ("ID=related", False), ("role='Menu'", False),
])
def test_attributes_count_by_their_whole_name(attributes, stays):
    for tag in ("div", "span"):
        page = f"<p>before</p><{tag} {attributes}>inside</{tag}><p>behind</p>"
        assert density.main_text(page).split() == (["before", "inside", "behind"] if stays else ["before", "behind"])
    assert density.main_text("<p " + "a " * 200_000 + " " * 200_000 + "hidden>x</p><p>y") == "y"


LINES = ["The title of it", *(f"Paragraph {k} tells a bit more of the long story that this page is about." for k in range(6))]
BODY = "<h1>" + LINES[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in LINES[1:])
MENU = '<nav><a href="/">Start</a></nav><div class="menu"><a href="/a">One</a> <a href="/b">Two</a></div>'
SIDE = '<div class="sidebar"><p>Look at this and at that, and do not forget the other one.</p></div>'
COMMENTS = '<section class="comments"><h2>Comments</h2>' + "<p>I have so much to say about this that it is longer than the page itself.</p>" * 12 + "</section>"


@pytest.mark.parametrize("around", [
    '<div class="site has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="content with-nav">{}</div>', '<div id="share-page">{}</div>',
    '<form id="aspnetForm" action="/"><input name="state"><select><option>de</select>{}<button>Send</button></form>', '<div class="widget"><div role="form"><div id="social">{}</div></div></div>',
    '<p>Skip to content</p><div class="page no-banner">{}</div>', "<div>{}</div>",
])
@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div>{BODY}</div>", f'<main><div class="row with-nav"><article>{BODY}</article></div></main>'])
def test_wrappers_never_take_the_text_along(around, inner):
    for page in (around.format(MENU + inner + SIDE), MENU + around.format(inner) + SIDE, around.format(inner + COMMENTS), around.format(inner) + COMMENTS):
        assert density.main_text(f"<body>{page}<footer>Imprint</footer></body>").removeprefix("Skip to content\n") == "\n".join(LINES)


@pytest.mark.parametrize("page, text", [
    (f'<div>{BODY}</div><aside class="related"><article><p>Teaser of another page</p></article></aside>', LINES),
    (f'<article>{BODY}<aside><article><p>Teaser of another page</p></article></aside></article>', LINES),
    (f'<article>{BODY}</article><div class="related"><article><p>Teaser one</p></article><article><p>Teaser two</p></article></div>', LINES),
    (f'<div>{BODY}</div><ol class="comments"><li><article class="comment-body"><p>{"so much to say " * 60}</p></article></ol>', LINES),
    (f'<div class="with-nav"><article>{BODY}</article></div><div><article><p>Teaser</p></article></div>', LINES),
    (f'<div hidden><article>{BODY}</article></div><p>seen</p>', ["seen"]),
    ('<div class="menu"><a href="/">Start</a></div><nav>menu</nav><p>text</p>', ["text"]),
])
def test_marks_stay_beside_the_text(page, text):
    assert density.main_text(page) == "\n".join(text)


def test_marks_on_deep_pages_take_linear_time():
    page = '<div class="with-nav">' * 20_000 + "<p>end"
    assert density.main_text(page) == "end"
    assert density.main_text('<div class="with-nav"><article>a' * 5_000) == "a"


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, None, "", "x"), (3, "u", "<p>" + "word " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = density.extract_pages(pages).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert max(r["n_chars"] for r in found) == 5 * 200_000 - 1
    assert density.extract_pages(pages.limit(0)).collect() == []


def test_a_long_paragraph_with_markup_is_no_better_than_what_holds_it():
    long = "<p>" + " ".join(f"word{k}" + "<b>x</b>" * (k % 60 == 0) for k in range(280)) + "</p>"
    for tag in ("div", "article", "section"):
        found = density.main_text(f"<{tag}><h1>A heading</h1>{long}<p>A short closing paragraph.</p><p>One more here.</p></{tag}>").split("\n")
        assert len(found) == 4 and found[0] == "A heading" and found[2:] == ["A short closing paragraph.", "One more here."]


@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_parts_of_a_text_stay_together(tag):
    parts = "".join(f"<section><h2>Part {k}</h2>{BODY}</section>" for k in range(3))
    text = [line for k in range(3) for line in (f"Part {k}", *LINES)]
    links = "<div>" + "".join(f'<p><a href="/{k}">Another page {k}</a></p>' for k in range(9)) + "</div>"
    assert density.main_text(f"<body>{MENU}<{tag}><h1>Head</h1>{parts}</{tag}>{links}</body>") == "\n".join(["Head", *text])
    assert density.main_text(f"<body>{MENU}<div><{tag}><h1>Head</h1><div>{BODY}</div></{tag}>{links}</div></body>") == "\n".join(["Head", *LINES])


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_all_pages_give_their_article(spark, sf_dir, tag):
    """By the density: the same with another tag in the article's place."""
    import html
    import re

    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", f"$1{tag}>"))
    for row in density.extract_pages(renamed).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", source[row["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", "").replace("<br>", " "))
        assert row["text"] == "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))
