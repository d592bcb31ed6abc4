import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm.html_text import Page, best_run, extract, extract_pages, scores, train, weights

W = weights({})
PAGE = """<!DOCTYPE html><html><head><title>T words here</title><style>p{}</style><script>var t="</p>";x(1<2)</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a>About</a></li></ul></nav><div class="cookie-notice">We use cookies, really many of them, on this site</div>
<div class="ad">Buy now buy now buy now buy now</div><article><h1>The   title &amp; more</h1><p>First <b>bold</b>ness&nbsp;here<br>next line <p>Second &lt;tag&gt; &#233;<ul><li>item one here</li><li>item two</li></ul>
<form><label>Mail</label><input></form><aside>side words</aside></article><section id="comments"><p>Reader says hello to all of you here</p></section><footer>&copy; foot words</footer></body></html>"""


def test_article_and_nothing_else():
    assert extract(PAGE, W) == "The title & more\nFirst boldness here next line\nSecond <tag> é\nitem one here\nitem two"


def test_region_without_markup_of_its_own():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
    page = f"<html><body><div><ul>{links}</ul></div><div><p>{'word ' * 80}</p><p>{'more ' * 40}</p></div><div><ul>{links}</ul></div></body></html>"
    assert extract(page, W) == " ".join(["word"] * 80) + "\n" + " ".join(["more"] * 40)


def test_broken_pages():
    assert extract(None, W) == extract("", W) == extract("<p></p><!-- x", W) == ""
    assert extract("just text", W) == "just text"
    assert extract("<p>a < b and c > d</p>", W) == "a < b and c > d"
    assert extract("<article><p>open <b>never closed", W) == "open never closed"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdiv nav=\"'&;#a!-", max_size=80))
def test_never_fails(page):
    assert isinstance(extract(page, W), str)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = sorted(extract_pages(pages).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [1, 1, 2] and got[0].text == extract(PAGE, W) and got[0].n_chars == len(got[0].text) and got[2].text == ""
    assert extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("attributes, hidden", [("style='overflow:hidden'", False), ('aria-hidden="false"', False), ("data-x=hidden", False), ("hidden", True), ('id="a" HIDDEN=""', True), ("aria-hidden=true", True), ('style="color:red; display: none"', True)])
def test_only_hidden_elements_are_dropped(attributes, hidden):
    assert ("secret" not in extract(f"<article><div {attributes}>secret words</div><p>seen</p></article>", W)) == hidden


@pytest.mark.parametrize(
    "page",
    [
        '<div class="overflow-hidden"><article><p>{}</p></article></div>',
        '<article><p id="social-change">{}</p></article>',
        '<article><p title="the hidden valley">{}</p></article>',
        "<body><form action=x><nav><a>Home</a></nav><article><p>{}</p></article></form></body>",
        "<body><form action=x><div><p>{}</p></div></form></body>",
        '<div class="has-sidebar footer-fixed"><div class="sidebar">Some links here</div><article><p>{}</p></article></div>',
        '<body class="nav-open cookie-banner"><p>{}</p></body>',
        "<div><a href='/'>Home</a> <a href='/x'>Other</a></div><div><p>{}</p></div>",
        "<article><header><h1></h1></header><p>{}</p><div class='ad-slot'>Buy one now or two</div></article>",
        "<p title=O'Neil>{}</p>",
    ],
)
def test_what_names_or_holds_the_article_is_not_lost(page):
    text = " ".join(f"word{i}" for i in range(40))
    assert extract(page.format(text), W) == text


@pytest.mark.parametrize("out", ['<div class="ad">{}</div>', "<aside>{}</aside>", '<ul class="share-buttons"><li>{}</li></ul>', '<section id="comments"><article class="comment"><p>{}</p></article></section>', "<form>{}</form>", '<div role="navigation">{}</div>', '<div class="newsletter-signup">{}</div>', '<div class="cookieNotice">{}</div>', "<footer><p>{}</p></footer>", "<header>{}</header>"])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_what_is_not_the_article_goes(out, mark):
    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(15))
    inside = "" if "header" in out else out.format(other)  # an article's own header is the article's
    page = f"<body>{out.format(other)}<{mark}><p>{text}</p>{inside}<p>{text}</p></{mark}>{out.format(other)}</body>"
    assert extract(page, W) == text + "\n" + text


def test_weights_decide():
    """Flattened, with tags that cost nothing, the page is one region; with words that cost, none."""
    flat = {k: 1.0 if k.startswith(("word", "mark")) else -1e-9 for k in W}
    assert "Buy now" in extract(PAGE, flat) and "Reader says" in extract(PAGE, flat) and "Buy now" not in extract(PAGE, W)
    assert extract(PAGE, {k: -1.0 for k in W}) == ""


def test_marks_are_learned_from_labelled_pages(spark):
    word = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    rows = [(i, f"<div class='kolumne-x'>{word(12, 'out')}</div><article><div class='fliess'>{word(50, 'in')}</div></article>") for i in range(12)]
    model = train(spark.createDataFrame(rows, "page_id long, html string"))
    assert model["mark:kolumne"] < 0 < model["mark:fliess"]
    page = f"<div><div class='kolumne-y'>{word(20, 'side')}</div><p>{word(40, 'text')}</p><div class='kolumne-y'>{word(20, 'side')}</div></div>"
    assert extract(page, model) == word(40, "text") and "side" in extract(page, W)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_best_run_is_the_best_of_all(score):
    a, b = best_run([float(x) for x in score])
    best = max((sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)), default=0)
    assert sum(score[a:b]) == max(best, 0)


def test_region_of_a_page_is_the_best_of_all_regions():
    page = Page("<ul><li><a>Link one</a><li><a>Link two</a></ul><p>Some words that are text</p><ul><li><a>x</a></ul><p>more words here</p><div class=ad>buy</div>")
    score = scores(page, page.classes(W, False), W)
    a, b = best_run(score)
    assert sum(score[a:b]) == pytest.approx(max(sum(score[i:j]) for i in range(len(score)) for j in range(i, len(score) + 1)))


@pytest.mark.parametrize("piece", ['<a "', "<a ='", '<a x="', "<!a", "<svg>", "</", "<p>x", "<![CDATA[", "<a " + "x=1 " * 5, "<div class='a b'>"])
def test_long_broken_pages_take_linear_time(piece):
    start = time.time()
    extract(piece * (1_000_000 // len(piece)), W)
    extract(piece * (500_000 // len(piece)) + "<p>t</p>" + piece * 1000, W)
    assert time.time() - start < 15


def test_queries_pages_match_their_article(spark, sf):
    """Every page of the table: the text of its article, read another way."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        body = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S).group(1)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h\d|ul|li|div|table|tr|td|blockquote|pre)\b[^>]*>", body))
        assert r.text == "\n".join(x for x in lines if x)
