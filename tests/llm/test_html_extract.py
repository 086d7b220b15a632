import math
import random
import time

import numpy as np
import pytest

from barquality.llm.html_extract import clustered, extract, main_text, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, click to accept all of them now.</div>
<div id="sidebar"><p>Another long paragraph in the side bar that reads like text, and more of it.</p></div>
<article><h1>Title &amp; more</h1><div class="ad">Buy &copy; now</div><p>First   <b>bold</b> paragraph,
over two lines&nbsp;and &#233;t&eacute;.<p>Short.</p><ul><li>one</li><li>two</li></ul><form><label>Mail</label><input></form>
<blockquote>Quoted.</blockquote><aside>Related</aside></article>
<section id="comments"><div class="comment"><p>I liked this very much, thank you for it all.</p></div></section>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE)[0] == "Title & more\n\nFirst bold paragraph, over two lines and été.\n\nShort.\n\none\n\ntwo\n\nQuoted."


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<html></html>", ""),
        ("plain", "plain"),
        ("<p>a &lt; b &amp;&amp; c", "a < b && c"),
        ("<p>one<br>two</p>three", "one two\n\nthree"),
        ("</div></p><p>stray ends</p></article>", "stray ends"),
        ("<div class='ad'>buy<article><p>real text</p>", "real text"),
        ("<nav><ul><li>x<article><p>real text</p></article>", "real text"),
        ("<article><section class='comments'><article class='comment'>reader</article></section><p>text of it</p></article>", "text of it"),
        ("<script>if (a < b) { x('<p>') }", ""),
        ("<body><div><p>" + "word " * 50 + "</p><p>tail</p></div></body>", ("word " * 50).strip() + "\n\ntail"),
    ],
)
def test_broken_and_small_pages(html, text):
    assert main_text(html)[0] == text


def test_generated_articles_come_back_whole(spark):
    blocks = [["Heading", "a" * 400, "b.", "c " * 100], ["Only"], ["x"] * 30]
    rows = [(i, "u", "<nav><a>m</a></nav><article>" + "".join(f"<p>{b}</p>" for b in bs) + "</article><footer>f</footer>", "text") for i, bs in enumerate(blocks)]
    rows += [(8, None, None, None), (8, None, None, None), (9, "u", "<p>" + "y" * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in extract(pages).collect()}
    for i, bs in enumerate(blocks):
        assert out[i]["text"] == "\n\n".join(b.strip() for b in bs)
    assert out[8]["text"] == "" and out[8]["n_chars"] == 0 and out[9]["n_chars"] == 300_000
    assert extract(pages.limit(0)).count() == 0


def test_smoothing_keeps_constants_and_mass_centre():
    assert np.allclose(smooth(np.full(7, 3.0), 1.0, 2), 3.0)
    peak = smooth(np.array([0, 0, 0, 9.0, 0, 0, 0]), 1.0, 2)
    assert peak.argmax() == 3 and peak[2] == pytest.approx(peak[4])


def plain_clusters(lines, sigma, radius):
    """Ratio, kernel and threshold from their definitions, one line at a time."""
    ratio = [len(t) / max(n, 1) for t, n in lines]
    out = []
    for i in range(len(ratio)):
        near = range(max(0, i - radius), min(len(ratio), i + radius + 1))
        weight = [math.exp(-((j - i) ** 2) / (2 * sigma**2)) for j in near]
        out.append(sum(w * ratio[j] for w, j in zip(weight, near)) / sum(weight))
    mean = sum(out) / len(out)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in out) / len(out))
    return [x >= deviation for x in out]


def test_clusters_match_their_definition():
    rng = random.Random(3)
    for _ in range(50):
        lines = [("x" * rng.randint(1, 400), rng.randint(0, 9)) for _ in range(rng.randint(1, 30))]
        assert clustered(lines, 1.0, 2).tolist() == plain_clusters(lines, 1.0, 2)


LONG = "A sentence of the story that goes on for a while, with words enough. " * 5
UNMARKED = f"<body><div><a>Home</a></div><div><a>News</a></div><div><a>Shop</a></div><div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div></div><div><a>Terms</a></div><div><a>About</a></div></body>"


def test_clusters_select_the_region():
    want = f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nShort."
    assert main_text(UNMARKED)[0] == want
    everything = lambda lines, sigma, radius: np.ones(len(lines), bool)
    nothing = lambda lines, sigma, radius: np.zeros(len(lines), bool)
    assert main_text(UNMARKED, cluster=everything)[0].startswith("Home")
    assert main_text(UNMARKED, cluster=nothing)[0] == "" and main_text(PAGE, cluster=nothing)[0] == ""


def test_sibling_articles_and_text_beside_them():
    two = f"<main><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article></main>"
    assert main_text(two)[1] == 3
    beside = f"<main><p>{LONG}</p><article><p>{LONG}</p></article></main>"
    assert main_text(beside)[1] == 2
    teaser = f"<article><p>{LONG * 3}</p><p>{LONG * 3}</p></article><div class='related'><article><p>Read this too.</p></article></div>"
    assert main_text(teaser)[1] == 2


def test_work_is_constant_per_tag():
    start = time.perf_counter()
    assert main_text("<div>" * 100_000 + "deep" + "</span></p></section>" * 30_000)[0] == "deep"
    assert main_text("<article>" * 50_000 + "deep")[0] == "deep"
    assert time.perf_counter() - start < 8


@pytest.mark.parametrize("end", ["", ">", "<p>after this the page goes on with text</p>"])
@pytest.mark.parametrize("piece", ['<a href="', "<a b='", "<!--", "</a ", "<!doctype ", "<?x ", "<![", "<![CDATA[", "&#", "<", "</", '<a href=">', "<script>", '<b><a href="', '<a b=c"', "<![if x]>", "<!x>"])
def test_broken_markup_of_great_length_costs_no_more_than_its_length(piece, end):
    started = time.process_time()
    text = main_text("<p>hello world, here is some text</p>" + piece * (500_000 // len(piece)) + end)[0]
    assert time.process_time() - started < 5 and text.startswith("hello world")


def test_broken_tags_leave_the_rest_of_the_page():
    got = main_text('<article><p>first paragraph of the text, long enough to be content</p>' + '<a href="x' * 3 + "<p>second paragraph of the text &amp; more of it, also long enough</p></article>")[0]
    assert got.startswith("first paragraph") and "second paragraph of the text & more" in got
    assert main_text("<![bad]><p>some text that is the content of the page</p><![CDATA[x > y]]>")[0] == "some text that is the content of the page"


def test_a_short_second_article_stays_and_a_related_one_goes():
    long, short = "long text of the first article, " * 40, "short text of the second article, a few words only"
    page = f"<body><main><article><p>{long}</p></article><article><p>{short}</p></article></main><article class='related'><p>{'another story that is told elsewhere, ' * 5}</p></article></body>"
    got = main_text(page)[0]
    assert short in got and "elsewhere" not in got
