"""Top-k search and page text against plain code."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest
from faultlens.llm import catalog, nra, tag_paths
from pyspark.sql import functions as F

from .conftest import SMALL


def plain_top(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            best[i] = min(best.get(i, v), v)
    q = {i: np.floor(256 * np.array(v)) for i, v in best.items()}
    width = max((len(v) for v in q.values()), default=0)
    q = {i: np.pad(v, (0, width - len(v))) for i, v in q.items()}
    out = set()
    for i in q:
        if i % every == 0:
            found = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("shard", [7, 4096])
def test_top_k_equals_plain(spark, shard):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 6).round(1).tolist()) for i in range(150)]  # many equal scores
    rows += [(3, rows[3][1]), (200, None), (None, [1.0] * 6), (201, [1.0, None] * 3), (202, [float("nan")] * 6), (203, [0.5]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_id", F.lit(1))
    got = {tuple(r) for r in nra.top_k(df, F.col("vec_id") % 5 == 0, shard=shard, block=11).collect()}
    assert got == plain_top(rows, 5, 5)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nra.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert nra.top_k(df.limit(0), F.lit(True)).count() == nra.top_k(df.limit(1), F.lit(True)).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 0.2, (400, 8)))
    x[:5] += 2000  # clear winners: bounds part long before the lists end
    shard, q = nra.Shard(np.arange(400), x), np.full((1, 8), 50.0)
    (i, ids, score), = shard.search(np.array([399]), q, 5)
    assert i == 0 and set(ids) == set(range(5)) and (score == np.sort(x[:5] @ q[0])[::-1]).all()


def test_pages_of_the_tables(spark):
    for r in catalog.QUERIES["op9_tag_paths"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", body)).split("\0")
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("<p>a &amp b &#x41; &bogus; &nbsp;c", "a & b A &bogus; c"),
        ("<article><h1>T</h1><p>One,\n two.</p><div class='comments'><p>Nice, very nice, thanks.</p></div></article><footer>f, g.</footer>", "T\nOne, two."),
        ("<body><div id=cookie-banner><p>We, use, cookies. A lot.</p></div><h1>T</h1><p>One, two. three</p><p>four.</p><form><p>a, b.</p></form></body>", "T\nOne, two. three\nfour."),
        ("<script>var a = '</p>';</script><p>Text, yes.</p><style>p{}", "Text, yes."),
        ("<article><p>x<b>y</b>z<br>w, v.</p></article>", "xyz\nw, v."),
        ("<a title=\"x>y\">Text, here.</a>", "Text, here."),
        ("<nav><a>Menu, one. Menu, two.</a></nav>", ""),
    ],
)
def test_page(page, text):
    assert tag_paths.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content no-sidebar"><article><p>One, two.</p></article></div>', "One, two."),
        ('<div class="sidebar"><article><p>One, two.</p></article></div>', "One, two."),
        ('<div class="sidebar-left"><p>Link, link.</p></div><article><p>One, two.</p></article>', "One, two."),
        *[
            (f'<article><section><p>One, two, three.</p></section><section {name}><p>Four, five, six.</p></section></article>', "One, two, three.\nFour, five, six.")
            for name in ('id="discussion"', 'class="related-work"', 'class="side-effects"', 'class="social-policy"', 'class="menu-of-the-day"', 'class="foot-note"')
        ],
        ('<article><section><p>One, two, three.</p></section><section class="comments"><p>Four, five, six.</p></section></article>', "One, two, three."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math>, then.</p></article>", "Let x=2, then."),
    ],
)
def test_names_are_evidence(page, text):
    assert tag_paths.main_text(page) == text


ARTICLE = "<h1>T</h1><p>One, two. three, four and five.</p><p>More of it, and more.</p>"
LINES = "T\nOne, two. three, four and five.\nMore of it, and more."
NICE = "<div><p>Nice, very nice, thanks. I liked it, a lot.</p></div>"


@pytest.mark.parametrize("name", ['class="user-comments"', 'id="comments-thread-2"', 'id="respond"', 'class="google-ads top"', 'class="adsbygoogle"', 'class="post sponsored-links-2"'])
@pytest.mark.parametrize("tag", ["div", "section", "ul"])
def test_telling_names_in_longer_names(name, tag):
    part = f"<{tag} {name}>{NICE}</{tag}>"
    for page in (f"<article>{ARTICLE}{part}</article>", f"<body><div>{ARTICLE}</div>{part}</body>", f"<body><div>{ARTICLE}{part}</div></body>"):
        assert tag_paths.main_text(page) == LINES
    # More comments than article: the heading stands outside.
    assert tag_paths.main_text(f"<article>{ARTICLE}<{tag} {name}>{NICE * 20}</{tag}></article>") == LINES


@pytest.mark.parametrize("name", ['class="no-comments"', 'class="page-with-comments open"', 'class="post-comments-closed"', 'class="has-ads"', 'class="commentary"', 'class="ad-hoc"'])
def test_names_that_tell_nothing(name):
    assert tag_paths.main_text(f"<body><div {name}>{ARTICLE}</div><footer>f, g.</footer></body>") == LINES
    assert tag_paths.main_text(f"<article><h1>T</h1><p>One, two.</p><div {name}><p>Three, four.</p></div></article>") == "T\nOne, two.\nThree, four."
    code = '<article><h1>T</h1><p>One, two.</p><pre>x = 1 <span class="hljs-comment"># one, two</span></pre></article>'
    assert tag_paths.main_text(code) == "T\nOne, two.\nx = 1 # one, two"
    whole = f'<body><div class="wrap comments-thread-page">{ARTICLE}</div><p>c, d.</p></body>'
    assert tag_paths.main_text(whole).startswith(LINES)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x, y" + "</b>" * 50_000, '<a "' * 20_000, "<p>x, y<p>" * 20_000, "<!--" * 20_000, "<" * 50_000])
def test_long_pages(page):
    assert isinstance(tag_paths.main_text(page), str)


def test_pages_without_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", "<p>A, b.</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {tuple(r) for r in tag_paths.extract(df).collect()} == {(1, None, "", 0), (1, "u", "A, b.", 5)}
    assert tag_paths.extract(df.limit(0)).count() == 0
