import re
from html.parser import HTMLParser

import numpy as np
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.operators import lemmas as C


def apply(spark, texts, run):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(run(F.col("t")), "i").orderBy("i").collect()]


def test_cleaning(spark):
    texts = ["fixNullPointerInXMLParser2", "Detailed Problem Description: : Don't use A/B", "HelloWorld ABc", ""]
    spaced = apply(spark, texts, lambda c: T.decamelcase(T.strip_template(c)))
    assert spaced == ["fix Null Pointer In XML Parser2", "Don't use A/B", "Hello World A Bc", ""]
    assert apply(spark, spaced, T.clean_text) == ["fix null pointer in xml parser", "dont use ab", "hello world a bc", ""]
    both = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "x string, y string")
    assert [r[0] for r in both.select(T.combine_text(F.col("x"), F.col("y"))).collect()] == ["a ", " b", " "]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aB cDeFé1.\n Z", max_size=25), min_size=1, max_size=120))
def test_against_plain_python(spark, texts):
    def spaced(t):
        # one blank before each capital that ends a lower-case run or, past the start, begins one
        marks = [
            i for i, c in enumerate(t)
            if "A" <= c <= "Z" and ((i and "a" <= t[i - 1] <= "z") or (i and i + 1 < len(t) and "a" <= t[i + 1] <= "z"))
        ]
        return "".join((" " if i in marks else "") + c for i, c in enumerate(t))

    assert apply(spark, texts, T.decamelcase) == [spaced(t) for t in texts]
    cleaned = apply(spark, texts, T.clean_text)
    assert cleaned == [" ".join(re.sub(r"[^a-z\s]", "", t.lower()).split()) for t in texts]
    assert apply(spark, cleaned, T.clean_text) == cleaned


def test_tokens(spark):
    assert apply(spark, ["the cat is at the mat"], lambda c: T.remove_stopwords(T.tokenize(c)))[0] == ["cat", "mat"]
    assert apply(spark, ["A bc d, Éf ghi_j"], T.word_tokens)[0] == ["bc", "éf", "ghi_j"]
    grams = apply(spark, ["aa bb cc", "aa", ""], lambda c: T.ngrams(T.word_tokens(c), 1, 3))
    assert grams == [["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"], ["aa"], []]


class Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts, self.open = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.parts.append([])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.parts.append([])

    def handle_comment(self, data):
        self.parts.append([])

    def handle_data(self, data):
        if not self.skip:
            if not self.parts:
                self.parts.append([])
            self.parts[-1].append(data)


def test_html_against_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for row in pages.select("html", T.html_to_text(F.col("html")).alias("text")).collect():
        parser = Nodes()
        parser.feed(row.html)
        parser.close()
        nodes = ["".join(p).strip() for p in parser.parts]
        assert row.text == "\n".join(n for n in nodes if n)


def test_html_details(spark):
    pages = [
        "<p title='a>b'>x</p><script>bad()</script>y<!-- c --> z &amp;lt; &#233;&#x20AC;&eacute; &nope; &nbsp;",
        "a<br>b & c < d",
        "",
    ]
    assert apply(spark, pages, T.html_to_text) == ["x\ny\nz &lt; é€é &nope;", "a\nb & c < d", ""]


def parsed(page):
    parser = Nodes()
    parser.feed(page)
    parser.close()
    nodes = ["".join(p).strip() for p in parser.parts]
    return "\n".join(n for n in nodes if n)


def test_broken_script_and_style_against_parser(spark):
    """Open, self-closing and oddly written script and style elements, mixed with text and tags."""
    pieces = ["a", " b c ", "<p>", "</p>", "<b class='x>y'>", "<script>var x = 1;</script>", "<SCRIPT type=\"a>b\">if (a < b) {}</Script >"]
    pieces += ["<script src='z'/>", "<style>p > a {}</style\n>", "<script>x</scripty>y</script>", "<script-box>", "<styles>"]
    rng = np.random.default_rng(3)
    pages = ["".join(rng.choice(pieces, rng.integers(1, 9))) + str(end) for _ in range(60) for end in ("", "<script>var x = 1;", "<style>p {}<p>q</p>")]
    assert apply(spark, pages, T.html_to_text) == [parsed(page) for page in pages]
    many = "z" + "<script>" * 200_000  # one open element, read once
    assert apply(spark, [many], T.html_to_text) == ["z"]


def test_lemmas(spark):
    words = ["cats", "cat", "boxes", "box", "flies", "fly", "glass", "wolves", "wolf", "men", "man", "xyzs"]
    lexicon = spark.createDataFrame([(w,) for w in words if w != "men"], "word string")
    forms = spark.createDataFrame([(w,) for w in words], "word string")
    table = C.noun_lemma_table(forms, lexicon)
    assert dict((r.form, r.lemma) for r in table.collect()) == {
        "cats": "cat", "boxes": "box", "flies": "fly", "wolves": "wolf", "men": "man",
    }
    rows = spark.createDataFrame(
        [(1, ["cats", "fly", "cats", "men"]), (2, []), (3, ["zzz"])], "id long, tokens array<string>"
    )
    want = {1: ["cat", "fly", "cat", "man"], 2: [], 3: ["zzz"]}
    assert sorted(r.word for r in C.distinct_words(rows).collect()) == ["cats", "fly", "men", "zzz"]
    for limits in ({}, {"limit": 1}, {"limit": 1, "broadcast_rows": 0, "hot_rows": 1}):
        assert {r.id: r.tokens for r in C.lemmatize(rows, table, **limits).collect()} == want


def test_full_preparation(spark):
    lemmas = spark.createDataFrame([("parsers", "parser")], "form string, lemma string")
    rows = spark.createDataFrame([(1, "Available workarounds: : theXMLParsers don't work"), (2, None)], "id long, text_input string")
    got = {r.id: r.processed_text for r in C.preprocess_text(rows, lemmas).collect()}
    assert got == {1: "xml parser dont work", 2: ""}
