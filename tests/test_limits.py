"""Both sides of every limit give the same rows, with nulls, repeated keys and repeated rows."""

import html

import pytest
from faultlens.functions import text as T
from faultlens.operators import labels as B
from faultlens.operators import lemmas as C
from faultlens.operators import sizing as Z
from faultlens.operators import split as D
from pyspark.sql import functions as F

LISTS = [(1, ["a", "b", "a"]), (1, ["b", "c"]), (2, []), (3, None), (4, ["c", None, "a"]), (4, ["c", None, "a"]), (None, ["b"])]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTS, "id long, label_list array<string>")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_keep_listed_labels(spark, lists):
    keep = spark.createDataFrame([("a",), ("c",)], "label string")
    held, joined = (rows(B.keep_listed_labels(lists, keep, "label_list", limit=n)) for n in (100, 0))
    assert held == joined and len(held) == len(LISTS)


def test_lemmatize(spark, lists):
    lemmas = spark.createDataFrame([("a", "y"), ("a", "x"), ("c", "z"), (None, "q")], "form string, lemma string")
    sent, joined = (rows(C.lemmatize(lists, lemmas, "label_list", limit=n)) for n in (100, 0))
    assert sent == joined and ("3", "None") in sent and ("1", "['x', 'b', 'x']") in sent


def test_vocabulary_and_binarize(lists):
    held, placed = (D.label_vocabulary(lists, limit=n) for n in (100, 0))
    assert rows(held) == rows(placed)
    wide = [rows(D.binarize(lists, held, limit=n)) for n in (100, 0)]
    assert wide[0] == wide[1]


def test_joins(spark):
    facts = spark.createDataFrame([(i % 3 if i < 90 else None, i) for i in range(100)], "k long, v long")
    table = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "k long, name string")
    for how in ("inner", "left"):
        results = [
            rows(Z.lookup_join(facts, table, "k", how)),
            rows(Z.lookup_join(facts, table, "k", how, broadcast_rows=0)),
            rows(Z.lookup_join(facts, table, "k", how, broadcast_rows=0, hot_rows=4)),
            rows(facts.join(table, "k", how)),
        ]
        assert all(r == results[-1] for r in results)


def test_sent_tables_are_measured(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 50, "v string")
    assert Z.may_be_sent(wide) and not Z.may_be_sent(wide, size=10_000) and not Z.may_be_sent(wide, rows=10)


REFERENCES = [
    "&#00000038;", "&#x0000026;", "&#9999999;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFF;", "&#xD800;", "&#0;", "&#13;", "&#128;", "&#159;", "&#x1F600;",
    "&apos;", "&apos", "&amp", "&ampx;", "&notit;", "&notin;", "&copy2020", "&CounterClockwiseContourIntegral;", "&nbsp", "&#;", "&#x;", "&;", "& b", "&bogus;", "&&amp;&",
    "&fjlig;", "&#65278;", "&#xFDD0;", "&#11;", "&am", "&lt;p&gt;", "a&#65b", "&#x41g",
]


def test_references_as_in_the_standard(spark):
    df = spark.createDataFrame([(r,) for r in REFERENCES], "v string")
    got = {r.v: r.d for r in df.select("v", T.decode_entities(F.col("v")).alias("d")).collect()}
    assert got == {r: html.unescape(r) for r in REFERENCES}


@pytest.mark.parametrize("size", [100, 2_000, 50_000, 1_000_000])
def test_long_tags(spark, size):
    pages = [f"<a href={'x' * size}>in", f"<a {'y ' * (size // 2)}", f"<a t='{'q' * size}'>in", "<" * min(size, 20_000), f"<a {'<b ' * min(size // 3, 5_000)}"]
    df = spark.createDataFrame([(p,) for p in pages], "v string")
    got = [r[0] for r in df.select(T.html_to_text(F.col("v"))).collect()]
    assert got[0] == got[2] == "in" and len(got) == 5
