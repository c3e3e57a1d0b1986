"""Work in pieces of bounded size gives the rows of the whole, and texts are not written or sent on the way."""

import pyarrow as pa
import pytest
from faultlens.operators import augment as E
from faultlens.operators import batches as P
from faultlens.operators import features as X
from faultlens.operators import lemmas as C
from faultlens.operators import linear as L
from faultlens.operators import search as H
from faultlens.operators import sizing as Z
from pyspark.sql import functions as F

TEXTS = [(1, "cat dog dog"), (1, "cat dog dog"), (None, "fox cat"), (2, ""), (3, None), (4, "dog fox cat bird")]


def rows(df):
    return sorted(str(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, processed_text string")


def test_slices_cut_no_list():
    lists = pa.array([["a", "b"], None, [], ["c"] * 5, ["d"]])
    assert list(P.list_slices(lists, 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(P.list_slices(lists, 100)) == [(0, 5)]


def test_term_counts_in_pieces(docs):
    """Counted in the task: the plan makes no row for each (row, term)."""
    terms = X.with_terms(docs, high=2).withColumn("fold", F.col("id") % 2)
    for by in ([], ["fold"]):
        whole, cut = (X.term_stats(terms, by=by, at_once=n) for n in (1000, 1))
        assert rows(whole) == rows(cut) and whole.columns == ["term", *by, "doc_freq", "total"]
        assert "Generate" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.doc_freq, r.total) for r in X.term_stats(X.with_terms(docs)).collect()} == {("cat", 4, 4), ("dog", 3, 5), ("fox", 2, 2), ("bird", 1, 1)}


def test_long_form_in_blocks(docs, monkeypatch):
    terms = X.with_terms(docs)
    weights = X.idf(X.vocabulary(X.term_stats(terms), 2), len(TEXTS))
    shown = lambda df: sorted((str(r.id), r.term, round(r.weight, 9)) for r in df.collect())
    sent = shown(X.tfidf(terms, weights))
    written = []
    monkeypatch.setattr(X, "settle", lambda df: written.append(df.columns) or Z.settle(df))
    assert shown(X.tfidf(terms, weights, limit=0)) == shown(X._long_tfidf(terms, weights, "id", "terms", 1)) == sent
    assert all("processed_text" not in columns and "term" not in columns for columns in written)


def test_lemmas_write_no_raw_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "settle", lambda df: written.append(df.columns) or Z.settle(df))
    df = spark.createDataFrame([(1, "two cats"), (2, "one cat"), (3, None)], "id long, text_input string")
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    out = C.preprocess_text(df, lambda _: lemmas, keep=["id"])
    assert out.columns == ["id", "processed_text"] and {r.id: r.processed_text for r in out.collect()}[1].endswith("cat")
    assert written and all("text_input" not in columns for columns in written)


def test_only_drawn_words_are_joined(spark, monkeypatch):
    kinds = "id long, replica int, processed_text string"
    texts = [(1, 1, "cat dog dog"), (1, 1, "fox cat"), (None, 1, "fox cat bird"), (None, 2, "fox cat bird"), (2, 1, ""), (3, 1, None), (4, 1, "solo")]
    copies = spark.createDataFrame(texts, kinds)
    pairs = [(w, s) for w in ("cat", "dog", "fox") for s in (w + "_q", w + "r", "z")]
    table = E.synonyms(spark.createDataFrame(pairs, "word string, synonym string"))
    sent = rows(E.synonym_replacement(copies, table))
    written = []
    keep = lambda df: written.append(df.columns) or Z_settle(df)
    Z_settle = Z.settle
    monkeypatch.setattr(Z, "settle", keep)
    monkeypatch.setattr(E, "settle", keep)
    monkeypatch.setattr(E, "may_be_sent", lambda *_: False)
    assert rows(E.synonym_replacement(copies, table)) == sent
    assert written and all("processed_text" not in columns for columns in written)


def test_folds_share_passes(spark, monkeypatch):
    """One fit for all folds, with the results of a fit for each."""
    words = ["cat", "dog", "fox", "bird", "cow"]
    made = [(i, " ".join(words[(i * k + k) % 5] for k in range(1, 5)), [int(i % 2 == 0), int(i % 3 == 0)], (i * 7) % 3) for i in range(60)]
    df = spark.createDataFrame(made, "id long, processed_text string, y array<int>, fold int")
    candidates = H.expand_grid({"max_features": [3, None], "ngram_max": [1], "min_df": [1], "C": [0.1, 1.0], "penalty": ["l2"]})
    calls, fit = [], L.fit_linear
    monkeypatch.setattr(L, "fit_linear", lambda *a, **k: calls.append(1) or fit(*a, **k))
    together = {(r.candidate, r.fold): r.map for r in H.cross_validate_text(df, candidates, 2).collect()}
    assert len(calls) == 2 and len(together) == 12
    for fold in range(3):
        tokens = X.with_terms(df)
        seen = tokens.filter(F.col("fold") != fold)
        vectors, names = X.tfidf_vectors(tokens, X.idf(X.vocabulary(X.term_stats(seen), 1, 3), seen.count()))
        alone = H._fit_and_score(vectors, {0: candidates[0]}, [fold], 2, len(names), 200, "logistic", True)[0].first()
        assert abs(together[0, fold] - alone.map) < 1e-6
