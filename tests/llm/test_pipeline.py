"""The corpus pipeline: every stage on its own input, and the whole run."""

import hashlib

import corpus_pipeline
import pytest
from faultlens.llm import catalog
from pyspark.sql import functions as F

from .conftest import SMALL
from .test_documents import plain_kept, plain_lines


def test_stages(spark, documents):
    docs, kept = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        assert docs.count() <= kept
        kept = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert set(last) == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest() for k, r in last.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(texts)


def test_dedup_stages_equal_plain(spark, documents):
    """Both deduplicating stages on what the stage before kept, against all pairs and plain line windows."""
    docs = corpus_pipeline.language(spark, documents, SMALL).cache()
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    lines = corpus_pipeline.lines(spark, docs, SMALL).cache()
    assert sorted(rows(lines)) == sorted((k, t) for k, t, _ in plain_lines(rows(docs)))
    left = corpus_pipeline.near_duplicates(spark, lines, SMALL)
    assert sorted(k for k, _ in rows(left)) == plain_kept(rows(lines)) and set(rows(left)) <= set(rows(lines))


def test_clean_documents_stay(spark, documents):
    first = corpus_pipeline.language(spark, documents, SMALL)
    letters = documents.filter(F.col("text").rlike(r"\p{L}"))
    assert first.count() >= 0.99 * letters.count()


@pytest.mark.parametrize("k", range(5))
def test_stage_with_odd_rows(spark, odd, none, k):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(columns), none.select(columns)):
        out = corpus_pipeline.STAGES[k][1](spark, docs, SMALL)
        assert out.count() <= docs.count()
        assert k == 4 or out.columns == columns


def test_queries_registered():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
