"""Feature queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.operators import features as X
from faultlens.operators.sizing import settle
from faultlens.plans import stand_ins as S
from faultlens.plans.registry import cte, query, r6, table

MIN_DF, MAX_FEATURES, NGRAM_MAX = 2, 1000, 2
LETTERS = "aeioust"

TOKENS_SQL = r"regexp_extract_all(lower(processed_text), '\b\w\w+\b')"
GRAMS_SQL = (
    "list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)),"
    " lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)"
)
cte("doc_terms", f"SELECT id, {GRAMS_SQL} AS terms FROM (SELECT id, {TOKENS_SQL} AS t FROM prepared)")
cte("term_rows", "SELECT id, unnest(terms) AS term FROM doc_terms")
cte("term_stats", "SELECT term, count(DISTINCT id) AS doc_freq, count(*) AS total FROM term_rows GROUP BY 1")
cte(
    "chosen_terms",
    f"SELECT * FROM term_stats WHERE doc_freq >= {MIN_DF} ORDER BY total DESC, term LIMIT {MAX_FEATURES}",
)
cte(
    "term_weights",
    "SELECT term, doc_freq, ln((1.0 + (SELECT count(*) FROM doc_labels))::DOUBLE / (1.0 + doc_freq)::DOUBLE) + 1.0 AS idf FROM chosen_terms",
)
cte(
    "raw_weights",
    "SELECT id, term, count(*) * any_value(idf) AS w FROM term_rows JOIN term_weights USING (term) GROUP BY id, term",
)
cte("unit_weights", "SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw_weights")


def with_terms(spark, folder):
    return X.with_terms(S.cleaned_documents(spark, folder), high=NGRAM_MAX).select("id", "terms")


def weights(terms):
    chosen = X.vocabulary(X.term_stats(terms), MIN_DF, MAX_FEATURES)
    return X.idf(chosen, terms.count())


@query("word_tokens", f"SELECT id, array_to_string({TOKENS_SQL}, '|') AS tokens FROM prepared")
def word_tokens(spark, folder):
    docs = S.cleaned_documents(spark, folder)
    return docs.select("id", F.array_join(T.word_tokens(F.col("processed_text")), "|").alias("tokens"))


@query("ngrams", "SELECT id, array_to_string(terms, '|') AS terms FROM doc_terms")
def ngrams(spark, folder):
    return with_terms(spark, folder).select("id", F.array_join("terms", "|").alias("terms"))


@query("term_stats", "SELECT term, doc_freq, total FROM term_stats")
def term_stats(spark, folder):
    return X.term_stats(with_terms(spark, folder))


@query("vocabulary", "SELECT term, doc_freq, total FROM chosen_terms")
def vocabulary(spark, folder):
    return X.vocabulary(X.term_stats(with_terms(spark, folder)), MIN_DF, MAX_FEATURES)


@query("term_index", f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM term_stats WHERE doc_freq >= {MIN_DF}")
def term_index(spark, folder):
    return X.indexed_vocabulary(X.vocabulary(X.term_stats(with_terms(spark, folder)), MIN_DF)).select("term", "term_idx")


@query("idf", f"SELECT term, doc_freq, {r6('idf')} AS idf FROM term_weights")
def idf(spark, folder):
    return weights(with_terms(spark, folder)).select("term", "doc_freq", F.expr(r6("idf")).alias("idf"))


@query("tfidf", f"SELECT id, term, {r6('weight')} AS weight FROM unit_weights")
def tfidf(spark, folder):
    terms = settle(with_terms(spark, folder))
    rows = X.tfidf(terms, settle(weights(terms)))
    return rows.withColumn("weight", F.expr(r6("weight")))


@query("tfidf_vectors", f"SELECT id, term, {r6('weight')} AS weight FROM unit_weights")
def tfidf_vectors(spark, folder):
    terms = settle(with_terms(spark, folder))
    vectors, names = X.tfidf_vectors(terms, weights(terms))
    cells = vectors.select("id", F.explode(F.arrays_zip("features.indices", "features.values")).alias("c"))
    return cells.select(
        "id", F.get(F.lit(names), F.col("c.indices")).alias("term"), F.expr(r6("c.values")).alias("weight")
    )


def letter_counts(texts: list[str]) -> np.ndarray:
    """A small encoder with the call shape of a sentence encoder: texts in, one vector each."""
    return np.array([[t.count(letter) for letter in LETTERS] for t in texts], dtype=np.float32)


@query(
    "embed",
    "SELECT doc_id, "
    + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::FLOAT AS e{i}" for i, c in enumerate(LETTERS))
    + " FROM documents",
)
def embed(spark, folder):
    vectors = X.embed(table(spark, folder, "documents").select("doc_id", "text"), lambda: letter_counts, "text")
    return vectors.select("doc_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(len(LETTERS))])


@query("fit_scaler", f"SELECT (d - 1)::INTEGER AS dim, {r6('m')} AS mean, {r6('s')} AS std FROM scale_stats")
def fit_scaler(spark, folder):
    stats = X.fit_scaler(S.embeddings(spark, folder))
    cells = stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "c"))
    return cells.select("dim", F.expr(r6("c.mean")).alias("mean"), F.expr(r6("c.std")).alias("std"))


@query("apply_scaler", f"SELECT id, (d - 1)::INTEGER AS dim, {r6('v::DOUBLE')} AS v FROM scaled_cells")
def apply_scaler(spark, folder):
    rows = S.embeddings(spark, folder)
    scaled = X.apply_scaler(rows, X.fit_scaler(rows))
    cells = scaled.select("id", F.posexplode("embedding").alias("dim", "v"))
    return cells.select("id", "dim", F.expr(r6("CAST(v AS DOUBLE)")).alias("v"))
