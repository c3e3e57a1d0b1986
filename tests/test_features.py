import math
import os
import uuid
from collections import Counter

import numpy as np
import pytest

from faultlens.operators import features as X


def docs(spark):
    rows = [(1, "cat dog"), (2, "dog dog fox"), (3, "")]
    return X.with_terms(spark.createDataFrame(rows, "id long, processed_text string"))


def test_tfidf_example(spark):
    two = docs(spark).filter("id < 3")
    weights = X.idf(X.vocabulary(X.term_stats(two)), 2)
    assert {r.term: round(r.idf, 7) for r in weights.collect()} == {"cat": 1.4054651, "dog": 1.0, "fox": 1.4054651}
    got = {(r.id, r.term): round(r.weight, 7) for r in X.tfidf(two, weights).collect()}
    assert got == {(1, "cat"): 0.8148025, (1, "dog"): 0.5797387, (2, "dog"): 0.8181802, (2, "fox"): 0.5749619}


def test_vocabulary_cuts(spark):
    stats = X.term_stats(docs(spark))
    assert {r.term: (r.doc_freq, r.total) for r in stats.collect()} == {"cat": (1, 1), "dog": (2, 3), "fox": (1, 1)}
    assert [r.term for r in X.vocabulary(stats, 1, 1).collect()] == ["dog"]
    assert [r.term for r in X.vocabulary(stats, 2).collect()] == ["dog"]
    assert [r.term for r in X.vocabulary(stats, 1, 2).collect()] == ["dog", "cat"]
    cuts = X.cut_vocabularies(docs(spark), 1, 1, (1, 2), (1, None))
    assert {k: v.count() for k, v in cuts.items()} == {(1, 1): 1, (1, None): 3, (2, 1): 1, (2, None): 1}


def test_all_forms_agree(spark):
    rows = docs(spark)
    weights = X.idf(X.vocabulary(X.term_stats(rows)), 3)
    long = {(r.id, r.term): r.weight for r in X.tfidf(rows, weights).collect()}
    vectors, names = X.tfidf_vectors(rows, weights)
    mine = {
        (r.id, names[i]): v for r in vectors.collect() for i, v in zip(r.features["indices"], r.features["values"])
    }
    ml, ml_names = X.tfidf_ml_vectors(rows, weights)
    theirs = {
        (r.id, ml_names[i]): v for r in ml.collect() for i, v in zip(r.features.indices.tolist(), r.features.values)
    }
    assert names == ml_names == sorted(names)
    for other in (mine, theirs):
        assert other.keys() == long.keys() and all(math.isclose(other[k], long[k]) for k in long)
    assert vectors.filter("id = 3").first().features["indices"] == []
    with pytest.raises(ValueError):
        X.tfidf_vectors(rows, weights, limit=1)
    assert {r.term: r.term_idx for r in X.indexed_vocabulary(weights).collect()} == {"cat": 0, "dog": 1, "fox": 2}


def test_scaler(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)).astype(np.float32)
    x[:, 2] = 4.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<float>")
    scaler = X.fit_scaler(df)
    row = scaler.first()
    assert np.allclose(row["mean"], x.astype(float).mean(0)) and np.allclose(row["std"], [*x.astype(float).std(0)[:2], 1.0])
    got = np.array([r.embedding for r in X.apply_scaler(df, scaler).orderBy("id").collect()])
    assert np.allclose(got, (x - row["mean"]) / row["std"], atol=1e-5)


def test_embed_uses_the_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, processed_text string")
    out = X.embed(df, lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert {r.id: r.embedding for r in out.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_encoder_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda ts: np.array([[os.getpid(), len(t), max(map(len, ts)) - min(map(len, ts))] for t in ts])

    texts = [(i, "x" * (i * 37 % 101)) for i in range(3000)]
    df = spark.createDataFrame(texts, "id long, processed_text string").repartition(24)
    for batch, rows in ((1, 100), (8, 100), (64, 1024), (5000, 7)):
        got = X.embed(df, load, batch=batch, rows=rows).collect()
        assert all(r.embedding[1] == len(r.processed_text) for r in got) and len(got) == 3000
        loads = [name.split("-")[0] for name in os.listdir(folder)]
        assert {int(r.embedding[0]) for r in got} <= set(map(int, loads))
        # One load for each worker and plan: four plans so far at most.
        assert max(Counter(loads).values()) <= 4
        assert batch > 1 or all(r.embedding[2] == 0 for r in got)
    assert X.embed(df.limit(0), load).count() == 0


def test_batches_of_like_length():
    seen = []

    def encoder(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t)] for t in texts])

    texts = ["aaa", "", "a", "aaaa", "aa"]
    assert X.by_length(encoder, texts, 2)[:, 0].tolist() == [3, 0, 1, 4, 2] and seen == [[0, 1], [2, 3], [4]]
