import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.functions import ranking as R
from faultlens.operators import evaluate as G

SCHEMA = "id long, scores array<double>, y array<int>"
EXAMPLE = [(1, [0.9, 0.8, 0.1], [1, 0, 1]), (2, [0.7, 0.2, 0.3], [0, 1, 0]), (3, [0.5, 0.4, 0.3], [0, 0, 0])]


def test_example(spark):
    df = spark.createDataFrame(EXAMPLE, SCHEMA)
    got = G.ranking_metrics(df, ks=(1, 3, 5)).first().asDict()
    want = {
        "Recall@1": 0.25, "Recall@3": 1.0, "Recall@5": 1.0,
        "Precision@1": 1 / 3, "Precision@3": 1 / 3, "Precision@5": 0.2,
        "Top_1_Accuracy": 1 / 3, "Top_3_Accuracy": 2 / 3, "Top_5_Accuracy": 2 / 3,
        "MRR": 2 / 3, "MAP": 0.5833333333,
    }
    assert got == pytest.approx(want)
    ranked = df.withColumn("ranked", R.rank_labels(F.col("scores")))
    assert [r.ranked for r in ranked.orderBy("id").collect()] == [[0, 1, 2], [0, 2, 1], [0, 1, 2]]
    assert G.ranking_metrics(ranked, ks=(1, 3, 5)).first().asDict() == pytest.approx(want)


def brute(scores, y, k):
    order = [sorted(range(len(s)), key=lambda i: (-s[i], i)) for s in scores]
    rec, prec, top, rr, ap = [], [], [], [], []
    for o, t in zip(order, y):
        true = {i for i, v in enumerate(t) if v}
        hits = [r for r, i in enumerate(o, 1) if i in true]
        inside = sum(r <= k for r in hits)
        prec.append(inside / k)
        top.append(inside > 0)
        if true:
            rec.append(inside / len(true))
            rr.append(1 / hits[0])
            ap.append(sum((j + 1) / r for j, r in enumerate(hits)) / len(true))
    mean = lambda v: float(np.mean(v)) if v else 0.0
    return {f"Recall@{k}": mean(rec), f"Precision@{k}": mean(prec), f"Top_{k}_Accuracy": mean(top), "MRR": mean(rr), "MAP": mean(ap)}


def test_random_rows_with_ties(spark):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 4, size=(80, 7)).astype(float)
    y = (rng.random((80, 7)) < 0.2).astype(int)
    df = spark.createDataFrame([(i, s.tolist(), t.tolist()) for i, (s, t) in enumerate(zip(scores, y))], SCHEMA)
    for k in (1, 3, 10):
        want = brute(scores, y, k)
        assert G.ranking_metrics(df, ks=(k,)).first().asDict() == pytest.approx(want)
        ranked = df.withColumn("ranked", R.rank_labels(F.col("scores")))
        assert G.ranking_metrics(ranked.repartition(6), ks=(k,)).first().asDict() == pytest.approx(want)
    recalls = G.ranking_metrics(df, ks=(1, 2, 3, 5)).first()
    assert recalls["Recall@1"] <= recalls["Recall@2"] <= recalls["Recall@3"] <= recalls["Recall@5"]


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(1, [-1, 2, 0], [1, 0, 0])], "id long, ranked array<int>, y array<int>")
    got = G.ranking_metrics(df, ks=(0, 1, 2)).first()
    assert got["MRR"] == 0.5 and got["MAP"] == pytest.approx(1 / 3)
    assert got["Precision@0"] == 0.0 and got["Top_0_Accuracy"] == 0.0 and got["Top_2_Accuracy"] == 0.0
    none = G.ranking_metrics(spark.createDataFrame([], SCHEMA)).first().asDict()
    assert set(none.values()) == {0.0}
    unlabelled = G.ranking_metrics(spark.createDataFrame(EXAMPLE[2:], SCHEMA)).first().asDict()
    assert set(unlabelled.values()) == {0.0}


def test_report(spark):
    rng = np.random.default_rng(5)
    y, p = (rng.random((60, 4)) < 0.3).astype(int), (rng.random((60, 4)) < 0.3).astype(int)
    y[:, 3] = 0
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(y, p)], "y array<int>, predicted array<int>")
    rows = {r.label: r for r in G.classification_report(df, names=["a", "b", "c", "d"]).collect()}

    def prf(tp, pred, true):
        div = lambda a, b: a / b if b else 0.0
        return div(tp, pred), div(tp, true), div(2 * tp, pred + true)

    each = [prf((y[:, i] * p[:, i]).sum(), p[:, i].sum(), y[:, i].sum()) for i in range(4)]
    support = y.sum(0)
    want = dict(zip("abcd", each))
    want["micro avg"] = prf((y * p).sum(), p.sum(), y.sum())
    want["macro avg"] = tuple(np.mean(each, axis=0))
    want["weighted avg"] = tuple(np.average(each, axis=0, weights=support))
    want["samples avg"] = tuple(np.mean([prf((a * b).sum(), b.sum(), a.sum()) for a, b in zip(y, p)], axis=0))
    for label, values in want.items():
        r = rows[label]
        assert (r.precision, r.recall, r.f1) == pytest.approx(values)
    assert [rows[c].support for c in "abcd"] == support.tolist() and rows["micro avg"].support == support.sum()


REGISTRY = "model_key string, family string, feature_type string, variant string"


def test_benchmark_isolates_errors(spark):
    scored = [("good", *r) for r in EXAMPLE] + [("short", 1, [0.1], [1, 0]), ("hole", 1, [None, 0.2], [1, 0])]
    df = spark.createDataFrame(scored, "model string, " + SCHEMA)
    models = [(m, "f", "TFIDF", "OG") for m in ("good", "short", "hole", "gone")] + [("odd", "f", "other", "OG")]
    out = {r.model: r for r in G.benchmark(df, spark.createDataFrame(models, REGISTRY)).collect()}
    assert set(out) == {"good", "short", "hole", "gone"}
    assert out["good"].error is None and out["good"].MAP == pytest.approx(0.5833333)
    assert "1 rows" in out["short"].error and out["short"].MAP is None and out["hole"].error
    assert out["gone"].error == "no predictions"
    table = G.comparison_table(G.benchmark(df, spark.createDataFrame(models, REGISTRY)))
    assert table.columns == ["model", *G.SUMMARY_COLUMNS]
    assert {r.model: r.MAP for r in table.collect()}["good"] == 0.5833
    other = spark.createDataFrame([("m", 1.0)], "model string, score double")
    assert G.comparison_table(other).columns == ["model", "score"]


def test_compare_models(spark):
    df = spark.createDataFrame(EXAMPLE, SCHEMA)

    def broken():
        raise RuntimeError("no such file")

    boom = F.udf(lambda s: 1 / 0, "array<double>")
    makers = {"good": lambda: df, "broken": broken, "late": lambda: df.withColumn("scores", boom("scores"))}
    models = [(m, "f", "SBERT", "OG") for m in makers]
    out = {r.model: r for r in G.compare_models(makers, spark.createDataFrame(models, REGISTRY)).collect()}
    assert out["good"].error is None and out["good"].MRR == pytest.approx(2 / 3)
    assert out["broken"].error == "no such file" and out["late"].error and out["late"].MAP is None


def test_monitor(spark):
    df = spark.createDataFrame(EXAMPLE, SCHEMA)
    got = G.train_monitor(df).first().asDict()
    assert got["recall_at_1"] == 0.25 and got["top_3_accuracy"] == pytest.approx(2 / 3) and "MAP" in got
    bad = spark.createDataFrame([*EXAMPLE, (4, [0.1], [1, 0, 0])], SCHEMA)
    assert set(G.train_monitor(bad).first().asDict().values()) == {0.0}


def test_long_and_pivot(spark):
    df = spark.createDataFrame([("m", 0.5, 0.25)], "model string, MAP double, MRR double")
    long = G.long_metrics(df)
    assert sorted(tuple(r) for r in long.collect()) == [("m", "MAP", 0.5), ("m", "MRR", 0.25)]
    assert tuple(G.pivot_metrics(long, ["MAP", "MRR"]).first()) == ("m", 0.5, 0.25)
