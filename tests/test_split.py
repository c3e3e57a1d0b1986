import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import SMALL
from faultlens.operators import split as D
from faultlens.plans import stand_ins as S


def one_label(spark, n, label="a", start=0):
    return spark.range(start, start + n).select("id", F.array(F.lit(label)).alias("label_list"))


def counts(df):
    got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    return tuple(got.get(s, 0) for s in ("test", "val", "train"))


def test_stratum_sizes(spark):
    for n, want in ((1, (0, 0, 1)), (2, (0, 1, 1)), (5, (0, 1, 4)), (6, (1, 1, 4)), (10, (1, 2, 7)), (100, (10, 20, 70))):
        assert counts(D.stratified_split(one_label(spark, n))) == want


def test_small_strata_are_pooled(spark):
    df = one_label(spark, 3, "a").union(one_label(spark, 3, "b", 10)).union(one_label(spark, 20, "c", 20))
    assert counts(D.stratified_split(df)) == (3, 5, 18)


def test_split_is_complete_and_repeatable(spark):
    df = S.labelled_documents(spark, SMALL)
    first = {r.id: r.split for r in D.stratified_split(df).collect()}
    assert len(first) == df.count()
    for digits in (1, 2):
        again = D.stratified_split(df.repartition(7), hex_digits=digits)
        assert {r.id: r.split for r in again.collect()} == first
    assert {r.id: r.split for r in D.stratified_split(df, seed=7).collect()} != first


def test_buckets_equal_one_sort(spark):
    ids = sorted(range(500), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    want = {i: "test" if (n + 0.5) / 500 < 0.1 else "val" if (n + 0.5) / 500 < 0.3 else "train" for n, i in enumerate(ids)}
    assert {r.id: r.split for r in D.stratified_split(one_label(spark, 500)).collect()} == want


def test_rarest_label_paths_agree(spark):
    df = S.labelled_documents(spark, SMALL)
    short = {r.id: r.stratum for r in D.rarest_label(df).collect()}
    assert {r.id: r.stratum for r in D.rarest_label(df, limit=1).collect()} == short


def pair_errors(split_of, lists):
    """Greatest distance, over pairs, between a pair's rows in a split and its share of all its rows."""
    held = {}
    for i, labels in lists.items():
        for pair in {tuple(sorted((a, b))) for a in labels for b in labels}:
            held.setdefault(pair, []).append(split_of[i])
    shares = (("test", 0.1), ("val", 0.2), ("train", 0.7))
    return {p: max(abs(own.count(n) - s * len(own)) for n, s in shares) for p, own in held.items()}


def test_pairs_keep_their_shares(spark):
    rng = random.Random(3)
    names = [f"l{i}" for i in range(14)]
    lists = {i: sorted({rng.choice(names[: 2 + i % 13]) for _ in range(1 + i % 3)}) for i in range(3000)}
    df = spark.createDataFrame(list(lists.items()), "id long, label_list array<string>")
    got = {r.id: r.split for r in D.combination_split(df).collect()}
    assert got.keys() == lists.keys()
    sizes = [list(got.values()).count(s) / 3000 for s in ("test", "val", "train")]
    assert max(abs(a - b) for a, b in zip(sizes, (0.1, 0.2, 0.7))) < 0.01
    errors, held = pair_errors(got, lists), {}
    pairs = {i: {tuple(sorted((a, b))) for a in labels for b in labels} for i, labels in lists.items()}
    frequency = Counter(p for own in pairs.values() for p in own)
    for own in pairs.values():
        rarest = min(own, key=lambda p: (frequency[p], f"{len(p[0])}:{p[0]}{p[1]}"))
        for p in own:
            held.setdefault(p, []).append(p == rarest)
    # Own rows fill the quotas but for rounding; rows dealt out by other pairs of the same round vary like draws.
    for p, e in errors.items():
        others = held[p].count(False)
        assert e <= 1 + 4.5 * math.sqrt(0.21 * others), (p, e, others)
    assert any(all(x) for x in held.values())
    labels_only = pair_errors({r.id: r.split for r in D.stratified_split(df).collect()}, lists)
    assert sum(errors.values()) < 0.6 * sum(labels_only.values()), (sum(errors.values()), sum(labels_only.values()))
    again = D.combination_split(df.repartition(5), hex_digits=1)
    assert {r.id: r.split for r in again.collect()} == got


def test_one_pair_in_most_rows(spark):
    rows = [(i, ["a", "b"] if i % 3 else ["a", None, "a"]) for i in range(600)] + [(600, []), (601, None), (602, [None])]
    df = spark.createDataFrame(rows, "id long, label_list array<string>").withColumn("stratum", F.lit("clash"))
    out = D.combination_split(df)
    assert out.columns == ["id", "label_list", "stratum", "split"] and sum(counts(out)) == 600
    assert all(abs(n - w) <= 2 for n, w in zip(counts(out), (60, 120, 420)))
    assert all(abs(n - w) <= 2 for n, w in zip(counts(out.filter(F.array_contains("label_list", "b"))), (40, 80, 280)))
    none = D.combination_split(df.limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame(
        [(1, ["b", "a"], "train"), (2, ["c"], "test"), (3, ["a", "c"], "val"), (4, ["b"], "train")],
        "id long, label_list array<string>, split string",
    )
    want = [("a", 0), ("b", 1), ("c", 2)]
    for limit in (10, 1):
        assert sorted(tuple(r) for r in D.label_vocabulary(df, limit=limit).collect()) == want
    got = {r.id: r.y for r in D.encode_splits(df).collect()}
    assert got == {1: [1, 1], 2: [0, 0], 3: [1, 0], 4: [0, 1]}
    pairs = D.label_indices(df, D.label_vocabulary(df)).collect()
    assert sorted(tuple(r) for r in pairs) == [(1, 0), (1, 1), (2, 2), (3, 0), (3, 2), (4, 1)]
    report = {(r.split, r.label): (r.n_rows, r.share) for r in D.split_report(df).collect()}
    assert report[("train", "*")] == (2, 0.5) and report[("val", "c")] == (1, 0.5)


def test_folds(spark):
    df = spark.range(7).repartition(3)
    assert [r.fold for r in D.kfold(df).orderBy("id").collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert [r.fold for r in D.kfold(spark.range(2)).orderBy("id").collect()] == [0, 1]
    sizes = [r["count"] for r in D.hashed_folds(spark.range(3000)).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 900
