from faultlens.operators import labels as B


def bugs(spark):
    table = spark.createDataFrame(
        [(1, "/A/x.c", "Core"), (2, "\\a\\X.c", "UI"), (3, "/b.c", "X"), (4, "/c.c", "old"), (5, "/c.c", None), (6, "/d.c", "Net")],
        "row_no long, file string, label string",
    )
    paths = spark.createDataFrame(
        [(1, "/a/x.c"), (1, "/d.c"), (2, "/d.c"), (2, "/d.c"), (3, "/b.c"), (3, "/c.c"), (3, "/zz.c"), (4, "/a/x.c")],
        "bug_id long, path string",
    )
    return paths.select("bug_id").distinct(), paths, table


def as_dict(df):
    return {r.bug_id: r.labels for r in df.collect()}


def test_dictionary(spark):
    got = {r.file: r.label for r in B.dedupe_last_wins(bugs(spark)[2]).collect()}
    assert got == {"/a/x.c": "UI", "/b.c": "X", "/c.c": None, "/d.c": "Net"}


def test_steps(spark):
    ids, paths, table = bugs(spark)
    want = {1: ["Net", "UI"], 2: ["Net"], 3: [], 4: ["UI"]}
    labelled = B.labels_for_bug(ids, paths, table)
    assert as_dict(labelled) == want
    assert as_dict(B.labels_for_bug(ids, paths, table, broadcast_rows=0, hot_rows=1)) == want
    counted = B.filter_label_count(labelled)
    assert 3 not in as_dict(counted)
    for limit in (100, 0):
        assert as_dict(B.keep_frequent_labels(counted, 2, limit)) == {1: ["Net", "UI"], 2: ["Net"], 4: ["UI"]}
        assert as_dict(B.keep_frequent_labels(counted, 3, limit)) == {1: [], 2: [], 4: []}
    assert B.drop_unlabelled(B.keep_frequent_labels(counted, 3)).count() == 0
    assert as_dict(B.labelled_bugs(ids, paths, table, min_frequency=2)) == {1: ["Net", "UI"], 2: ["Net"], 4: ["UI"]}


def test_frequency_is_not_repeated(spark):
    """Dropping a label does not lower the count of the others."""
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "bug_id long, labels array<string>")
    assert as_dict(B.keep_frequent_labels(df, 2)) == {1: ["a"], 2: ["a"], 3: []}


def test_profiles(spark):
    df = spark.createDataFrame([(1, ["a", " "]), (2, ["a", "b"]), (3, []), (4, ["b"])], "bug_id long, labels array<string>")
    assert [tuple(r) for r in B.labels_per_bug_histogram(df).collect()] == [(0, 1), (1, 2), (2, 1)]
    assert B.mean_labels_per_bug(df).first()[0] == 1.0
    assert [tuple(r) for r in B.top_labels(df, 2).collect()] == [("a", 2), ("b", 2)]
    counts = {r.stage: r.n for r in B.stage_counts(df, 1, 1, 1).collect()}
    assert counts == {"bugs_in": 4, "bugs_after_count_filter": 1, "labels_before": 1, "labels_after": 1, "bugs_out": 1}
    paths = spark.createDataFrame([(1, " a "), (2, "a"), (3, " ")], "bug_id long, path string")
    assert [tuple(r) for r in B.path_occurrences(paths).collect()] == [("a", 2)]
