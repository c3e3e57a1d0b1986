from pyspark.sql import functions as F

from faultlens.functions import paths as P
from faultlens.operators import audit
from faultlens.operators import ingest as A
from faultlens.operators import sizing as Z


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select(expression(F.col("v")), "i").orderBy("i").collect()]


def test_commit_id(spark):
    urls = ["vstfs:///Git/Commit/p%2Fr%2Fabc123", "http://h/Commit/abc123", "http://h/Commit/p%2F", ""]
    assert values(spark, urls, P.commit_id) == ["abc123", "c123", None, None]


def test_paths_and_traps(spark):
    raw = ["/Source/App/Main.cs", "\\Source\\App\\Main.cs", "/SourceTree/a.cs", "/App/latest/a.cs", "/App/TEST/a.cs", "/x/Test/a"]
    assert values(spark, raw, P.is_ignored_path) == [False, False, False, True, False, True]
    assert values(spark, raw[:3] + raw[4:5], P.repo_path) == ["/App/Main.cs", "/App/Main.cs", "Tree/a.cs", "/App/TEST/a.cs"]
    assert values(spark, [" /Source\\App ", None, "A"], P.label_path) == ["/source/app", "", "a"]


def test_area(spark):
    areas = ["T", "T\\a", "T\\a\\b", "Tx", "U\\T"]
    assert values(spark, areas, lambda c: P.under_area(c, "T")) == [True, True, True, False, False]


def test_list_text(spark):
    texts = ["['/a', '/b']", "[]", "[\"it's\", 'b']", "['it\\'s']", "oops", "", None, "'x'", "['a', 'b'"]
    expected = [["/a", "/b"], [], ["it's", "b"], ["it's"], None, None, None, None, None]
    assert values(spark, texts, P.parse_list_literal) == expected
    assert values(spark, [" a, ,b ,", None, ""], P.split_delimited) == [["a", "b"], [], []]


def test_select_and_first_seen(spark):
    items = spark.createDataFrame(
        [(1, "Bug", "T\\a", "Closed"), (2, "Task", "T", "Closed"), (3, "Bug", "T", "Active"), (4, "Bug", "Tx", "Closed")],
        "bug_id long, item_type string, area_path string, state string",
    )
    assert [r.bug_id for r in A.select_work_items(items, "T").collect()] == [1]
    links = spark.createDataFrame(
        [(1, 0, "c2"), (1, 1, "c1"), (2, 0, "gone"), (3, 0, "c1")], "bug_id long, rel_pos int, commit_id string"
    )
    changes = spark.createDataFrame(
        [
            ("c1", 0, "/Source/z.c", "blob"),
            ("c1", 1, "/dir", "tree"),
            ("c1", 2, "\\Source\\a.c", "blob"),
            ("c2", 0, "/a.c", "blob"),
            ("c2", 1, "/latest/b.c", "blob"),
        ],
        "commit_id string, path_pos int, path string, object_type string",
    )
    lists = A.distinct_paths_in_order(A.changed_paths(links, changes)).collect()
    assert {r.bug_id: r.paths for r in lists} == {1: ["/a.c", "/z.c"], 3: ["/z.c", "/a.c"]}


def sides(spark):
    left = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select(F.when(F.col("id") < 90, 7).otherwise(F.col("id") % 13).alias("k"), F.col("id").alias("b"))
    return left, right


def test_skew_join_equals_plain_join(spark):
    left, right = sides(spark)
    for hot_rows in (10, 60, 10**6):
        got = Z.skew_join(left, right, "k", hot_rows=hot_rows)
        assert sorted(got.collect()) == sorted(left.join(right, "k").collect())
    table = right.groupBy("k").agg(F.max("b").alias("b"))
    want = sorted(left.join(table, "k", "left").collect(), key=str)
    assert sorted(Z.skew_join(left, table, "k", "left", hot_rows=10).collect(), key=str) == want
    assert sorted(Z.lookup_join(left, table, "k", "left", broadcast_rows=3, hot_rows=10).collect(), key=str) == want
    assert sorted(Z.lookup_join(left, table, "k", "left").collect(), key=str) == want


def test_skew_join_keeps_duplicates_and_spreads(spark):
    left = spark.createDataFrame([(1, "x")] * 5 + [(None, "n")], "k int, a string")
    right = spark.createDataFrame([(1, "y")] * 3, "k int, b string")
    assert Z.skew_join(left, right, "k", hot_rows=2).count() == 15
    assert [tuple(r) for r in Z.hot_keys(left, "k", 2).collect()] == [(1, 3)]


def test_position_is_the_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(5)
    placed = Z.with_position(df, "id").collect()
    assert all(r.id == r.position for r in placed) and len(placed) == 1000


def test_checks(spark):
    import pytest

    df = spark.range(3)
    with pytest.raises(ValueError):
        Z.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        Z.require_rows(df.limit(0), "table")
    assert Z.existing_columns(df, ["x", "id"]).columns == ["id"]
    other = spark.range(2, 5)
    assert sorted((r.id, r.side) for r in Z.unmatched_ids(df, other, "id").collect()) == [
        (0, "left"), (1, "left"), (3, "right"), (4, "right"),
    ]


def test_left_out_rows_are_counted(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, ""), (None, "b")], "_id long, text string")
    reasons = {"blank": F.col("text") == "", "no text": F.col("text").isNull(), "large": F.col("_id") > 2, "never": F.lit(None).cast("boolean")}
    kept, report = audit.settle_counted(rows, "texts", reasons)
    assert kept.columns == ["_id", "text"] and sorted(kept.collect(), key=str) == [(1, "a"), (None, "b")]
    counts = {"read": 5, "blank": 2, "no text": 1, "large": 0, "never": 0}
    assert [tuple(r) for r in report.collect()] == [("texts", k, n) for k, n in counts.items()]
    kept, report = audit.settle_counted(rows.limit(0), "none", {"blank": F.col("text") == ""})
    assert kept.isEmpty() and [r.n_rows for r in report.collect()] == [0, 0]
