"""Label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import paths as P
from faultlens.operators import labels as B
from faultlens.operators.sizing import settle
from faultlens.plans import stand_ins as S
from faultlens.plans.queries_ingest import seen_paths
from faultlens.plans.registry import cte, query, r6

FLOOR = 700  # label frequency that some labels of the small tables miss


def labelled(spark, folder):
    paths = settle(seen_paths(spark, folder))
    bugs = paths.select("bug_id").distinct()
    return B.labels_for_bug(bugs, paths, S.path_labels(spark, folder))


def counted(spark, folder):
    return settle(B.filter_label_count(labelled(spark, folder)))


def joined(df):
    return df.withColumn("labels", F.array_join("labels", "|"))


cte("frequent", f"SELECT label FROM counted_frequency WHERE frequency >= {FLOOR}")
cte(
    "kept",
    "SELECT bug_id, coalesce(list(c.label ORDER BY c.label) FILTER (f.label IS NOT NULL), []) AS labels"
    " FROM (SELECT bug_id, unnest(labels) AS label FROM counted) c LEFT JOIN frequent f ON c.label = f.label GROUP BY 1",
)


@query(
    "label_path_normalize",
    "SELECT row_no, replace(lower(trim(file)), chr(92), '/') AS file FROM path_labels",
)
def label_path_normalize(spark, folder):
    return S.path_labels(spark, folder).select("row_no", P.label_path(F.col("file")).alias("file"))


@query("dict_last_wins", "SELECT file, label FROM file_labels")
def dict_last_wins(spark, folder):
    return B.dedupe_last_wins(S.path_labels(spark, folder))


@query("labels_for_bug", "SELECT bug_id, array_to_string(labels, '|') AS labels FROM labelled")
def labels_for_bug(spark, folder):
    return joined(labelled(spark, folder))


@query("label_count_filter", "SELECT bug_id, array_to_string(labels, '|') AS labels FROM counted")
def label_count_filter(spark, folder):
    return joined(B.filter_label_count(labelled(spark, folder)))


@query("label_frequency", "SELECT label, frequency FROM counted_frequency")
def label_frequency(spark, folder):
    return B.label_frequency(B.filter_label_count(labelled(spark, folder)))


@query("keep_frequent_labels", "SELECT bug_id, array_to_string(labels, '|') AS labels FROM kept")
def keep_frequent_labels(spark, folder):
    return joined(B.keep_frequent_labels(counted(spark, folder), FLOOR))


@query("drop_unlabelled", "SELECT bug_id, array_to_string(labels, '|') AS labels FROM kept WHERE len(labels) > 0")
def drop_unlabelled(spark, folder):
    return joined(B.drop_unlabelled(B.keep_frequent_labels(counted(spark, folder), FLOOR)))


@query("top_labels", "SELECT label, frequency FROM counted_frequency ORDER BY frequency DESC, label LIMIT 20")
def top_labels(spark, folder):
    return B.top_labels(B.filter_label_count(labelled(spark, folder)))


@query("path_occurrences", "SELECT path AS file, count(*) AS occurrence FROM bug_paths GROUP BY 1")
def path_occurrences(spark, folder):
    return B.path_occurrences(seen_paths(spark, folder))


@query("labels_per_bug_histogram", "SELECT len(labels)::INTEGER AS n_labels, count(*) AS bugs FROM labelled GROUP BY 1 ORDER BY 1")
def labels_per_bug_histogram(spark, folder):
    return B.labels_per_bug_histogram(labelled(spark, folder))


@query("mean_labels_per_bug", f"SELECT {r6('avg(len(labels))')} AS mean_labels FROM labelled")
def mean_labels_per_bug(spark, folder):
    return B.mean_labels_per_bug(labelled(spark, folder)).select(F.expr(r6("mean_labels")).alias("mean_labels"))


@query(
    "stage_counts",
    "SELECT 'bugs_in' AS stage, count(*) AS n FROM labelled UNION ALL SELECT 'bugs_after_count_filter', count(*) FROM counted"
    " UNION ALL SELECT 'labels_before', count(*) FROM counted_frequency UNION ALL SELECT 'labels_after', count(*) FROM frequent"
    " UNION ALL SELECT 'bugs_out', count(*) FROM kept WHERE len(labels) > 0",
)
def stage_counts(spark, folder):
    return B.stage_counts(labelled(spark, folder), min_frequency=FLOOR)
