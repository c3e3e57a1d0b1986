"""From paths to labels: dictionary, per-report label sets, frequency filters, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.paths import label_path
from faultlens.operators.sizing import (
    BROADCAST_ROWS,
    HOT_ROWS,
    IN_ROW_LIMIT,
    bounded_values,
    lookup_join,
    settle,
    skew_join,
)

IGNORE_LABEL = "x"


def dedupe_last_wins(table: DataFrame) -> DataFrame:
    """Dictionary with one row per normalised file: the label of its last row, null included."""
    files = table.select(label_path(F.col("file")).alias("file"), "label", "row_no")
    return files.groupBy("file").agg(F.max_by("label", "row_no").alias("label"))


def usable_labels(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows that name a label: neither null nor the ignore mark."""
    return dictionary.filter(F.col("label").isNotNull() & (F.lower("label") != IGNORE_LABEL))


def label_pairs(paths: DataFrame, table: DataFrame, broadcast_rows=BROADCAST_ROWS, hot_rows=HOT_ROWS) -> DataFrame:
    """Distinct (report, label) in long form, from long paths and the raw dictionary rows.

    A blank path names no file: it is left out, though the original would look it up."""
    usable = settle(usable_labels(dedupe_last_wins(table)).withColumnRenamed("file", "_file"))
    keyed = paths.select("bug_id", label_path(F.col("path")).alias("_file")).filter(F.col("_file") != "")
    joined = lookup_join(keyed, usable, "_file", "inner", broadcast_rows, hot_rows)
    return joined.select("bug_id", "label").distinct()


def labels_for_bug(bugs: DataFrame, paths: DataFrame, table: DataFrame, **limits) -> DataFrame:
    """Reports with a sorted set of labels; a report without any keeps an empty list."""
    sets = label_pairs(paths, table, **limits).groupBy("bug_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    empty = F.array().cast("array<string>")
    return bugs.join(sets, "bug_id", "left").withColumn("labels", F.coalesce("labels", empty))


def filter_label_count(df: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    return df.filter(F.size("labels").between(low, high))


def label_frequency(df: DataFrame, column: str = "labels") -> DataFrame:
    return df.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("frequency"))


def frequent_labels(df: DataFrame, min_frequency: int = 10, column: str = "labels") -> DataFrame:
    return label_frequency(df, column).filter(F.col("frequency") >= min_frequency)


def keep_listed_labels(
    df: DataFrame, keep: DataFrame, column: str = "labels", limit: int = IN_ROW_LIMIT
) -> DataFrame:
    """Drop from each list the labels not in ``keep``; order stays and so do emptied rows.

    A short list is tested inside the row, without a shuffle. A longer one is joined.
    """
    kept = bounded_values(keep, "label", limit)
    if kept is not None:
        return df.withColumn(column, F.filter(column, lambda label: label.isin(kept) if kept else F.lit(False)))
    # Rows get a number of their own, as ids may repeat; written, so that it stays.
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select("_row", F.posexplode(column).alias("_pos", "label"))
    marked = skew_join(rows, keep.select("label", F.lit(True).alias("_keep")).distinct(), "label", "left")
    kept_rows = marked.filter("_keep").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "label"))).alias("_kept"))
    rebuilt = numbered.join(kept_rows, "_row", "left")
    none = F.when(F.col(column).isNotNull(), F.array().cast(df.schema[column].dataType))
    return rebuilt.withColumn(column, F.coalesce(F.transform("_kept", lambda s: s["label"]), none)).select(df.columns)


def keep_frequent_labels(df: DataFrame, min_frequency: int = 10, limit: int = IN_ROW_LIMIT) -> DataFrame:
    """Frequencies are taken once, over the rows as they come in."""
    return keep_listed_labels(df, frequent_labels(df, min_frequency), limit=limit)


def drop_unlabelled(df: DataFrame, column: str = "labels") -> DataFrame:
    return df.filter(F.size(column) > 0)


def top_labels(df: DataFrame, n: int = 20) -> DataFrame:
    return label_frequency(df).orderBy(F.desc("frequency"), "label").limit(n)


def path_occurrences(paths: DataFrame) -> DataFrame:
    """How often each trimmed path occurs over all reports; repeats count."""
    trimmed = paths.select(F.regexp_replace("path", r"(?U)^\s+|\s+$", "").alias("file")).filter(F.col("file") != "")
    return trimmed.groupBy("file").agg(F.count("*").alias("occurrence"))


def _filled(labels: str) -> Column:
    return F.size(F.filter(labels, lambda x: x.rlike(r"(?U)\S")))


def labels_per_bug_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(_filled("labels").alias("n_labels")).agg(F.count("*").alias("bugs")).orderBy("n_labels")


def mean_labels_per_bug(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(_filled("labels")).alias("mean_labels"))


def stage_counts(labelled: DataFrame, low: int = 1, high: int = 5, min_frequency: int = 10) -> DataFrame:
    """Rows and distinct labels before and after each filter, one row per stage."""
    labelled = settle(labelled.select("bug_id", "labels"))
    counted = filter_label_count(labelled, low, high)
    final = drop_unlabelled(keep_frequent_labels(counted, min_frequency))
    rows = labelled.agg(
        F.count("*").alias("bugs_in"),
        F.count_if(F.size("labels").between(low, high)).alias("bugs_after_count_filter"),
    )
    labels = label_frequency(counted).agg(
        F.count("*").alias("labels_before"),
        F.count_if(F.col("frequency") >= min_frequency).alias("labels_after"),
    )
    parts = [rows, labels, final.agg(F.count("*").alias("bugs_out"))]
    stages = [p.unpivot([], p.columns, "stage", "n") for p in parts]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


def labelled_bugs(bugs, paths, table, low: int = 1, high: int = 5, min_frequency: int = 10) -> DataFrame:
    """All label steps in order: map, count filter, frequency filter, drop what is left empty.

    The mapped rows are written once because the frequency count and the filter both read them.
    """
    mapped = settle(filter_label_count(labels_for_bug(bugs, paths, table), low, high))
    return drop_unlabelled(keep_frequent_labels(mapped, min_frequency))
