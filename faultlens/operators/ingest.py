"""From tracker tables to one row per (report, changed path). Data stays long until the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import paths as P
from faultlens.functions import text as T
from faultlens.operators.sizing import HOT_ROWS, skew_join


def select_work_items(items: DataFrame, area: str, item_type: str = "Bug", state: str = "Closed") -> DataFrame:
    return items.filter(
        (F.col("item_type") == item_type) & P.under_area(F.col("area_path"), area) & (F.col("state") == state)
    )


def project_bug(items: DataFrame) -> DataFrame:
    return items.select(
        "bug_id",
        "title",
        "priority",
        T.html_to_text(F.col("repro_html")).alias("description"),
        F.to_timestamp("created").alias("created"),
    )


def expand_relations(bugs: DataFrame) -> DataFrame:
    """One row per link; reports without links leave."""
    return bugs.select("bug_id", F.posexplode("relations").alias("rel_pos", "relation")).select(
        "bug_id", "rel_pos", F.col("relation.url").alias("url")
    )


def filter_commit_links(relations: DataFrame) -> DataFrame:
    return relations.filter(P.is_commit_link(F.col("url")))


def with_commit_id(relations: DataFrame) -> DataFrame:
    return relations.withColumn("commit_id", P.commit_id(F.col("url"))).filter(F.col("commit_id").isNotNull())


def join_commit_changes(links: DataFrame, changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(report, commit) x changed files of that commit. Only files; commits not found vanish.

    A commit that touches very many files, or that very many reports link to, is cut into slices.
    """
    files = changes.filter(F.col("object_type") == "blob").select("commit_id", "path_pos", "path")
    return skew_join(links.select("bug_id", "rel_pos", "commit_id"), files, "commit_id", "inner", hot_rows)


def drop_ignored_paths(df: DataFrame, parts=P.IGNORED_PATH_PARTS) -> DataFrame:
    return df.filter(~P.is_ignored_path(F.col("path"), parts))


def normalize_repo_paths(df: DataFrame, prefix: str = P.SOURCE_PREFIX) -> DataFrame:
    return df.withColumn("path", P.repo_path(F.col("path"), prefix))


def first_seen_paths(df: DataFrame) -> DataFrame:
    """Distinct (report, path) with the place where it was first seen, in long form.

    The minimum combines before the shuffle, and the key includes the path, so a report with a
    great many changes is spread over the tasks.
    """
    seen = F.min(F.struct("rel_pos", "path_pos")).alias("seen")
    return df.groupBy("bug_id", "path").agg(seen).select("bug_id", "path", "seen.rel_pos", "seen.path_pos")


def distinct_paths_in_order(df: DataFrame) -> DataFrame:
    """One row per report with its distinct paths in first-seen order.

    For export only: a row has to hold its whole list. The operators downstream take the long form.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rel_pos", "path_pos", "path")))
    grouped = first_seen_paths(df).groupBy("bug_id").agg(ordered.alias("seen"))
    return grouped.select("bug_id", F.transform("seen", lambda s: s["path"]).alias("paths"))


def changed_paths(links: DataFrame, changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links to long first-seen paths. The change side is filtered and normalised before the join."""
    files = normalize_repo_paths(drop_ignored_paths(changes))
    return first_seen_paths(join_commit_changes(links, files, hot_rows))


def bugs_with_paths(bugs: DataFrame, paths: DataFrame) -> DataFrame:
    """Reports that have at least one path."""
    return bugs.join(paths.select("bug_id").distinct(), "bug_id", "left_semi")


def extracted_table(bugs: DataFrame, paths: DataFrame) -> DataFrame:
    """The export form: reports with at least one path, with the path list in the row."""
    return bugs.join(distinct_paths_in_order(paths), "bug_id")


def path_table(df: DataFrame, paths: str = "paths") -> DataFrame:
    """Array column to long rows."""
    return df.select("bug_id", F.explode(paths).alias("path"))
