"""Ingest and linking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultlens.functions import paths as P
from faultlens.functions import text as T
from faultlens.operators import ingest as A
from faultlens.operators.audit import settle_counted
from faultlens.operators.sizing import require_columns, shared_folder, unmatched_ids
from faultlens.plans import stand_ins as S
from faultlens.plans.registry import query, table
from faultlens.sources import files

AREA = "ASIA"
SELECTED = f"item_type = 'Bug' AND (area_path = '{AREA}' OR starts_with(area_path, '{AREA}' || chr(92))) AND state = 'Closed'"

NODE_BREAK = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[!?][^>]*>"
    r"""|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
)
# Entities that occur in the given pages; '&amp;' comes last so that nothing is decoded twice.
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")]


def html_sql(column: str) -> str:
    node = "x"
    for name, char in ENTITIES:
        node = f"regexp_replace({node}, '&{name};?', '{char}', 'g')"
    trimmed = rf"regexp_replace({node}, '^[\s\p{{Z}}\x0b\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x0b\x{{85}}\x1c-\x1f]+$', '', 'g')"
    nodes = f"list_transform(regexp_split_to_array({column}, '{NODE_BREAK}'), lambda x: {trimmed})"
    return rf"array_to_string(list_filter({nodes}, lambda x: x <> ''), chr(10))"


@query(
    "workitem_filter",
    f"SELECT bug_id, item_type, area_path, state FROM work_items WHERE {SELECTED}",
)
def workitem_filter(spark, folder):
    chosen = A.select_work_items(S.work_items(spark, folder), AREA)
    return chosen.select("bug_id", "item_type", "area_path", "state")


@query(
    "bug_projection",
    f"SELECT bug_id, title, priority, {html_sql('repro_html')} AS description,"
    " strftime(CAST(created AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created FROM work_items",
)
def bug_projection(spark, folder):
    bugs = A.project_bug(S.work_items(spark, folder))
    return bugs.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query("html_to_text", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("relation_expand", "SELECT bug_id, rel_pos, url FROM relation_rows")
def relation_expand(spark, folder):
    return A.expand_relations(S.bug_relations(spark, folder))


@query("commit_link_filter", "SELECT bug_id, rel_pos, url FROM relation_rows WHERE contains(url, 'Commit')")
def commit_link_filter(spark, folder):
    return A.filter_commit_links(A.expand_relations(S.bug_relations(spark, folder)))


def links(spark, folder):
    return A.with_commit_id(A.filter_commit_links(A.expand_relations(S.bug_relations(spark, folder))))


@query("commit_id_extract", "SELECT bug_id, rel_pos, commit_id FROM commit_links")
def commit_id_extract(spark, folder):
    return links(spark, folder).select("bug_id", "rel_pos", "commit_id")


@query(
    "commit_path_join",
    "SELECT bug_id, rel_pos, commit_id, path_pos, path FROM commit_links JOIN commit_changes USING (commit_id)"
    " WHERE object_type = 'blob'",
)
def commit_path_join(spark, folder):
    joined = A.join_commit_changes(links(spark, folder), S.commit_changes(spark, folder))
    return joined.select("bug_id", "rel_pos", "commit_id", "path_pos", "path")


@query(
    "path_ignore_filter",
    "SELECT commit_id, path_pos, path FROM commit_changes WHERE NOT contains(path, 'test') AND NOT contains(path, 'Test')",
)
def path_ignore_filter(spark, folder):
    return A.drop_ignored_paths(S.commit_changes(spark, folder)).select("commit_id", "path_pos", "path")


@query("path_normalize", f"SELECT commit_id, path_pos, path AS raw, {S.REPO_PATH_SQL} AS path FROM commit_changes")
def path_normalize(spark, folder):
    changes = S.commit_changes(spark, folder).withColumn("raw", F.col("path"))
    return A.normalize_repo_paths(changes).select("commit_id", "path_pos", "raw", "path")


def seen_paths(spark, folder):
    return A.changed_paths(links(spark, folder), S.commit_changes(spark, folder))


@query("paths_first_seen", "SELECT bug_id, path, seen // 1000 AS rel_pos, seen % 1000 AS path_pos FROM bug_paths")
def paths_first_seen(spark, folder):
    return seen_paths(spark, folder)


@query(
    "paths_in_order",
    "SELECT bug_id, array_to_string(list(path ORDER BY seen, path), '|') AS paths FROM bug_paths GROUP BY 1",
)
def paths_in_order(spark, folder):
    lists = A.distinct_paths_in_order(seen_paths(spark, folder))
    return lists.select("bug_id", F.array_join("paths", "|").alias("paths"))


@query(
    "bugs_with_paths",
    f"SELECT bug_id, title, priority FROM work_items WHERE {SELECTED} AND bug_id IN (SELECT bug_id FROM bug_paths)",
)
def bugs_with_paths(spark, folder):
    bugs = A.select_work_items(S.work_items(spark, folder), AREA)
    return A.bugs_with_paths(bugs, seen_paths(spark, folder)).select("bug_id", "title", "priority")


@query(
    "extracted_table",
    "SELECT w.bug_id, title, priority, array_to_string(list(path ORDER BY seen, path), '|') AS paths"
    f" FROM work_items w JOIN bug_paths b ON w.bug_id = b.bug_id WHERE {SELECTED} GROUP BY ALL",
)
def extracted_table(spark, folder):
    bugs = A.select_work_items(S.work_items(spark, folder), AREA)
    found = A.extracted_table(bugs, seen_paths(spark, folder))
    return found.select("bug_id", "title", "priority", F.array_join("paths", "|").alias("paths"))


LIST_TEXT = "CASE WHEN p_type = 'PROMO' THEN 'broken [' || p_name ELSE '[''' || p_name || ''', ''' || p_brand || ''']' END"


@query(
    "list_literal_parse",
    f"SELECT p_partkey, p_type <> 'PROMO' AS readable,"
    f" CASE WHEN p_type <> 'PROMO' THEN array_to_string(string_split(({LIST_TEXT})[3:-3], ''', '''), '|') END AS items FROM part",
)
def list_literal_parse(spark, folder):
    quoted = F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_brand"), F.lit("']"))
    broken = F.concat(F.lit("broken ["), F.col("p_name"))
    text = F.when(F.col("p_type") == "PROMO", broken).otherwise(quoted)
    items = P.parse_list_literal(text)
    return table(spark, folder, "part").select(
        "p_partkey", items.isNotNull().alias("readable"), F.array_join(items, "|").alias("items")
    )


DELIMITED = "p_name || ' , ,' || p_brand || ',' || p_type || ' ,'"


@query(
    "delimited_parse",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split("
    f"{DELIMITED}, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part",
)
def delimited_parse(spark, folder):
    items = P.split_delimited(F.expr(DELIMITED))
    return table(spark, folder, "part").select("p_partkey", F.array_join(items, "|").alias("items"))


@query(
    "id_mismatch_check",
    "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    " UNION ALL SELECT DISTINCT doc_id, 'right' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def id_mismatch_check(spark, folder):
    docs = require_columns(table(spark, folder, "documents"), ["doc_id", "text"])
    return unmatched_ids(docs, require_columns(table(spark, folder, "labels"), ["doc_id"]), "doc_id")


@query(
    "skipped_rows",
    "SELECT 'lists' AS stage, 'read' AS outcome, count(*) AS n_rows FROM part"
    " UNION ALL SELECT 'lists', 'unreadable', count(*) FROM part WHERE p_type = 'PROMO'"
    " UNION ALL SELECT 'links', 'read', count(*) FROM relation_rows"
    " UNION ALL SELECT 'links', 'no commit link', count(*) FROM relation_rows WHERE NOT contains(url, 'Commit')"
    " UNION ALL SELECT 'links', 'no commit id', count(*) FROM relation_rows WHERE contains(url, 'Commit')"
    " AND substr(string_split(string_split(url, '/')[-1], '%')[-1], 3) = ''"
    " UNION ALL SELECT 'commits', 'read', count(*) FROM commit_links"
    " UNION ALL SELECT 'commits', 'no such commit', count(*) FROM commit_links WHERE commit_id NOT IN (SELECT commit_id FROM commit_changes)",
)
def skipped_rows(spark, folder):
    """Rows that reading lists, following links and looking up commits leave out, with the reason."""
    quoted = F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_brand"), F.lit("']"))
    text = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("broken ["), F.col("p_name"))).otherwise(quoted)
    lists = table(spark, folder, "part").select("p_partkey", P.parse_list_literal(text).alias("items"))
    _, read = settle_counted(lists, "lists", {"unreadable": F.col("items").isNull()})
    links = A.expand_relations(S.bug_relations(spark, folder)).withColumn("commit_id", P.commit_id(F.col("url")))
    reasons = {"no commit link": ~P.is_commit_link(F.col("url")), "no commit id": F.col("commit_id").isNull()}
    links, followed = settle_counted(links, "links", reasons)
    # Commits are made distinct first, so that one with very many files is one row here.
    known = S.commit_changes(spark, folder).select("commit_id").distinct().withColumn("known", F.lit(True))
    _, found = settle_counted(links.join(known, "commit_id", "left"), "commits", {"no such commit": F.col("known").isNull()})
    return read.unionByName(followed).unionByName(found)


@query("csv_splits", "SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents")
def csv_splits(spark, folder):
    """Texts written as quoted CSV and read back, every file by as many tasks as it has splits."""
    texts = table(spark, folder, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang")])
    path = f"{shared_folder(spark).rstrip('/')}/faultlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    files.write_csv(texts, path)
    return files.read_split_csv(spark, path, "doc_id long, text string, lang string")
