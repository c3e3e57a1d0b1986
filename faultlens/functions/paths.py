"""Expressions for commit links, repository paths and stored lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Their text decides which rows are kept.
COMMIT_MARK = "Commit"
IGNORED_PATH_PARTS = ("test", "Test")
SOURCE_PREFIX = "/Source"


def under_area(area: Column, root: str) -> Column:
    """True for the area itself and for every area below it."""
    return (area == root) | area.startswith(root + "\\")


def is_commit_link(url: Column) -> Column:
    return url.contains(COMMIT_MARK)


def commit_id(url: Column) -> Column:
    """Last '/' segment, then last '%' segment, less two characters; null when nothing is left."""
    segment = F.element_at(F.split(url, "/"), -1)
    tail = F.element_at(F.split(segment, "%"), -1)
    return F.nullif(F.substring(tail, 3, 2**31 - 1), F.lit(""))


def is_ignored_path(path: Column, parts=IGNORED_PATH_PARTS) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | path.contains(part)
    return hit


def repo_path(path: Column, prefix: str = SOURCE_PREFIX) -> Column:
    """Forward slashes, then the prefix cut off the front (case kept)."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(prefix), F.substring(slashed, len(prefix) + 1, 2**31 - 1)).otherwise(slashed)


def label_path(path: Column) -> Column:
    """Form used to match a path with the dictionary: trimmed, lower case, forward slashes."""
    trimmed = F.regexp_replace(F.coalesce(path, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.replace(F.lower(trimmed), F.lit("\\"), F.lit("/"))


def parse_list_literal(text: Column) -> Column:
    """Read list text such as ``['a', "b"]``; anything else gives null."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(text, "array<string>", options)


def split_delimited(text: Column, delimiter: str = ",") -> Column:
    """Split on a delimiter, trim the pieces and drop the empty ones."""
    pieces = F.split(F.coalesce(text, F.lit("")), "\\Q" + delimiter + "\\E")
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")
