"""Line dedup by overlapping windows of three lines.

Each text is cut at line feeds; every run of ``width`` lines that follow one another is a window,
known by two 64-bit hashes. A window that stands more than once anywhere keeps its first occurrence
(smallest id, then smallest place); every later occurrence covers its lines, covered places are
merged, and covered lines go. Lines are hashed where they are read and only (id, place, hash) rows
travel, after windows that stand once have been left out.

Cases: null text stays null; texts of fewer lines than the width have no window and stay as they are.
A text whose lines are all covered becomes empty; its row stays. Rows with a null id count as one
document that comes last. Rows that share an id and a text are one document, and get the same result.
Empty lines are lines. Other columns stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.sizing import settle

WIDTH = 3


def _windows(text: Column, width: int) -> Column:
    """(place, hash, hash) of every window of a text."""
    lines = F.split(text, "\n", -1)
    # Lines are hashed once; a window's hash is made of its lines' hashes, in order.
    pairs = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("other"), x).alias("b")))

    def window(all_: Column) -> Column:
        whole = lambda field: lambda i: F.xxhash64(*[all_[i + k][field] for k in range(width)])
        return F.transform(
            F.sequence(F.lit(0), F.size(all_) - width),
            lambda i: F.struct(i.cast("int").alias("place"), whole("a")(i).alias("w1"), whole("b")(i).alias("w2")),
        )

    return F.when(F.size(lines) >= width, F.element_at(F.transform(F.array(pairs), window), 1))


def covered_places(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with lines to remove: _doc (id and text hash) and the covered places."""
    named = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("_doc"), F.col(text).alias("_text"))
    rows = named.select("_doc", F.explode(_windows(F.col("_text"), width)).alias("_w")).select("_doc", "_w.place", "_w.w1", "_w.w2")
    windows = settle(rows)
    # Written first: the join below then deals both sides itself and can split a hot window.
    firsts = settle(
        windows.groupBy("w1", "w2")
        .agg(F.min(F.struct("_doc", "place")).alias("first"), F.max(F.struct("_doc", "place")).alias("last"))
        .filter("first <> last")
        .select("w1", "w2", "first")
    )
    later = windows.join(firsts, ["w1", "w2"]).filter(F.struct("_doc", "place") != F.col("first"))
    # Starts of covered windows of a document, merged into the lines they cover.
    starts = later.groupBy("_doc").agg(F.collect_set("place").alias("starts"))
    spans = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))
    return starts.select("_doc", F.array_sort(spans).alias("covered"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns; ``text`` without the covered lines, and n_lines_removed."""
    covered = settle(covered_places(docs, width, key, text))
    named = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    # One plan at every size: covered places grow with the corpus, so they are never sent whole.
    joined = docs.withColumn("_doc", named).join(covered.hint("merge"), "_doc", "left").drop("_doc")
    gone = F.col("covered")
    # One lambda variable holds the lines, so that a text is cut once and not once for each line.
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i])
    left = F.array_join(F.element_at(F.transform(F.array(F.split(F.col(text), "\n", -1)), kept), 1), "\n")
    out = joined.withColumn(text, F.when(gone.isNull(), F.col(text)).otherwise(left))
    return out.withColumn("n_lines_removed", F.coalesce(F.size("covered"), F.lit(0)).cast("long")).drop("covered")
