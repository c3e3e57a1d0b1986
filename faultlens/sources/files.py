"""CSV, Parquet, text and JSON tables. Parquet is the form between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.operators.sizing import settle

_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> DataFrame:
    """Quoted text; the schema is given, never guessed.

    A file whose text holds line breaks is one task here (:func:`read_split_csv` cuts it); without
    line breaks one file is read by many tasks.
    """
    return spark.read.options(**_CSV).option("multiLine", line_breaks).schema(schema).csv(path)


def read_split_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same rows, line breaks in quoted text included, with each file read by many tasks.

    Lines are read in splits. A line begins a record if the quotes before it are even in number; the
    quotes of earlier splits come from a table with a row for each split. Lines of a record meet by
    (file, split in which it begins, number in there), so a group is never more than a record. Quotes must stand around
    fields, and doubled inside them; a file starts with its header. Empty lines between records are no rows, a last
    record whose quote never closes runs to the end of its file.
    """
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *where, F.monotonically_increasing_id().alias("_line"))
    lines = lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("_file", "_split").agg(F.sum("_quotes").alias("_sum"), F.min_by(F.endswith("value", F.lit("\r")), "_line").alias("_crlf"))
    # The header tells how lines end in its file; whole reading turns those ends into line feeds inside quotes too.
    crlf = F.first("_crlf").over(Window.partitionBy("_file").orderBy("_split"))
    before = sums.select("_file", "_split", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), crlf.alias("_crlf"))

    # A split's lines are one partition here as they were one task before.
    upto = Window.partitionBy("_file", "_split").orderBy("_line")
    inside = F.coalesce(F.sum("_quotes").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("_inside", inside).join(before, ["_file", "_split"])
    begins = ((F.col("_before") + F.col("_inside")) % 2 == 0).cast("int")
    placed = placed.withColumn("_begins", begins).withColumn("_n", F.sum("_begins").over(upto))
    placed = settle(placed.select("value", "_file", "_split", "_line", "_n", "_crlf"))
    # Lines ahead of a split's first record go on with the last record of the splits before.
    last = placed.groupBy("_file", "_split").agg(F.max("_n").alias("_last"))
    open_at = F.last(F.when(F.col("_last") > 0, F.struct("_split", "_last")), ignorenulls=True).over(earlier)
    placed = placed.join(last.select("_file", "_split", open_at.alias("_open")), ["_file", "_split"])
    own = F.when(F.col("_n") > 0, F.struct(F.col("_split"), F.col("_n").alias("_last"))).otherwise(F.col("_open"))
    joined = placed.groupBy("_file", own.alias("_record")).agg(F.sort_array(F.collect_list(F.struct("_split", "_line", "value"))).alias("_all"), F.first("_crlf").alias("_crlf"))
    text = F.array_join(F.col("_all.value"), "\n")
    text = F.when(F.col("_crlf"), F.regexp_replace(text, r"\r(\n|\z)", "$1")).otherwise(text)
    header = (F.col("_record._split") == 0) & (F.col("_record._last") == 1)
    records = joined.filter(~header).select(text.alias("_text")).filter("_text <> ''")
    options = {k: v for k, v in _CSV.items() if k in ("quote", "escape")}
    return records.select(F.from_csv("_text", schema, {**options, "multiLine": "true"}).alias("_row")).select("_row.*")


def list_as_text(df: DataFrame, column: str) -> DataFrame:
    """Array column to list text, for files that cannot hold arrays."""
    quoted = F.transform(
        column, lambda v: F.concat(F.lit("'"), F.regexp_replace(v, r"([\\'])", r"\\$1"), F.lit("'"))
    )
    return df.withColumn(column, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    for field in df.schema.fields:
        if field.dataType.simpleString() == "array<string>":
            df = list_as_text(df, field.name)
    # Header, quotes and escapes as read_csv expects them; empty text is written as "".
    df.write.mode(mode).options(header="true", quote='"', escape='"', quoteAll="true", encoding="UTF-8").csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, partitioned by low-cardinality columns such as split and variant. A split with a
    great many rows still gets one file per task."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A metric or report table as one text line per row: tab-separated, numbers with 4 digits."""
    cells = [
        F.format_string("%.4f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string")
        for c, kind in report.dtypes
    ]
    filled = [F.coalesce(cell, F.lit("")) for cell in cells]
    report.select(F.concat_ws("\t", *filled).alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
