"""Checked sizes, joins that survive hot keys, and positions without a single-task sort.

Limits are parameters with defaults here. Every limit has another exact way beyond it.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IN_ROW_LIMIT = 5_000  # values held as one literal array next to every row
BROADCAST_ROWS = 1_000_000  # rows of a lookup table that may be sent to every executor
HOT_ROWS = 2_000_000  # rows of one key that one task is asked to take
SENT_BYTES = 64 << 20  # of a lookup table that may be sent to every executor


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors reach: the cluster's checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="faultlens-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it back: lineage ends there, and a
    lost executor re-reads files instead of repeating the work."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/faultlens-{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.settled_path = path
    return held


def drop_settled(df: DataFrame) -> None:
    """Remove one table that :func:`settle` has returned, once nothing will read it any more."""
    _delete(df.sparkSession, df.settled_path)


def settle_instead(df: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """:func:`settle` for a table that takes the place of those it was made from: written tables that it reads are removed, but
    not ``keep``. For a caller who knows that nothing else reads them any more."""
    own = f"/faultlens-{df.sparkSession.sparkContext.applicationId}/"
    kept = keep.settled_path.rsplit("/", 1)[1] if keep is not None else None
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles() if own in file}
    sources = [folder for folder in folders if folder.rsplit("/", 1)[1] != kept]
    held = settle(df)
    for path in sources:
        _delete(df.sparkSession, path)
    return held


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def may_be_sent(df: DataFrame, rows: int | None = None, size: int = SENT_BYTES) -> bool:
    """Whether a table is small enough for every executor, by its rows and by its measured bytes
    (the text of its rows as JSON). Never reads past the row limit."""
    held = df.limit((rows or BROADCAST_ROWS) + 1)
    n, width = held.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return n <= (rows or BROADCAST_ROWS) and (width or 0) <= size


def release(spark: SparkSession) -> None:
    """Remove the tables that this application has written with :func:`settle`. For a caller who has
    finished with all results that were made from them."""
    _delete(spark, f"{shared_folder(spark).rstrip('/')}/faultlens-{spark.sparkContext.applicationId}")


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check that never reads past the limit."""
    return df.limit(rows + 1).count() <= rows


def bounded_values(df: DataFrame, column: str, limit: int = IN_ROW_LIMIT) -> list | None:
    """The column as a list when it has at most ``limit`` rows, else None."""
    rows = df.select(column).limit(limit + 1).collect()
    return None if len(rows) > limit else [r[0] for r in rows]


def literal_array(values: list, element: str = "string") -> Column:
    return F.lit(values).cast(f"array<{element}>") if values else F.array().cast(f"array<{element}>")


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, number of slices) of every key over ``hot_rows`` rows, as a written table.

    Counting combines before the shuffle, so a key with a third of the rows costs no more here
    than any other.
    """
    heavy = df.groupBy(key).count().filter((F.col("count") > hot_rows) & F.col(key).isNotNull())
    return settle(heavy.select(key, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("_slices")))


def _with_slices(df: DataFrame, key: str, hot: DataFrame | None, name: str) -> DataFrame:
    """The number of slices of each row's key. The list has a row for each ``hot_rows`` rows at
    most; one too long to send is joined."""
    if hot is None:
        return df.withColumn(name, F.lit(1))
    sizes = hot.withColumnRenamed("_slices", name)
    if may_be_sent(sizes):
        sizes = F.broadcast(sizes)
    return df.join(sizes, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(1)))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot_left: DataFrame | None = None,
    count_right: bool = True,
) -> DataFrame:
    """Equi-join in which a hot key on either side is cut into slices.

    A hot key's rows on the left are spread over n slices and its rows on the right are repeated
    for each slice, and the other way round, so each pair still meets exactly once. Other keys
    are neither spread nor repeated. For joins other than inner only the left side is spread.
    Callers that join the same side again pass its hot keys instead of having them counted again.
    A side that is counted here is written first, so that it is not made a second time for the join.
    """
    if hot_left is None:
        left = settle(left)
        hot_left = hot_keys(left, key, hot_rows)
    hot_left = None if hot_left.isEmpty() else hot_left
    hot_right = None
    if how == "inner" and count_right:
        right = settle(right)
        hot_right = hot_keys(right, key, hot_rows)
        hot_right = None if hot_right.isEmpty() else hot_right
    if hot_left is None and hot_right is None:
        return left.join(right, key, how)

    sides = []
    for own, cols, first in ((left, left.columns, True), (right, right.columns, False)):
        own = _with_slices(_with_slices(own, key, hot_left, "_nl"), key, hot_right, "_nr")
        spread = F.pmod(F.xxhash64(*cols), F.col("_nl" if first else "_nr")).cast("int")
        repeat = F.explode(F.sequence(F.lit(0), F.col("_nr" if first else "_nl") - 1))
        names = ("_i", "_j") if first else ("_j", "_i")
        sides.append(own.withColumn(names[0], spread).withColumn(names[1], repeat).drop("_nl", "_nr"))
    joined = sides[0].join(sides[1], [key, "_i", "_j"], how)
    return joined.drop("_i", "_j")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join with a lookup table that has one row per key: sent to the executors when its counted rows
    and measured bytes allow (no shuffle of the facts), else a shuffle join that cuts hot keys."""
    if may_be_sent(table, broadcast_rows) if broadcast_rows else False:
        return facts.join(F.broadcast(table), key, how)
    return skew_join(facts, table, key, how, hot_rows)


def with_position(df: DataFrame, order_by: str, name: str = "position") -> DataFrame:
    """0-based position of each row in the order of a unique column, sorted on many tasks.

    Range partitions are written once; each row's position is the size of the partitions before
    its own plus its place inside it. The offsets table has one row per partition.
    """
    ranged = settle(df.repartitionByRange(order_by).withColumn("_slice", F.spark_partition_id()))
    sizes = ranged.groupBy("_slice").count()
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(order_by))
    placed = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_slice")
    return placed.withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_slice", "_place", "_before")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def unmatched_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that stand on one side only, with the side."""

    def missing(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        # Repeated ids of the other side are dropped before they travel.
        alone = own.select(key).join(other.select(key).distinct(), key, "left_anti")
        return alone.withColumn("side", F.lit(side))

    return missing(left, right, "left").unionByName(missing(right, left, "right"))


def existing_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])
