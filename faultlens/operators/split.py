"""Label vocabulary, multi-hot encoding, stratified split, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.functions.binding import bind
from faultlens.functions.draws import draw_key, draw_unit
from faultlens.operators.labels import label_frequency
from faultlens.operators.sizing import (
    IN_ROW_LIMIT,
    bounded_values,
    literal_array,
    lookup_join,
    require_rows,
    settle,
    skew_join,
    with_position,
)

SEED = 42
TEST_SHARE = 0.1
VALIDATION_SHARE = 0.2
SMALL_STRATUM = 6
POOLED = "\u0000pooled"


def label_vocabulary(df: DataFrame, column: str = "label_list", limit: int = IN_ROW_LIMIT) -> DataFrame:
    """Sorted distinct labels with a 0-based index; a null is no label."""
    labels = settle(df.select(F.explode(column).alias("label")).filter(F.col("label").isNotNull()).distinct())
    spark = df.sparkSession
    values = bounded_values(labels, "label", limit)
    if values is None:
        return with_position(labels, "label", "label_idx").withColumn("label_idx", F.col("label_idx").cast("int"))
    indexed = [(label, i) for i, label in enumerate(sorted(values, key=lambda v: v.encode()))]
    return spark.createDataFrame(indexed, "label string, label_idx int")


def binarize(df: DataFrame, vocabulary: DataFrame, column: str = "label_list", limit: int = IN_ROW_LIMIT) -> DataFrame:
    """Multi-hot row ``y``; labels outside the vocabulary vanish, the row stays.

    A vocabulary of up to ``limit`` labels is held next to each row; with a larger one a row's labels are
    looked up by a join, and its numbers become the places of ones."""
    listed = bounded_values(vocabulary.orderBy("label_idx"), "label", limit)
    if listed is not None:
        # A null in the list hides no other label; a null list has null numbers.
        has = lambda v: F.coalesce(F.array_contains(column, v), F.when(F.col(column).isNotNull(), False)).cast("int")
        return df.withColumn("y", F.transform(literal_array(listed), has))
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    places = label_indices(numbered, vocabulary, column, "_row").groupBy("_row").agg(F.collect_set("label_idx").alias("_at"))
    size = vocabulary.count()
    held = F.map_from_arrays("_at", F.transform("_at", lambda _: F.lit(1)))
    none = F.array_repeat(F.lit(0), size)
    ones = bind(held, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0))))
    y = F.when(F.col("_at").isNotNull(), ones).when(F.col(column).isNotNull(), none).otherwise(F.array_repeat(F.lit(None).cast("int"), size))
    return numbered.join(places, "_row", "left").withColumn("y", y).select(*df.columns, "y")


def label_indices(df: DataFrame, vocabulary: DataFrame, column: str = "label_list", key: str = "id") -> DataFrame:
    """Long (id, label_idx) for vocabularies of any size."""
    rows = df.select(key, F.explode(F.array_distinct(column)).alias("label"))
    return lookup_join(rows, vocabulary, "label").select(key, "label_idx")


def rarest_label(df: DataFrame, column: str = "label_list", key: str = "id", limit: int = IN_ROW_LIMIT) -> DataFrame:
    """Row's least frequent label, by name on ties, as ``stratum``."""
    frequency = settle(label_frequency(df, column))
    by_rarity = bounded_values(frequency.orderBy("frequency", "label"), "label", limit)
    if by_rarity is not None:
        rank_order = literal_array(by_rarity)
        return df.withColumn("stratum", F.get(F.array_intersect(rank_order, column), F.lit(0)))
    rows = df.select(key, F.explode(column).alias("label"))
    ranked = skew_join(rows, frequency, "label", "left")
    rarest = ranked.groupBy(key).agg(F.min(F.struct("frequency", "label"))["label"].alias("stratum"))
    return df.join(rarest, key, "left")


def _rows_below(share: float, size: Column) -> Column:
    """How many of ``size`` ordered rows have their mid-rank share ``(r - 0.5) / size`` below."""
    near = F.floor(F.lit(share) * size + 0.5)
    tries = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: near + d)
    fitting = F.filter(tries, lambda r: (r >= 1) & (r <= size) & ((r - 0.5) / size < share))
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")


def stratum_cuts(slim: DataFrame, shares: dict[str, float], key: str, hex_digits: int, ranks: DataFrame | None = None) -> DataFrame:
    """(stratum, one cut per share): the draw of the last row inside each share, '' if none. With ``ranks``
    (stratum, a row number for each name) the cuts are at those rows instead.

    Rows are counted per (stratum, first hash digits); only the buckets in which a cut falls, one
    per stratum and share, are ordered. A stratum with a third of all rows is thus never sorted
    as a whole: a bucket holds one row in 16**hex_digits.
    """
    cells = settle(slim.groupBy("stratum", F.substring("_draw", 1, hex_digits).alias("_bucket")).count())
    in_stratum = Window.partitionBy("stratum")
    earlier = in_stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.select(
        "stratum",
        "_bucket",
        "count",
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"),
        F.sum("count").over(in_stratum).alias("_size"),
    )
    if ranks is not None:
        counted = lookup_join(counted, ranks, "stratum")
    rank = lambda n, s: _rows_below(s, F.col("_size")) if ranks is None else F.col(n)
    targets = F.array(*[F.struct(F.lit(n).alias("name"), rank(n, s).alias("rank")) for n, s in shares.items()])
    wanted = counted.select("stratum", "_bucket", "count", "_before", F.inline(targets))
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("count"))
    cut_cells = settle(wanted.filter(inside).select("stratum", "_bucket", "_before", "name", "rank"))

    bucketed = slim.withColumn("_bucket", F.substring("_draw", 1, hex_digits))
    cut_keys = cut_cells.select("stratum", "_bucket").distinct()
    near = bucketed.join(cut_keys, ["stratum", "_bucket"], "left_semi")
    place = F.row_number().over(Window.partitionBy("stratum", "_bucket").orderBy("_draw", key))
    found = (
        near.withColumn("_place", place)
        .join(cut_cells, ["stratum", "_bucket"])
        .filter(F.col("_before") + F.col("_place") == F.col("rank"))
    )
    cuts = found.groupBy("stratum").pivot("name", list(shares)).agg(F.first("_draw"))
    strata = cells.select("stratum").distinct().join(cuts, "stratum", "left")
    return strata.select("stratum", *[F.coalesce(n, F.lit("")).alias(n) for n in shares])


def stratified_split(
    df: DataFrame,
    column: str = "label_list",
    key: str = "id",
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    hex_digits: int = 3,
) -> DataFrame:
    """Adds ``split``: a row's place in its stratum, in hash order, decides.

    Strata under six rows are pooled. What leaves the rows are ids and strata only: two cut
    values per stratum come back, and each row compares its own hash with them. Texts are not
    shuffled.
    """
    labelled = rarest_label(df.filter(F.size(column) > 0), column, key)
    labelled = labelled.withColumn("_draw", draw_key(seed, F.col(key)))
    slim = settle(labelled.select(key, "stratum", "_draw"))
    small = settle(slim.groupBy("stratum").count().filter(F.col("count") < SMALL_STRATUM).select("stratum"))
    marked = small.withColumn("_small", F.lit(True))

    def pool(rows: DataFrame) -> DataFrame:
        name = F.when(F.col("_small"), F.lit(POOLED)).otherwise(F.col("stratum"))
        return lookup_join(rows, marked, "stratum", "left").withColumn("stratum", name).drop("_small")

    shares = {"_test": test_share, "_val": round(test_share + validation_share, 12)}
    cuts = settle(stratum_cuts(pool(slim), shares, key, hex_digits))
    compared = lookup_join(pool(labelled), cuts, "stratum")
    split = F.when(F.col("_draw") <= F.col("_test"), "test").when(F.col("_draw") <= F.col("_val"), "val")
    return compared.withColumn("split", split.otherwise("train")).select(*df.columns, "split")


def label_pairs(df: DataFrame, column: str = "label_list", key: str = "id") -> DataFrame:
    """Long (key, stratum): every pair of a row's labels, each label with itself included. Nulls are no labels.
    Pairs are generated row by row, never held as one array."""
    labels = df.select(key, F.array_sort(F.array_distinct(F.array_compact(column))).alias("_all"))
    first = labels.select(key, "_all", F.posexplode("_all").alias("_at", "_a"))
    both = first.select(key, "_a", F.explode(F.slice("_all", F.col("_at") + 1, F.size("_all"))).alias("_b"))
    return both.select(key, F.concat(F.length("_a").cast("string"), F.lit(":"), "_a", "_b").alias("stratum"))


def combination_split(
    df: DataFrame,
    column: str = "label_list",
    key: str = "id",
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    hex_digits: int = 3,
) -> DataFrame:
    """Adds ``split`` so that pairs of labels keep their shares, not labels alone (second order).

    A row belongs to its rarest pair, by text on ties. Pairs are dealt out in rounds, from rare to
    frequent, a round for each factor of four in frequency, so 16 rounds for four thousand million rows. When
    a pair's turn comes, the rows that hold it and went out with a rarer pair count against its quotas; its own rows,
    in hash order, fill what is left of them. Fractions are rounded up with their own chance by one draw for each pair,
    so the shares of many rare pairs add up to those of the whole. A pair all of whose rows are its own is within one row of
    its share; rows that go out with other pairs of the same round vary like a draw by lot of as many rows.

    Each round reads its own rows' pairs and writes two cut values a pair and the counts that later pairs need;
    cuts come from counted cells (:func:`stratum_cuts`), so a pair in a third of all rows is never sorted as a
    whole. Texts move once, in the last join by ``key``, which is unique. Rows without a label (null list, empty list,
    nulls only) are left out.
    """
    pairs = settle(label_pairs(df, column, key))
    frequency = settle(pairs.groupBy("stratum").agg(F.count("*").alias("_n")))
    rarest = F.min(F.struct("_n", "stratum")).over(Window.partitionBy(key))
    tier = lambda n: F.floor((F.length(F.bin(n)) - 1) / 2).cast("int")
    rated = lookup_join(pairs, frequency, "stratum").withColumn("_rarest", rarest)
    rated = rated.select(key, "stratum", tier("_n").alias("_turn"), F.col("_rarest.stratum").alias("_own"), tier("_rarest._n").alias("_round"))
    # Sorted by round, so that a round skips the row groups of the others.
    members = settle(rated.withColumn("_draw", draw_key(seed, F.col(key))).sortWithinPartitions("_round"))
    below, chance = round(test_share + validation_share, 12), draw_unit(seed, "pair", F.col("stratum"))
    shares = {"_test": test_share, "_val": below}
    counts: DataFrame | None = None
    placed: DataFrame | None = None
    for at in sorted(r[0] for r in members.select("_round").distinct().collect()):
        now = members.filter(F.col("_round") == at)
        slim = now.filter("stratum = _own").select(key, "stratum", "_draw")
        ranks = slim.groupBy("stratum").agg(F.count("*").alias("_m"))
        if counts is None:
            ranks = ranks.select("*", *[F.lit(0).cast("long").alias(c) for c in ("_out", "_out_test", "_out_val")])
        else:
            out = counts.filter(F.col("_turn") == at).groupBy("stratum").agg(*[F.sum(c).alias(c) for c in ("_out", "_out_test", "_out_val")])
            ranks = ranks.join(out, "stratum", "left").fillna(0, ["_out", "_out_test", "_out_val"])
        all_rows = F.col("_out") + F.col("_m")
        within = lambda share, gone: F.least(F.col("_m"), F.floor(F.lit(share) * all_rows - gone + chance)).cast("long")
        ranks = ranks.withColumn("_test", F.greatest(F.lit(0).cast("long"), within(test_share, F.col("_out_test"))))
        ranks = ranks.withColumn("_val", F.greatest("_test", within(below, F.col("_out_test") + F.col("_out_val"))))
        cuts = settle(stratum_cuts(slim, shares, key, hex_digits, settle(ranks.select("stratum", "_test", "_val"))))
        compared = lookup_join(now, cuts.withColumnRenamed("stratum", "_own"), "_own")
        split = F.when(F.col("_draw") <= F.col("_test"), "test").when(F.col("_draw") <= F.col("_val"), "val").otherwise("train")
        dealt = settle(compared.select(key, "stratum", "_own", "_turn", split.alias("split")))
        later = dealt.filter(F.col("_turn") > at).groupBy("stratum", "_turn")
        is_in = lambda name: F.sum((F.col("split") == name).cast("long"))
        told = settle(later.agg(F.count("*").alias("_out"), is_in("test").alias("_out_test"), is_in("val").alias("_out_val")))
        own = dealt.filter("stratum = _own").select(key, "split")
        counts = told if counts is None else counts.unionByName(told)
        placed = own if placed is None else placed.unionByName(own)
    if placed is None:
        return df.limit(0).withColumn("split", F.lit(None).cast("string"))
    return df.join(placed, key).select(*df.columns, "split")


def split_report(df: DataFrame, column: str = "label_list") -> DataFrame:
    """Rows per split, and per split and label with the share of the label's rows."""
    totals = df.groupBy("split").agg(F.count("*").alias("n_rows")).select("split", F.lit("*").alias("label"), "n_rows")
    pairs = df.select("split", F.explode(column).alias("label"))
    counted = pairs.groupBy("split", "label").agg(F.count("*").alias("n_rows"))
    per_label = totals.unionByName(counted)
    overall = per_label.groupBy("label").agg(F.sum("n_rows").alias("_all"))
    return per_label.join(overall, "label").select(
        "split", "label", "n_rows", (F.col("n_rows") / F.col("_all")).alias("share")
    )


def encode_splits(df: DataFrame, column: str = "label_list") -> DataFrame:
    """Vocabulary from the training rows only, applied to all rows."""
    vocabulary = label_vocabulary(require_rows(df.filter(F.col("split") == "train"), "training split"), column)
    return binarize(df, vocabulary, column)


def kfold(df: DataFrame, folds: int = 3, key: str = "id") -> DataFrame:
    """Consecutive blocks in id order; the first ``n % folds`` blocks are one row longer.

    Only ids are sorted. The first id of each block comes back, and rows compare their own id
    with those few values.
    """
    placed = settle(with_position(df.select(key), key, "_at"))
    size, longer = divmod(placed.count(), folds)
    starts = [i * size + min(i, longer) for i in range(1, folds)]
    firsts = [r[0] for r in placed.filter(F.col("_at").isin(starts)).orderBy("_at").collect()]
    fold = F.lit(0)
    for first in firsts:
        fold = fold + (F.col(key) >= F.lit(first)).cast("int")
    return df.withColumn("fold", fold)


def hashed_folds(df: DataFrame, folds: int = 3, key: str = "id", seed: int = SEED) -> DataFrame:
    """Folds of nearly equal size without a sort or a shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))
