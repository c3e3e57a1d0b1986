"""TF-IDF, stored or computed embeddings, and scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from faultlens.functions import text as T
from faultlens.operators.batches import SLICE_VALUES, distinct, list_sizes, list_slices
from faultlens.operators.sizing import has_at_most, lookup_join, settle, with_position

DRIVER_TERMS = 500_000  # terms of a vocabulary that may be held by the driver and each executor


def with_terms(df: DataFrame, text: str = "processed_text", low: int = 1, high: int = 1) -> DataFrame:
    return df.withColumn("terms", T.ngrams(T.word_tokens(F.col(text)), low, high))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(term, other columns..., doc_freq, total) of rows whose first column is their list of terms."""
    lists, groups = batch.column(0), batch.columns[1:]
    held = lists.flatten().cast(pa.string()).dictionary_encode()
    row = np.repeat(np.arange(len(lists)), list_sizes(lists))
    code = pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, code = row[code >= 0], code[code >= 0]
    group = np.zeros(len(lists), np.int64)
    for column in groups:
        own = column.dictionary_encode(null_encoding="encode")
        group = np.unique(group * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    n = max(1, len(held.dictionary))
    # One cell per (row, term), however often the term occurs in the row.
    cell = distinct(row * n + code)
    keys, total = np.unique(group[row] * n + code, return_counts=True)
    doc_freq = np.unique(group[cell // n] * n + cell % n, return_counts=True)[1]
    of_group, term = np.divmod(keys, n)
    columns = [held.dictionary.take(pa.array(term)), *[c.take(pa.array(first[of_group])) for c in groups]]
    columns += [pa.array(doc_freq.astype(np.int64)), pa.array(total.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["term", *batch.schema.names[1:], "doc_freq", "total"])


def term_stats(df: DataFrame, terms: str = "terms", by: list[str] | None = None, at_once: int = SLICE_VALUES) -> DataFrame:
    """Document frequency and total count of each term in one shuffle.

    Tasks count pieces of up to ``at_once`` terms in arrays, then comes a map-side sum, so the shuffle carries one row
    per term and task, however often a term occurs. A null is no term.
    """
    by = by or []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in list_slices(batch.column(0), at_once):
                yield _counted(batch.slice(start, stop - start))

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    counted = df.select(F.col(terms).alias("_terms"), *by).mapInArrow(count, f"term string, {kinds}doc_freq long, total long")
    return counted.groupBy("term", *by).agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total").alias("total"))


def vocabulary(stats: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` rows; of these the ``max_features`` most frequent, by term on ties."""
    kept = stats.filter(F.col("doc_freq") >= min_df)
    return kept if max_features is None else kept.orderBy(F.desc("total"), "term").limit(max_features)


def indexed_vocabulary(vocab: DataFrame) -> DataFrame:
    """Vocabulary with its column number, in term order."""
    # Written first: the range partitioning samples its input, which would count all terms again.
    return with_position(settle(vocab), "term", "term_idx")


def idf(vocab: DataFrame, n_rows: int) -> DataFrame:
    weight = F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("doc_freq"))) + 1.0
    return vocab.withColumn("idf", weight)


def tfidf(df: DataFrame, weights: DataFrame, key: str = "id", terms: str = "terms", limit: int = DRIVER_TERMS) -> DataFrame:
    """Long (id, term, weight), each row scaled to length one; rows that share an id stay apart.

    ``weights`` is (term, idf). A vocabulary of up to ``limit`` terms is sent, and no row moves; with a larger
    one blocks of rows are sent the weights of their terms. Rows without a known term have no entries.
    """
    if has_at_most(weights, limit):
        vectors, names = tfidf_vectors(df, weights, terms, limit)
        cells = vectors.select(key, F.inline(F.arrays_zip("features.indices", "features.values")).alias("_at", "weight"))
        if not names:
            return cells.select(key, F.lit("").alias("term"), "weight")
        shared = df.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))

        @F.arrow_udf("string")
        def name(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for at in batches:
                yield pc.take(shared.value, at)

        return cells.select(key, name("_at").alias("term"), "weight")
    return _long_tfidf(df, weights, key, terms)


def _packed(key: str, at_once: int):
    """Rows to blocks that hold each of their different terms once: a row of the result is a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop in list_slices(batch.column(1), at_once):
                keys, lists = (c.slice(start, stop - start) for c in batch.columns)
                held = lists.flatten().cast(pa.string()).dictionary_encode()
                row = np.repeat(np.arange(len(lists)), list_sizes(lists))
                code = pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(1, len(held.dictionary))
                cell, count = np.unique(row[code >= 0] * n + code[code >= 0], return_counts=True)
                size = np.bincount(cell // n, minlength=len(lists))
                listed = [keys, held.dictionary, *(pa.array(v.astype(np.int32)) for v in (size, cell % n, count))]
                arrays = [pa.array([part << 33 | number], pa.int64())]
                arrays += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in listed]
                yield pa.RecordBatch.from_arrays(arrays, ["_block", key, "_names", "_size", "_cell", "_n"])
                number += 1

    return pack


def _long_tfidf(df: DataFrame, weights: DataFrame, key: str, terms: str, at_once: int = SLICE_VALUES) -> DataFrame:
    """(key, term, weight) for a vocabulary of any size.

    Rows are packed into blocks of up to ``at_once`` terms. What meets the vocabulary is the different terms of
    each block, and a block is sent the weights of its own terms once, so no row is made for each (row, term) on the way.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"_block long, `{key}` array<{kind}>, _names array<string>, _size array<int>, _cell array<int>, _n array<int>"
    # Written, as blocks are read twice and their numbers have to stay.
    blocks = settle(df.select(key, F.col(terms).alias("_terms")).mapInArrow(_packed(key, at_once), schema))
    needs = blocks.select(F.col("_block").alias("_of"), F.posexplode("_names").alias("_at", "term"))
    known = lookup_join(needs, weights.select("term", "idf"), "term").select("_of", "_at", "idf")

    def weigh(block: pa.Table, known: pa.Table) -> pa.Table:
        out = {key: [], "term": [], "weight": []}
        for packed in block.to_batches():
            for i in range(packed.num_rows):
                keys, names, *rest = (packed.column(c).slice(i, 1).flatten() for c in (key, "_names", "_size", "_cell", "_n"))
                size, at, n = (v.to_numpy(zero_copy_only=False) for v in rest)
                idf_of = np.full(len(names), np.nan)
                idf_of[known.column("_at").to_numpy()] = known.column("idf").to_numpy()
                value = n * idf_of[at]
                row = np.repeat(np.arange(len(size)), size)
                seen = ~np.isnan(value)
                row, at, value = row[seen], at[seen], value[seen]
                norm = np.sqrt(np.bincount(row, value * value, minlength=len(size)))
                out[key].append(keys.take(pa.array(row)))
                out["term"].append(names.take(pa.array(at)))
                out["weight"].append(pa.array(value / norm[row]))
        return pa.table({name: pa.chunked_array(parts) for name, parts in out.items()})

    return blocks.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(weigh, f"`{key}` {kind}, term string, weight double")


def tfidf_vectors(
    df: DataFrame, weights: DataFrame, terms: str = "terms", limit: int = DRIVER_TERMS
) -> tuple[DataFrame, list[str]]:
    """Adds ``features`` as struct<indices, values>, without a shuffle, for vocabularies that fit.

    Returns the table and the terms in column order. A vocabulary over ``limit`` terms goes
    through :func:`tfidf` and :func:`indexed_vocabulary` instead.
    """
    rows = weights.select("term", "idf").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("vocabulary too large for vectors; use the long form from tfidf()")
    held = sorted(((r["term"], r["idf"]) for r in rows), key=lambda r: r[0])
    names = [term for term, _ in held]
    if not names:
        empty = F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
        return df.withColumn("features", empty), names
    shared = df.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), np.array([w for _, w in held])))

    @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, idf_of = shared.value
        for lists in batches:
            flat = lists.flatten().cast(pa.string())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
            # One cell per (row, term); the cell number orders cells by row, then by term.
            cells, count = np.unique(row[at >= 0] * len(idf_of) + at[at >= 0], return_counts=True)
            row, at = np.divmod(cells, len(idf_of))
            value = count * idf_of[at]
            norm = np.sqrt(np.bincount(row, value * value, minlength=len(sizes)))
            ends = np.cumsum(np.bincount(row, minlength=len(sizes)))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value / norm[row])),
                ],
                ["indices", "values"],
            )

    return df.withColumn("features", weigh(F.col(terms))), names


def tfidf_ml_vectors(df: DataFrame, weights: DataFrame, terms: str = "terms", out: str = "features"):
    """TF-IDF as sparse MLlib vectors: JVM only, for the MLlib trainers."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = weights.select("term", "idf").limit(DRIVER_TERMS + 1).collect()
    if len(rows) > DRIVER_TERMS:
        raise ValueError("vocabulary too large for vectors; use the long form from tfidf()")
    held = sorted((r["term"], r["idf"]) for r in rows)
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in held], terms, "_counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in held]), inputCol="_counts", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=out)
    vectors = unit.transform(scale.transform(counter.transform(df)))
    return vectors.drop("_counts", "_weighted"), [t for t, _ in held]


Encoder = Callable[[list[str]], np.ndarray]


def by_length(encoder: Encoder, texts: list[str], batch: int) -> np.ndarray:
    """The encoder's vectors in the order of ``texts``; it is asked for texts of like length together."""
    order = np.argsort([len(t) for t in texts], kind="stable")
    parts = [order[i : i + batch] for i in range(0, len(order), batch)]
    vectors = np.concatenate([np.asarray(encoder([texts[i] for i in part]), np.float32) for part in parts])
    out = np.empty_like(vectors)
    out[order] = vectors
    return out


def embed(df: DataFrame, load: Callable[[], Encoder], text: str = "processed_text", batch: int = 64, rows: int = 1024) -> DataFrame:
    """Dense vector per text from any batch encoder; null text is empty.

    ``load`` makes the encoder: it runs once in each Python worker, so that a model is read there and never
    travels with the plan. Of every ``rows`` texts those of like length share a batch, which keeps padding short."""

    def make():
        encoder = load()
        return lambda texts: by_length(encoder, texts.tolist(), batch)

    encode = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=rows)
    return df.withColumn("embedding", encode(F.coalesce(F.col(text), F.lit(""))))


def fit_scaler(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: mean and population deviation per dimension, zero deviation read as one.

    One pass with a vector summary: no explode, no aggregate per dimension.
    """
    vector = array_to_vector(F.col(column).cast("array<double>"))
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s"))
    shrink = (F.col("s.count") - 1) / F.col("s.count")
    deviation = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * shrink))
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(deviation, lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)).alias("std"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, column: str = "embedding") -> DataFrame:
    """``(x - mean) / std`` as float. The one-row scaler becomes two literals."""
    row = scaler.first()
    mean, std = F.lit(list(row["mean"])), F.lit(list(row["std"]))
    centred = F.zip_with(F.col(column).cast("array<double>"), mean, lambda x, m: x - m)
    return df.withColumn(column, F.zip_with(centred, std, lambda x, s: (x / s).cast("float")))


def cut_vocabularies(df: DataFrame, low: int, high: int, min_dfs, sizes) -> dict[tuple, DataFrame]:
    """All (min_df, max_features) cuts of one n-gram range from a single count of the terms."""
    stats = settle(term_stats(with_terms(df, low=low, high=high)))
    return {(m, s): vocabulary(stats, m, s) for m in min_dfs for s in sizes}
