"""The subpackage's queries, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (
    bpe,
    chunks,
    decontaminate,
    hard_negatives,
    hpylm,
    langid,
    line_windows,
    multiset_hash,
    nra,
    simhash,
    simple8b,
    tag_paths,
    variants,
)
from faultlens.operators.sizing import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(key: str, n: int) -> Column:
    """CRC32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op1_hpylm")
def op1_hpylm(spark: SparkSession, folder: str) -> DataFrame:
    return hpylm.score_texts(table(spark, folder, "documents"), id_remainder("doc_id", 10) == 0)


@query("op2_simple8b")
def op2_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{shared_folder(spark).rstrip('/')}/faultlens-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    simple8b.write_ids(table(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return simple8b.checksums(simple8b.read_ids(spark, files))


@query("op3_langid")
def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(id_remainder("doc_id", 4) != 2), "text", "lang", F.col("doc_id"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_nra_topk", TOP_SQL)
def op4_nra_topk(spark: SparkSession, folder: str) -> DataFrame:
    return nra.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4, radius=4)


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), places AS (
  SELECT doc_id, l, unnest(range(len(l))) AS p FROM lines
), windows AS (
  SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w FROM places WHERE p + 3 <= len(l)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows
), covered AS (
  SELECT DISTINCT doc_id, p + d AS p FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1
), kept AS (
  SELECT places.doc_id, string_agg(l[places.p + 1], chr(10) ORDER BY places.p) AS text
  FROM places LEFT JOIN covered ON places.doc_id = covered.doc_id AND places.p = covered.p
  WHERE covered.p IS NULL GROUP BY places.doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id
"""


@query("op7_cdc_chunks")
def op7_cdc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, folder, "documents"))


@query("op8_line_windows", LINE_SQL)
def op8_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_windows.remove_repeats(docs, width=3)


@query("op9_tag_paths")
def op9_tag_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tag_paths.extract(table(spark, folder, "pages"))


@query("op10_bpe_replay")
def op10_bpe_replay(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


MINED_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS k FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.row_no, p.k ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored n ON p.row_no = n.row_no
  WHERE p.k <= 5 AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@query("op11_hard_negatives", MINED_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_multiset_hash")
def op12_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.edited(table(spark, folder, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(variants.run_counts(table(spark, folder, "documents"), typo_every=97))
