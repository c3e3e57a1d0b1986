"""The given tables read as tracker data: orders are reports, orders' lines are commit changes,
parts are labelled files, documents are report texts. Each expression is shared with the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.operators import lemmas as C
from faultlens.operators.sizing import lookup_join, settle
from faultlens.plans.registry import cte, table

WORK_ITEM = {
    "bug_id": "o_orderkey",
    "title": "'Order ' || CAST(o_orderkey AS STRING) || ' fails'",
    "priority": "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)",
    "repro_html": "'<style>p{}</style><p>Detailed problem description: <b>' || o_orderpriority || '</b></p> &amp; '"
    " || o_orderstatus || '<!-- x --><br/>total &lt; 5'",
    "item_type": "CASE WHEN o_orderpriority = '5-LOW' THEN 'Task' ELSE 'Bug' END",
    "area_path": "r_name || chr(92) || n_name",
    "state": "CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Active' END",
}
FILE_NAME = "replace(p_brand, '#', '') || CASE WHEN p_size < 10 THEN '/latest/' WHEN p_size < 20 THEN '/Tests/' WHEN p_size < 25 THEN '/TEST/' ELSE '/src/' END || replace(p_name, ' ', '') || CAST(p_partkey AS STRING) || '.cs'"
CHANGE = {
    "commit_id": "CAST(l_orderkey AS STRING)",
    "path_pos": "l_linenumber",
    "path": "CASE l_returnflag WHEN 'A' THEN chr(92) || 'Source' || chr(92) WHEN 'N' THEN '/Source/' ELSE '/SourceTree/' END || "
    + FILE_NAME,
    "object_type": "CASE WHEN l_linestatus = 'O' THEN 'blob' ELSE 'tree' END",
}
FILE_LABEL = {
    "row_no": "p_partkey",
    "file": "CASE WHEN p_type = 'SMALL' THEN upper(replace('/' || "
    + FILE_NAME
    + ", '/', chr(92))) ELSE ' /' || "
    + FILE_NAME
    + " END",
    "label": "CASE WHEN p_brand = 'Brand#1' THEN 'x' WHEN p_brand = 'Brand#2' THEN 'X' WHEN p_brand = 'Brand#3' THEN NULL ELSE p_brand END",
}
FILE_LABEL_AGAIN = {
    "row_no": "p_partkey + CAST(10000000000 AS BIGINT)",
    "file": "lower('/' || " + FILE_NAME + ")",
    "label": "CASE WHEN p_brand = 'Brand#4' THEN NULL ELSE p_type END",
}
COMMIT_URL = "'vstfs:///Git/Commit/p%2Fr%2F' || CAST(o_orderkey AS STRING)"
REVIEW_URL = "'vstfs:///Git/PullRequest/p%2F' || CAST(o_orderkey AS STRING)"
OLDER_URL = "'http://host/Commit/r%2F' || CAST(o_custkey AS STRING)"
URLS = [COMMIT_URL, REVIEW_URL, OLDER_URL, "'http://host/Commit/p%2F'"]

DOC = {
    "id": "doc_id",
    "title": "CASE WHEN lang = 'de' THEN NULL ELSE 'ReportFrom' || source || ' inXMLParser ' || lang END",
    "description": "'Detailed Problem Description: : ' || text || ' Available workarounds: none'",
}
LABEL_PARTS = [
    "'lang-' || lang",
    "source",
    "'size-' || CAST(CAST(floor(n_chars / 4000.0) AS INTEGER) AS STRING)",
    "CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END",
    "CASE WHEN toxic = 1 THEN 'toxic' END",
]


def _select(parts: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in parts.items())


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    fields = [F.expr(text).alias(name) for name, text in WORK_ITEM.items()]
    created = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created")
    return joined.select(*fields, created)


cte(
    "work_items",
    f"SELECT {_select(WORK_ITEM)}, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created FROM orders"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey",
)


def bug_relations(spark: SparkSession, folder: str) -> DataFrame:
    links = F.array(*[F.struct(F.expr(u).alias("url")) for u in URLS])
    none = F.array().cast("array<struct<url:string>>")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("bug_id"), F.when(F.col("o_orderstatus") == "P", none).otherwise(links).alias("relations")
    )


cte(
    "relation_rows",
    " UNION ALL ".join(
        f"SELECT o_orderkey AS bug_id, {i} AS rel_pos, {u} AS url FROM orders WHERE o_orderstatus <> 'P'"
        for i, u in enumerate(URLS)
    ),
)


def commit_changes(spark: SparkSession, folder: str) -> DataFrame:
    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    joined = lookup_join(lines.withColumnRenamed("l_partkey", "p_partkey"), part, "p_partkey").withColumn("l_partkey", F.col("p_partkey"))
    return joined.select(*[F.expr(text).alias(name) for name, text in CHANGE.items()])


cte("commit_changes", f"SELECT {_select(CHANGE)} FROM lineitem JOIN part ON l_partkey = p_partkey")
cte(
    "commit_links",
    "SELECT bug_id, rel_pos, substr(string_split(string_split(url, '/')[-1], '%')[-1], 3) AS commit_id"
    " FROM relation_rows WHERE contains(url, 'Commit')"
    " AND substr(string_split(string_split(url, '/')[-1], '%')[-1], 3) <> ''",
)
REPO_PATH_SQL = (
    "CASE WHEN starts_with(replace(path, chr(92), '/'), '/Source') THEN substr(replace(path, chr(92), '/'), 8)"
    " ELSE replace(path, chr(92), '/') END"
)
cte(
    "bug_paths",
    f"SELECT bug_id, {REPO_PATH_SQL} AS path, min(rel_pos * 1000 + path_pos) AS seen"
    " FROM commit_links JOIN commit_changes USING (commit_id)"
    " WHERE object_type = 'blob' AND NOT contains(path, 'test') AND NOT contains(path, 'Test') GROUP BY 1, 2",
)


def path_labels(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    first = part.select(*[F.expr(text).alias(name) for name, text in FILE_LABEL.items()])
    again = part.filter("p_type = 'ECONOMY'").select(*[F.expr(t).alias(n) for n, t in FILE_LABEL_AGAIN.items()])
    return first.unionByName(again)


cte(
    "path_labels",
    f"SELECT {_select(FILE_LABEL)} FROM part UNION ALL SELECT {_select(FILE_LABEL_AGAIN)} FROM part WHERE p_type = 'ECONOMY'",
)
cte(
    "file_labels",
    "SELECT replace(lower(trim(file)), chr(92), '/') AS file, arg_max_null(label, row_no) AS label"
    " FROM path_labels GROUP BY 1",
)
cte(
    "bug_label_pairs",
    "SELECT DISTINCT bug_id, label FROM bug_paths JOIN file_labels ON lower(trim(path)) = file"
    " WHERE label IS NOT NULL AND lower(label) <> 'x'",
)
cte(
    "labelled",
    "SELECT b.bug_id, coalesce(list(label ORDER BY label) FILTER (label IS NOT NULL), []) AS labels"
    " FROM (SELECT DISTINCT bug_id FROM bug_paths) b LEFT JOIN bug_label_pairs p ON b.bug_id = p.bug_id GROUP BY 1",
)
cte("counted", "SELECT * FROM labelled WHERE len(labels) BETWEEN 1 AND 5")
cte("counted_frequency", "SELECT label, count(*) AS frequency FROM (SELECT unnest(labels) AS label FROM counted) GROUP BY 1")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(*[F.expr(text).alias(name) for name, text in DOC.items()])


cte("doc_texts", f"SELECT {_select(DOC)} FROM documents")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label_list) with two to five labels per document."""
    docs, marks = table(spark, folder, "documents"), table(spark, folder, "labels")
    parts = F.array(*[F.expr(p) for p in LABEL_PARTS])
    joined = docs.drop("text").join(marks, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.filter(parts, lambda x: x.isNotNull()).alias("label_list"))


cte(
    "doc_labels",
    f"SELECT documents.doc_id AS id, list_filter([{', '.join(LABEL_PARTS)}], lambda x: x IS NOT NULL) AS label_list"
    " FROM documents LEFT JOIN labels USING (doc_id)",
)


def combined(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder)
    return texts.select("id", T.combine_text(F.col("title"), F.col("description")).alias("text_input"))


def doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return combined(spark, folder).select("id", T.content_tokens(F.col("text_input")).alias("tokens"))


def corpus_lemmas(tokens: DataFrame) -> DataFrame:
    """Lemma table with the corpus' own words as the lexicon."""
    words = settle(C.distinct_words(tokens))
    return settle(C.noun_lemma_table(words, words))


def cleaned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, processed_text): cleaned text without stop words, words in their lemmas."""
    return C.preprocess_text(combined(spark, folder), corpus_lemmas, keep=["id"])


def prepared_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, processed_text, label_list): the processed text and the labels."""
    return cleaned_documents(spark, folder).join(labelled_documents(spark, folder), "id")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding, label, label_list, y): some rows have no label, some have two."""
    x = table(spark, folder, "embeddings")
    names = F.expr(
        "CASE WHEN embedding[0] > 0.2 THEN CAST(array() AS ARRAY<INT>)"
        " WHEN embedding[1] > 0 THEN array(label, (label + 1) % 10) ELSE array(label) END"
    )
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array_contains("truth", i).cast("int"))
    return x.select(F.col("vec_id").alias("id"), "embedding", "label", names.alias("truth")).withColumn("y", y)


cte(
    "vectors",
    "SELECT vec_id AS id, embedding, label, CASE WHEN embedding[1] > CAST(0.2 AS DOUBLE) THEN CAST([] AS INTEGER[])"
    " WHEN embedding[2] > 0 THEN [label, (label + 1) % 10] ELSE [label] END AS truth FROM embeddings",
)
cte("cells", "SELECT id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM vectors")
cte("scale_stats", "SELECT d, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS s FROM cells GROUP BY d")
cte(
    "scaled_cells",
    "SELECT id, label, d, ((v - m) / s)::FLOAT AS v FROM cells JOIN scale_stats USING (d)",
)
cte(
    "model_cells",
    "SELECT 'raw' AS model, id, label, d, v FROM cells UNION ALL"
    " SELECT 'scaled' AS model, id, label, d, v::DOUBLE AS v FROM scaled_cells",
)
cte("centroids", "SELECT model, label AS label_idx, d, avg(v) AS c FROM model_cells GROUP BY ALL")
cte(
    "score_rows",
    "SELECT model, id, label_idx, round(sum(v * c), 6) AS score FROM model_cells JOIN centroids USING (model, d) GROUP BY ALL",
)
cte(
    "ranked_rows",
    "SELECT s.model, s.id, s.label_idx, s.score, list_contains(truth, s.label_idx)::INTEGER AS y, len(truth) AS n_true,"
    " row_number() OVER (PARTITION BY s.model, s.id ORDER BY score DESC, s.label_idx) AS r"
    " FROM score_rows s JOIN vectors v ON s.id = v.id",
)
cte(
    "row_metrics",
    "SELECT model, id, any_value(n_true) AS n_true, "
    + ", ".join(f"sum(y) FILTER (r <= {k}) AS h{k}" for k in (1, 3, 5, 10))
    + ", coalesce(1.0 / min(r) FILTER (y = 1), 0) AS rr, coalesce(sum(hit_no / r) FILTER (y = 1), 0) AS ap"
    " FROM (SELECT *, sum(y) OVER (PARTITION BY model, id ORDER BY r) AS hit_no FROM ranked_rows) GROUP BY model, id",
)
