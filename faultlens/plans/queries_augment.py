"""Augmentation queries. The synonym table is made from the documents' own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import augment as E
from faultlens.operators import features as X
from faultlens.operators import split as D
from faultlens.operators.sizing import drop_settled, settle, settle_instead
from faultlens.plans import stand_ins as S
from faultlens.plans.queries_features import TOKENS_SQL
from faultlens.plans.registry import cte, query, r6

PAIRS = ["word || '_form'", "'other ' || word", "upper(word)"]
DRAW = "('0x' || substr(md5({}), 1, 15))::BIGINT"

cte("prepared_words", "SELECT DISTINCT unnest(string_split(processed_text, ' ')) AS word FROM prepared")
cte(
    "synonym_pairs",
    " UNION ALL ".join(f"SELECT word, {p} AS synonym FROM prepared_words WHERE word <> ''" for p in PAIRS),
)
cte(
    "clean_synonyms",
    "SELECT DISTINCT word, replace(synonym, '_', ' ') AS synonym FROM synonym_pairs"
    " WHERE lower(replace(synonym, '_', ' ')) <> lower(word)",
)
cte("rare_doc_labels", "SELECT label FROM doc_frequency WHERE frequency < 25")
cte(
    "rare_docs",
    "SELECT * FROM prepared WHERE id IN (SELECT id FROM doc_pairs WHERE label IN (SELECT label FROM rare_doc_labels))",
)


cte("train_docs", "SELECT prepared.* FROM prepared JOIN split_rows USING (id) WHERE split = 'train'")
cte("train_pairs", "SELECT id, unnest(label_list) AS label FROM train_docs")
cte("rare_train_labels", "SELECT label FROM train_pairs GROUP BY label HAVING count(*) < 25")
cte("rare_train_docs", "SELECT * FROM train_docs WHERE id IN (SELECT id FROM train_pairs WHERE label IN (SELECT label FROM rare_train_labels))")


def copies_sql(source: str, factor: int) -> str:
    return f"SELECT *, unnest(range(1, {factor + 1}))::INTEGER AS replica FROM {source}"


def synonym_sql(source: str) -> str:
    """Two draws without repetition, then two replacements in turn."""
    first = DRAW.format("'42|' || id || '|' || replica || '|0'")
    second = DRAW.format("'42|' || id || '|' || replica || '|1'")
    words = f"SELECT *, list_filter(string_split(processed_text, ' '), lambda x: x <> '') AS w FROM ({source})"
    draws = (
        f"SELECT *, CASE WHEN len(w) > 0 THEN {first} % len(w) + 1 END AS p1,"
        f" CASE WHEN len(w) > 1 THEN {second} % (len(w) - 1) + 1 END AS c2 FROM ({words})"
    )
    drawn = f"SELECT *, w[p1] AS w1, w[c2 + CASE WHEN c2 >= p1 THEN 1 ELSE 0 END] AS w2 FROM ({draws})"
    pick = (
        "(SELECT arg_min(s.synonym, md5('42|' || d.id || '|' || d.replica || '|' || s.word || '|' || s.synonym))"
        " FROM clean_synonyms s WHERE s.word = d.{})"
    )
    found = f"SELECT d.*, {pick.format('w1')} AS s1, {pick.format('w2')} AS s2 FROM ({drawn}) d"
    once = "list_transform(w, lambda x: CASE WHEN s1 IS NOT NULL AND x = w1 THEN s1 ELSE x END)"
    twice = f"list_transform({once}, lambda x: CASE WHEN s2 IS NOT NULL AND x = w2 THEN s2 ELSE x END)"
    return f"SELECT id, replica, array_to_string({twice}, ' ') AS processed_text FROM ({found})"


def swap_sql(source: str) -> str:
    out = f"SELECT id, replica, list_filter(string_split(processed_text, ' '), lambda x: x <> '') AS w FROM ({source})"
    for j in (0, 1):
        a = DRAW.format(f"'42|' || id || '|' || replica || '|{j}|a'")
        b = DRAW.format(f"'42|' || id || '|' || replica || '|{j}|b'")
        drawn = f"SELECT *, {a} % len(w) + 1 AS p, CASE WHEN len(w) > 1 THEN {b} % (len(w) - 1) + 1 ELSE 1 END AS c FROM ({out})"
        placed = f"SELECT *, CASE WHEN c >= p THEN c + 1 ELSE c END AS q FROM ({drawn})"
        swapped = "list_transform(w, lambda x, i: CASE WHEN len(w) < 2 THEN x WHEN i = p THEN w[q] WHEN i = q THEN w[p] ELSE x END)"
        out = f"SELECT id, replica, {swapped} AS w FROM ({placed})"
    return f"SELECT id, replica, array_to_string(w, ' ') AS processed_text FROM ({out})"


ORIGINAL = "SELECT id, 0 AS replica, processed_text FROM prepared"
FULL = {"sr": synonym_sql(copies_sql("prepared", 1)), "rs": swap_sql(copies_sql("prepared", 1))}
RARE = {"sr": synonym_sql(copies_sql("rare_docs", 2)), "rs": swap_sql(copies_sql("rare_docs", 2))}


def prepared(spark, folder):
    return settle_instead(S.prepared_documents(spark, folder))


def synonym_table(docs):
    words = docs.select(F.explode(F.array_distinct(F.split("processed_text", " "))).alias("word")).distinct().filter("word <> ''")
    return words.select("word", F.explode(F.array(*[F.expr(p) for p in PAIRS])).alias("synonym"))


def shown(df):
    return df.select("id", "replica", "processed_text")


@query(
    "rare_label_rows",
    "SELECT id FROM doc_labels WHERE id IN (SELECT id FROM doc_pairs WHERE label IN (SELECT label FROM rare_doc_labels))",
)
def rare_label_rows(spark, folder):
    return E.rows_with_rare_labels(S.labelled_documents(spark, folder)).select("id")


@query(
    "synonym_lookup",
    "SELECT word, string_agg(synonym, '|' ORDER BY synonym) AS synonyms FROM clean_synonyms GROUP BY 1",
)
def synonym_lookup(spark, folder):
    found = E.synonyms(synonym_table(S.cleaned_documents(spark, folder)))
    return found.select("word", F.array_join("synonyms", "|").alias("synonyms"))


@query("synonym_replacement", FULL["sr"])
def synonym_replacement(spark, folder):
    docs = settle(S.cleaned_documents(spark, folder))
    copies = docs.withColumn("replica", F.lit(1))
    return shown(E.synonym_replacement(copies, E.synonyms(synonym_table(docs))))


@query("random_swap", FULL["rs"])
def random_swap(spark, folder):
    return shown(E.random_swap(S.cleaned_documents(spark, folder).withColumn("replica", F.lit(1))))


@query("augment_full", f"{ORIGINAL} UNION ALL {FULL['rs']}")
def augment_full(spark, folder):
    return shown(E.augment_full(prepared(spark, folder), "rs"))


@query("augment_underrep", f"{ORIGINAL} UNION ALL {RARE['sr']}")
def augment_underrep(spark, folder):
    docs = prepared(spark, folder)
    return shown(E.augment_underrepresented(docs, "sr", 2, 25, E.synonyms(synonym_table(docs))))


TRAIN = "SELECT id, 0 AS replica, processed_text FROM train_docs"
CHANGED = {
    "SR": synonym_sql(copies_sql("train_docs", 1)),
    "RS": swap_sql(copies_sql("train_docs", 1)),
    "SR_underrep": synonym_sql(copies_sql("rare_train_docs", 2)),
    "RS_underrep": swap_sql(copies_sql("rare_train_docs", 2)),
}
VARIANTS = (
    f"SELECT 'OG' AS variant, * FROM ({TRAIN}) UNION ALL "
    + " UNION ALL ".join(f"SELECT '{name}' AS variant, * FROM ({TRAIN} UNION ALL {text})" for name, text in CHANGED.items())
)
ROW_ID = "id || '|' || variant || '|' || replica"


def variants(spark, folder):
    """The five training sets of the training rows."""
    parts = settle_instead(D.stratified_split(prepared(spark, folder)))
    train = parts.filter(F.col("split") == "train").drop("split")
    # Synonyms come from the corpus, as a lexicon would; the rows come from the training split.
    return E.training_variants(train, E.synonyms(synonym_table(parts)))


cte("variant_rows", f"SELECT {ROW_ID} AS row_id, * FROM ({VARIANTS})")
cte("variant_labels", "SELECT v.variant, v.row_id, label_list FROM variant_rows v JOIN train_docs USING (id)")
cte(
    "variant_vocabularies",
    "SELECT variant, list(label ORDER BY label) AS names FROM"
    " (SELECT DISTINCT variant, unnest(label_list) AS label FROM variant_labels) GROUP BY variant",
)
cte("variant_sizes", "SELECT variant, count(*) AS n FROM variant_rows GROUP BY variant")
cte("variant_terms", f"SELECT variant, row_id, unnest({TOKENS_SQL}) AS term FROM variant_rows")
cte("variant_frequency", "SELECT variant, term, count(DISTINCT row_id) AS d FROM variant_terms GROUP BY ALL")
cte(
    "variant_weights",
    "SELECT row_id, term, count(*) * any_value(ln((1.0 + n)::DOUBLE / (1.0 + d)::DOUBLE) + 1.0) AS w FROM variant_terms"
    " JOIN variant_frequency USING (variant, term) JOIN variant_sizes USING (variant) WHERE d >= 2 GROUP BY row_id, term",
)


@query("training_variants", "SELECT row_id, variant, id, replica, processed_text FROM variant_rows")
def training_variants(spark, folder):
    return variants(spark, folder).select("row_id", "variant", "id", "replica", "processed_text")


@query(
    "encode_variants",
    "SELECT row_id, array_to_string(list_transform(names, lambda x: list_contains(label_list, x)::INTEGER), '') AS y"
    " FROM variant_labels JOIN variant_vocabularies USING (variant)",
)
def encode_variants(spark, folder):
    # Every variant is read twice; what the labels need is written, not the texts.
    encoded = E.encode_variants(settle(variants(spark, folder).select("row_id", "variant", "label_list")))
    return encoded.select("row_id", F.array_join(F.transform("y", lambda v: v.cast("string")), "").alias("y"))


@query(
    "tfidf_variants",
    f"SELECT row_id, count(*) AS n_terms, {r6('sum(w) / sqrt(sum(w * w))')} AS weight FROM variant_weights GROUP BY row_id",
)
def tfidf_variants(spark, folder):
    """Each variant has its own vocabulary and weights; a copy is a row of its own.

    The unchanged rows are the same in all variants and are written once. One variant after the other is brought down to its
    sums, and what was written for it alone is removed."""
    rows = X.with_terms(variants(spark, folder)).select("variant", "id", "replica", "row_id", "terms")
    same = settle(rows.filter(F.col("variant") == "OG").select("id", "terms"))
    out = None
    for name in E.VARIANTS:
        copies = settle(rows.filter((F.col("variant") == name) & (F.col("replica") > 0)).select("row_id", "terms"))
        own = same.select(E.row_id("id", F.lit(name), F.lit(0)).alias("row_id"), "terms").unionByName(copies)
        weights = settle(X.idf(X.vocabulary(X.term_stats(own), 2), own.count()))
        cells = X.tfidf(own, weights, key="row_id")
        sums = settle_instead(cells.groupBy("row_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("w")), keep=same)
        drop_settled(copies)  # a long vocabulary's weights are not read from it any more
        out = sums if out is None else out.unionByName(sums)
    return out.select("row_id", "n_terms", F.expr(r6("w")).alias("weight"))
