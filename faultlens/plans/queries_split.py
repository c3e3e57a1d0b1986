"""Split and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import split as D
from faultlens.plans import stand_ins as S
from faultlens.plans.registry import cte, query, r6

cte("doc_pairs", "SELECT id, unnest(label_list) AS label FROM doc_labels")
cte("doc_frequency", "SELECT label, count(*) AS frequency FROM doc_pairs GROUP BY 1")
cte(
    "strata",
    "SELECT id, label AS stratum FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY frequency, label) AS n"
    " FROM doc_pairs JOIN doc_frequency USING (label)) WHERE n = 1",
)
cte(
    "pooled_strata",
    "SELECT id, CASE WHEN count(*) OVER (PARTITION BY stratum) < 6 THEN '(pooled)' ELSE stratum END AS stratum FROM strata",
)
cte(
    "split_rows",
    "SELECT id, CASE WHEN share < CAST(0.1 AS DOUBLE) THEN 'test' WHEN share < CAST(0.3 AS DOUBLE) THEN 'val' ELSE 'train' END AS split"
    " FROM (SELECT id, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || id), id) - 0.5)::DOUBLE"
    " / count(*) OVER (PARTITION BY stratum) AS share FROM pooled_strata)",
)
cte(
    "train_vocab",
    "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM"
    " (SELECT DISTINCT label FROM doc_pairs JOIN split_rows USING (id) WHERE split = 'train')",
)


@query(
    "label_vocabulary",
    "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS label_idx FROM doc_frequency",
)
def label_vocabulary(spark, folder):
    return D.label_vocabulary(S.labelled_documents(spark, folder))


@query(
    "binarize",
    "SELECT id, array_to_string(list_transform((SELECT list(label ORDER BY label) FROM doc_frequency),"
    " lambda x: list_contains(label_list, x)::INTEGER), '') AS y FROM doc_labels",
)
def binarize(spark, folder):
    docs = S.labelled_documents(spark, folder)
    encoded = D.binarize(docs, D.label_vocabulary(docs))
    return encoded.select("id", F.array_join(F.transform("y", lambda v: v.cast("string")), "").alias("y"))


@query(
    "label_indices",
    "SELECT id, label_idx::INTEGER AS label_idx FROM doc_pairs JOIN"
    " (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM doc_frequency) USING (label)",
)
def label_indices(spark, folder):
    docs = S.labelled_documents(spark, folder)
    return D.label_indices(docs, D.label_vocabulary(docs))


@query("stratified_split", "SELECT id, split FROM split_rows")
def stratified_split(spark, folder):
    return D.stratified_split(S.labelled_documents(spark, folder)).select("id", "split")


@query(
    "split_report",
    "SELECT split, label, n_rows, "
    + r6("n_rows / sum(n_rows) OVER (PARTITION BY label)")
    + " AS share FROM (SELECT split, '*' AS label, count(*) AS n_rows FROM split_rows GROUP BY ALL UNION ALL"
    " SELECT split, label, count(*) FROM doc_pairs JOIN split_rows USING (id) GROUP BY ALL)",
)
def split_report(spark, folder):
    report = D.split_report(D.stratified_split(S.labelled_documents(spark, folder)))
    return report.withColumn("share", F.expr(r6("share")))


@query(
    "encode_splits",
    "SELECT id, split, array_to_string(list_transform((SELECT list(label ORDER BY label) FROM train_vocab),"
    " lambda x: list_contains(label_list, x)::INTEGER), '') AS y FROM doc_labels JOIN split_rows USING (id)",
)
def encode_splits(spark, folder):
    encoded = D.encode_splits(D.stratified_split(S.labelled_documents(spark, folder)))
    return encoded.select("id", "split", F.array_join(F.transform("y", lambda v: v.cast("string")), "").alias("y"))


@query("kfold", "SELECT id, (ntile(3) OVER (ORDER BY id) - 1)::INTEGER AS fold FROM doc_labels")
def kfold(spark, folder):
    return D.kfold(S.labelled_documents(spark, folder)).select("id", "fold")


ROUNDS = 12  # frequencies up to 4**12 rows in the SQL; the operator has as many rounds as the data ask for

cte(
    "combos",
    "SELECT DISTINCT x.id, length(x.label) || ':' || x.label || y.label AS stratum FROM doc_pairs x JOIN doc_pairs y"
    " ON x.id = y.id AND x.label <= y.label",
)
cte(
    "combo_rows",
    "SELECT id, stratum, (length(bin(n)) - 1) // 2 AS turn, first_value(stratum) OVER w AS own,"
    " (length(bin(first_value(n) OVER w)) - 1) // 2 AS round FROM combos JOIN"
    " (SELECT stratum, count(*) AS n FROM combos GROUP BY 1) USING (stratum) WINDOW w AS (PARTITION BY id ORDER BY n, stratum)",
)
cte(
    "combo_own",
    "SELECT id, stratum, round, row_number() OVER (PARTITION BY own ORDER BY md5('42|' || id), id) AS place,"
    " count(*) OVER (PARTITION BY own) AS m, ('0x' || substr(md5('42|pair|' || stratum), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS chance"
    " FROM combo_rows WHERE stratum = own",
)
for _at in range(ROUNDS):
    _earlier = " UNION ALL ".join(f"SELECT * FROM combo_dealt_{k}" for k in range(_at)) or "SELECT 0 AS id, '' AS split WHERE false"
    cte(
        f"combo_out_{_at}",
        "SELECT stratum, count(*) AS gone, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split = 'val') AS val"
        f" FROM combo_rows JOIN ({_earlier}) USING (id) WHERE turn = {_at} GROUP BY 1",
    )
    cte(
        f"combo_dealt_{_at}",
        "SELECT id, CASE WHEN place <= t THEN 'test' WHEN place <= greatest(t, v) THEN 'val' ELSE 'train' END AS split FROM"
        " (SELECT id, place, greatest(0, least(m, floor(CAST(0.1 AS DOUBLE) * (coalesce(gone, 0) + m) - coalesce(test, 0) + chance))) AS t,"
        " least(m, floor(CAST(0.3 AS DOUBLE) * (coalesce(gone, 0) + m) - (coalesce(test, 0) + coalesce(val, 0)) + chance)) AS v"
        f" FROM combo_own LEFT JOIN combo_out_{_at} USING (stratum) WHERE round = {_at})",
    )


@query("combination_split", " UNION ALL ".join(f"SELECT id, split FROM combo_dealt_{k}" for k in range(ROUNDS)))
def combination_split(spark, folder):
    return D.combination_split(S.labelled_documents(spark, folder)).select("id", "split")
