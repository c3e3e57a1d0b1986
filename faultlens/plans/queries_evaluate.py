"""Ranking and comparison queries on two scored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import losses as Z
from faultlens.functions import ranking as R
from faultlens.operators import evaluate as G
from faultlens.plans.flagship import model_comparison, model_scores
from faultlens.plans.registry import cte, query, r6

KS = G.RANKING_KS
RECALL = {k: f"coalesce(avg(CASE WHEN n_true > 0 THEN h{k} / n_true END), 0)" for k in KS}
PRECISION = {k: f"avg(h{k} / {k})" for k in KS}
HIT = {k: f"avg((h{k} > 0)::INTEGER)" for k in KS}
MRR = "coalesce(avg(CASE WHEN n_true > 0 THEN rr END), 0)"
MAP = "coalesce(avg(CASE WHEN n_true > 0 THEN ap / n_true END), 0)"


def metrics_sql(ks=KS, precision=True) -> str:
    parts = []
    for k in ks:
        parts.append(f'{r6(RECALL[k])} AS "Recall@{k}"')
        if precision:
            parts.append(f'{r6(PRECISION[k])} AS "Precision@{k}"')
        parts.append(f'{r6(HIT[k])} AS "Top_{k}_Accuracy"')
    return ", ".join([*parts, f'{r6(MRR)} AS "MRR"', f'{r6(MAP)} AS "MAP"'])


def rounded(df):
    return df.select(
        *[F.expr(r6(f"`{c}`")).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def one_metric(name: str, expressions: dict[str, str], columns):
    text = ", ".join(f"{r6(sql)} AS {alias}" for alias, sql in expressions.items())
    query(name, f"SELECT model, {text} FROM row_metrics GROUP BY model")(
        lambda spark, folder: rounded(
            G.with_ranks(model_scores(spark, folder))
            .groupBy("model")
            .agg(*[column.alias(alias) for alias, column in columns().items()])
        )
    )


@query("rank_labels", "SELECT model, id, string_agg(label_idx, ',' ORDER BY r) AS ranked FROM ranked_rows GROUP BY ALL")
def rank_labels(spark, folder):
    ranked = R.rank_labels(F.col("scores"))
    text = F.array_join(F.transform(ranked, lambda i: i.cast("string")), ",")
    return model_scores(spark, folder).select("model", "id", text.alias("ranked"))


@query(
    "top_k",
    "SELECT model, id, string_agg(label_idx, ',' ORDER BY r) AS top FROM ranked_rows WHERE r <= 3 GROUP BY ALL",
)
def top_k(spark, folder):
    first = R.top_k(R.rank_labels(F.col("scores")), 3)
    text = F.array_join(F.transform(first, lambda i: i.cast("string")), ",")
    return model_scores(spark, folder).select("model", "id", text.alias("top"))


one_metric("recall_at_k", {f"recall_{k}": RECALL[k] for k in KS}, lambda: {f"recall_{k}": G.recall_at_k(k) for k in KS})
one_metric(
    "precision_at_k", {f"precision_{k}": PRECISION[k] for k in KS}, lambda: {f"precision_{k}": G.precision_at_k(k) for k in KS}
)
one_metric("top_k_accuracy", {f"top_{k}": HIT[k] for k in KS}, lambda: {f"top_{k}": G.top_k_accuracy(k) for k in KS})
one_metric("mrr", {"mrr": MRR}, lambda: {"mrr": G.mean_reciprocal_rank()})
one_metric("mean_avg_precision", {"map": MAP}, lambda: {"map": G.mean_average_precision()})


@query("ranking_metrics", f"SELECT model, {metrics_sql()} FROM row_metrics GROUP BY model")
def ranking_metrics(spark, folder):
    """From ranked lists; the other metric queries start from the scores."""
    rows = model_scores(spark, folder).withColumn("ranked", R.rank_labels(F.col("scores")))
    return rounded(G.ranking_metrics(rows, ["model"]))


@query("sigmoid", "SELECT model, id, label_idx::INTEGER AS label_idx, round(1.0 / (1.0 + exp(-score)), 6) AS p FROM score_rows")
def sigmoid(spark, folder):
    rows = model_scores(spark, folder).select("model", "id", F.posexplode(Z.sigmoid_scores(F.col("scores"))).alias("label_idx", "p"))
    return rows.withColumn("p", F.round("p", 6))


CUT = 0.3
cte("predicted", f"SELECT *, (score >= CAST({CUT} AS DOUBLE))::INTEGER AS p FROM ranked_rows")


@query("threshold", "SELECT model, id, string_agg(p, '' ORDER BY label_idx) AS predicted FROM predicted GROUP BY ALL")
def threshold(spark, folder):
    rows = G.predicted_labels(model_scores(spark, folder), CUT)
    return rows.select("model", "id", F.array_join(F.transform("predicted", lambda p: p.cast("string")), "").alias("predicted"))


FOCAL = (
    "(CASE WHEN y = 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END)"
    " * pow(1.0 - greatest(exp(-ce), CAST(1e-9 AS DOUBLE)), 2.0) * ce"
)
cte("entropies", "SELECT *, greatest(score, 0.0) - score * y + ln(1.0 + exp(-abs(score))) AS ce FROM ranked_rows")


@query(
    "focal_loss",
    f"SELECT model, {r6('avg(' + FOCAL + ')')} AS mean_loss, round(sum({FOCAL}), 4) AS total_loss FROM entropies GROUP BY model",
)
def focal_loss(spark, folder):
    cells = model_scores(spark, folder).select("model", F.inline(F.arrays_zip("scores", "y")))
    loss = Z.focal_loss(F.col("scores"), F.col("y"))
    sums = cells.groupBy("model").agg(
        Z.reduce_loss(loss, "mean").alias("mean_loss"), F.round(Z.reduce_loss(loss, "sum"), 4).alias("total_loss")
    )
    return sums.withColumn("mean_loss", F.expr(r6("mean_loss")))


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def scores_sql(tp: str, pred: str, true: str) -> str:
    values = (ratio(tp, pred), ratio(tp, true), ratio(f"2.0 * {tp}", f"{pred} + {true}"))
    return ", ".join(f"{v} AS {n}" for v, n in zip(values, ("precision", "recall", "f1")))


cte("zero_predicted", "SELECT *, (score >= 0)::INTEGER AS p FROM ranked_rows")
for _name, _source in (("report", "predicted"), ("zero_report", "zero_predicted")):
    _label = f"(SELECT *, {scores_sql('tp', 'pred', 'true_n')} FROM (SELECT model, label_idx, sum(y * p) AS tp, sum(p) AS pred, sum(y) AS true_n FROM {_source} GROUP BY ALL))"
    _sample = f"(SELECT *, {scores_sql('tp', 'pred', 'true_n')} FROM (SELECT model, id, sum(y * p) AS tp, sum(p) AS pred, sum(y) AS true_n FROM {_source} GROUP BY ALL))"
    cte(
        _name,
        f"SELECT model, label_idx::VARCHAR AS label, precision, recall, f1, true_n AS support FROM {_label}"
        f" UNION ALL SELECT model, 'micro avg', {scores_sql('sum(tp)', 'sum(pred)', 'sum(true_n)')}, sum(true_n) FROM {_label} GROUP BY model"
        f" UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(true_n) FROM {_label} GROUP BY model"
        " UNION ALL SELECT model, 'weighted avg', sum(precision * true_n) / sum(true_n), sum(recall * true_n) / sum(true_n),"
        f" sum(f1 * true_n) / sum(true_n), sum(true_n) FROM {_label} GROUP BY model"
        f" UNION ALL SELECT model, 'samples avg', avg(precision), avg(recall), avg(f1), sum(true_n) FROM {_sample} GROUP BY model",
    )


@query(
    "classification_report",
    f"SELECT model, label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support::BIGINT AS support FROM report",
)
def classification_report(spark, folder):
    rows = G.predicted_labels(model_scores(spark, folder), CUT)
    return rounded(G.classification_report(rows, ["model"]))


@query(
    "benchmark_report",
    f"SELECT model, label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support::BIGINT AS support,"
    " CAST(NULL AS VARCHAR) AS error FROM zero_report UNION ALL SELECT 'short', NULL, NULL, NULL, NULL, NULL,"
    " 'scores do not fit the labels in ' || (SELECT count(*) FROM vectors) || ' rows'",
)
def benchmark_report(spark, folder):
    """One model gives margins, one probabilities, and one too few scores."""
    scored = model_scores(spark, folder)
    probability = F.transform("scores", lambda s: Z.sigmoid(s))
    raw, scaled = scored.filter("model = 'raw'"), scored.filter("model = 'scaled'")
    models = raw.withColumn("kind", F.lit("margin")).unionByName(scaled.withColumn("scores", probability).withColumn("kind", F.lit("probability")))
    short = raw.withColumn("model", F.lit("short")).withColumn("scores", F.slice("scores", 1, 3)).withColumn("kind", F.lit("margin"))
    return rounded(G.report_models(models.unionByName(short)))


@query(
    "benchmark",
    f"SELECT model, 'centroid' AS family, 'SBERT' AS feature_type, 'OG' AS variant, {metrics_sql()}, CAST(NULL AS VARCHAR) AS error"
    " FROM row_metrics GROUP BY model UNION ALL SELECT 'absent', 'centroid', 'SBERT', 'SR', "
    + ", ".join(["NULL"] * (3 * len(KS) + 2))
    + ", 'no predictions'",
)
def benchmark(spark, folder):
    return rounded(model_comparison(spark, folder))


SUMMARY = {f"Top_{k}_Accuracy": HIT[k] for k in KS} | {f"Recall@{k}": RECALL[k] for k in KS} | {"MAP": MAP, "MRR": MRR}


@query(
    "comparison_table",
    "SELECT model, " + ", ".join(f'round({v}, 4) AS "{k}"' for k, v in SUMMARY.items()) + " FROM row_metrics GROUP BY model"
    " UNION ALL SELECT 'absent', " + ", ".join(["NULL"] * len(SUMMARY)),
)
def comparison_table(spark, folder):
    return G.comparison_table(model_comparison(spark, folder))


@query(
    "metric_pivot",
    "SELECT model, " + ", ".join(f'{r6(v)} AS "{k}"' for k, v in SUMMARY.items()) + " FROM row_metrics GROUP BY model",
)
def metric_pivot(spark, folder):
    long = G.long_metrics(model_comparison(spark, folder)).filter(F.col("value").isNotNull())
    return rounded(G.pivot_metrics(long))


MONITOR = {f"recall_at_{k}": RECALL[k] for k in G.MONITOR_KS} | {f"top_{k}_accuracy": HIT[k] for k in G.MONITOR_KS}


@query(
    "train_monitor",
    "SELECT "
    + ", ".join(f"{r6(v)} AS {k}" for k, v in MONITOR.items())
    + f', {r6(MRR)} AS "MRR", {r6(MAP)} AS "MAP" FROM row_metrics WHERE model = \'raw\'',
)
def train_monitor(spark, folder):
    rows = model_scores(spark, folder).filter(F.col("model") == "raw")
    return rounded(G.train_monitor(rows))
