"""Training and search queries. Fitted models have no SQL; their parts that do are checked."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from faultlens.operators import evaluate as G
from faultlens.operators import features as X
from faultlens.operators import linear as L
from faultlens.operators import linear_wide as W
from faultlens.operators import search as H
from faultlens.operators import split as D
from faultlens.operators import trees as M
from faultlens.operators.sizing import settle, settle_instead, shared_folder
from faultlens.plans import stand_ins as S
from faultlens.plans.flagship import centroid_scores, fit_centroids, model_scores
from faultlens.plans.queries_evaluate import MAP, rounded
from faultlens.plans.queries_features import TOKENS_SQL
from faultlens.plans.registry import cte, query, r6
from faultlens.sources.models import load_text_weights

N_LABELS, N_DIMS = 10, 64


def features(spark, folder):
    """Scaled vectors with multi-hot labels, written once because every step reads them."""
    rows = S.embeddings(spark, folder)
    scaled = X.apply_scaler(rows, X.fit_scaler(rows))
    return settle(scaled.withColumnRenamed("embedding", "features"))


def measured(name: str, scored):
    return rounded(G.ranking_metrics(scored.withColumn("model", F.lit(name)), ["model"]))


cte("label_totals", "SELECT label_idx, count(*) AS n, sum(y) AS pos FROM ranked_rows WHERE model = 'raw' GROUP BY 1")


@query(
    "class_weights",
    f"SELECT label_idx::INTEGER AS label_idx, 1 AS class, pos::BIGINT AS n_rows, {r6('n / (2.0 * pos)::DOUBLE')} AS weight"
    " FROM label_totals WHERE pos > 0 UNION ALL"
    f" SELECT label_idx::INTEGER, 0, (n - pos)::BIGINT, {r6('n / (2.0 * (n - pos))::DOUBLE')} FROM label_totals WHERE n > pos",
)
def class_weights(spark, folder):
    return rounded(L.class_weights(S.embeddings(spark, folder)))


FIT_SQL = (
    "SELECT 0 AS candidate, -1 AS fold, label_idx::INTEGER AS label_idx, n AS n_rows, pos::BIGINT AS positives,"
    " n::DOUBLE AS weight_sum, true AS optimal FROM label_totals"
)


@query("ovr_logistic", FIT_SQL)
def ovr_logistic(spark, folder):
    """A convex fit has one optimum, so its input and its optimality say that it is right."""
    rows = features(spark, folder)
    fitted = M.as_linear(M.fit_ovr_logistic(rows, C=0.1, steps=200), 0.1, "l2", True)
    return rounded(L.fit_summary(rows, fitted, free_intercept=True))


@query("ovr_linear_svm", FIT_SQL)
def ovr_linear_svm(spark, folder):
    """The plain hinge; ``optimal`` says that the duality gap is closed."""
    rows = features(spark, folder)
    return rounded(L.fit_summary(rows, L.fit_ovr_linear(rows, N_LABELS, N_DIMS, "hinge", C=0.1, balanced=False)))


@query(
    "ovr_forest",
    "SELECT label_idx::INTEGER AS label_idx, 20 AS trees, true AS within_depth, n AS n_rows, pos::BIGINT AS positives FROM label_totals",
)
def ovr_forest(spark, folder):
    rows = features(spark, folder)
    fitted = M.fit_ovr_forest(rows, trees=20, depth=10, leaf=5)
    counts = L.class_weights(rows).groupBy("label_idx").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.when(F.col("class") == 1, F.col("n_rows"))).alias("positives")
    )
    grown = M.forest_summary(spark, fitted).withColumn("within_depth", F.col("depth").between(1, 10)).drop("depth")
    return grown.join(counts, "label_idx")


@query("ovr_linear", FIT_SQL)
def ovr_linear(spark, folder):
    rows = features(spark, folder)
    models = L.fit_ovr_linear(rows, N_LABELS, N_DIMS, "logistic", C=0.1)
    return rounded(L.fit_summary(rows, models))


@query("ovr_linear_wide", FIT_SQL)
def ovr_linear_wide(spark, folder):
    """The weights in a table, as for a vocabulary that no machine holds; judged like those at the driver."""
    rows = features(spark, folder)
    cells = rows.select("id", F.posexplode("features").alias("d", "weight"))
    cells = cells.select("id", F.format_string("d%02d", "d").alias("term"), F.col("weight").cast("double"))
    models = W.fit_linear_wide(W.wide_rows(rows, cells), L.ovr_tasks(N_LABELS, C=0.1))
    return rounded(L.fit_summary(rows, W.as_held(models, [f"d{d:02d}" for d in range(N_DIMS)])))


@query(
    "score_linear",
    f"SELECT id, label_idx::INTEGER AS label_idx, {r6('s + label_idx * CAST(0.1 AS DOUBLE)')} AS score FROM"
    " (SELECT id, label_idx, sum(v * c) AS s FROM cells JOIN centroids USING (d) WHERE model = 'raw' GROUP BY id, label_idx)",
)
def score_linear(spark, folder):
    rows = S.embeddings(spark, folder)
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    means = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(vector)).alias("coef"))
    table = means.select(F.col("label").alias("label_idx"), "coef", (F.col("label") * 0.1).alias("intercept"))
    scored = L.score_linear(rows, table, "embedding")
    return rounded(scored.select("id", F.posexplode("scores").alias("label_idx", "score")))


def folded(rows, folds: int = 3):
    return settle(D.kfold(rows, folds))


@query("cross_validate")
def cross_validate(spark, folder):
    """The whole embedding grid, three folds and ten labels: 240 models in each pass."""
    candidates = H.expand_grid(H.GRIDS["LR_SBERT"])
    return H.cross_validate_linear(folded(features(spark, folder)), candidates, N_LABELS, N_DIMS)


cte("row_folds", "SELECT id, (ntile(3) OVER (ORDER BY id) - 1) AS fold FROM vectors")


@query(
    "cross_validate_fits",
    "SELECT c::INTEGER AS candidate, f::INTEGER AS fold, label_idx::INTEGER AS label_idx, count(*) AS n_rows, sum(y)::BIGINT AS positives,"
    " count(*)::DOUBLE AS weight_sum, true AS optimal FROM ranked_rows JOIN row_folds USING (id), range(8) t(c), range(3) u(f)"
    " WHERE model = 'raw' AND fold <> f GROUP BY ALL",
)
def cross_validate_fits(spark, folder):
    """Every model of the embedding search: what it was fitted on, and whether it is optimal."""
    candidates = H.expand_grid(H.GRIDS["LR_SBERT"])
    rows = folded(features(spark, folder))
    tasks = H.search_tasks(dict(enumerate(candidates)), [0, 1, 2], N_LABELS)
    return rounded(L.fit_summary(rows, L.fit_linear(rows, tasks, N_DIMS, fold="fold"), "fold"))


@query("cross_validate_text")
def cross_validate_text(spark, folder):
    docs = settle_instead(S.prepared_documents(spark, folder))
    vocabulary = D.label_vocabulary(docs)
    n_labels = vocabulary.count()
    rows = settle_instead(D.kfold(D.binarize(docs, vocabulary)).select("id", "fold", "y", "processed_text"))
    candidates = H.expand_grid({"max_features": [1000], "ngram_max": [1], "min_df": [2], "C": H.C_OPTIONS, "penalty": ["l2"]})
    return H.cross_validate_text(rows, candidates, n_labels)


cte(
    "fold_maps",
    f"SELECT model, fold, {MAP} AS m FROM row_metrics JOIN (SELECT id, (ntile(3) OVER (ORDER BY id) - 1) AS fold FROM vectors)"
    " USING (id) GROUP BY ALL",
)


@query(
    "select_best",
    f"SELECT model AS candidate, {r6('avg(m)')} AS mean_map FROM fold_maps GROUP BY 1 ORDER BY avg(m) DESC, 1 LIMIT 1",
)
def select_best(spark, folder):
    folds = folded(S.embeddings(spark, folder).select("id"))
    scored = model_scores(spark, folder).withColumnRenamed("model", "candidate").join(folds, "id")
    return rounded(H.select_best(H.map_by_fold(scored)))


@query("train_and_compare")
def train_and_compare(spark, folder):
    """Fit on the training rows, rank the test rows, compare; one model fails on purpose."""
    rows = S.embeddings(spark, folder).withColumn("label_list", F.transform("truth", lambda t: t.cast("string")))
    parts = settle(D.stratified_split(rows))
    # Scaler, models and centroids know the training rows only.
    scaler = X.fit_scaler(parts.filter(F.col("split") == "train"))
    scaled = settle(X.apply_scaler(parts, scaler).withColumnRenamed("embedding", "features"))
    train, test = scaled.filter(F.col("split") == "train"), scaled.filter(F.col("split") == "test")

    def linear(loss):
        return lambda: L.score_models(test, L.fit_ovr_linear(train, N_LABELS, N_DIMS, loss, C=0.1))

    makers = {
        "LR": linear("logistic"),
        "SVM": linear("squared_hinge"),
        "centroid": lambda: centroid_scores(test, fit_centroids(train, "features"), features="features"),
        "broken": linear("unknown loss"),
    }
    registry = spark.createDataFrame(
        [(name, "linear", "SBERT", "OG") for name in makers], "model_key string, family string, feature_type string, variant string"
    )
    return rounded(G.compare_models(makers, registry))


cte("train_terms", f"SELECT id, unnest({TOKENS_SQL}) AS term FROM train_docs")


@query(
    "search_refit",
    "SELECT (SELECT count(*) FROM train_docs) AS n_train, least(1000, (SELECT count(*) FROM (SELECT term FROM train_terms"
    " GROUP BY term HAVING count(DISTINCT id) >= 2))) AS n_terms,"
    " (SELECT count(*) FROM prepared JOIN split_rows USING (id) WHERE split = 'val') AS n_scored, true AS same_scores",
)
def search_refit(spark, folder):
    """Search on the training rows, refit the best candidate, store it, load it, score the validation
    rows with it; the loaded model has to give the scores of the fitted one."""
    docs = settle_instead(S.prepared_documents(spark, folder))
    parts = settle_instead(D.encode_splits(D.stratified_split(docs)))
    train, val = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "val")
    n_labels = len(parts.select("y").first()["y"])
    grid = {"max_features": [1000], "ngram_max": [1], "min_df": [2], "C": [0.1, 1.0], "penalty": ["l2"]}
    candidates = H.expand_grid(grid)
    best = H.select_best(H.cross_validate_text(folded(train), candidates, n_labels)).first()["candidate"]
    path = f"{shared_folder(spark).rstrip('/')}/faultlens-{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    fitted = H.refit_text(train, candidates[best], n_labels, path)
    loaded = H.score_stored_text(val.select("id", "processed_text"), path)
    weights, how = load_text_weights(spark, f"{path}/text")
    vectors, _ = X.tfidf_vectors(X.with_terms(val.select("id", "processed_text")), weights)
    direct = L.score_models(vectors, fitted).select("id", F.col("scores").alias("_direct"))
    off = F.exists(F.zip_with("scores", "_direct", lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    both = loaded.join(direct, "id").agg(F.count("*").alias("n_scored"), (F.count_if(off) == 0).alias("same_scores"))
    return both.select(F.lit(how["n_rows"]).cast("long").alias("n_train"), F.lit(weights.count()).alias("n_terms"), "n_scored", "same_scores")
