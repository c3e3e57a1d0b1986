"""Ranking metrics, classification report, and comparison of many models in one pass."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import ranking as R
from faultlens.functions.losses import threshold as cut_scores
from faultlens.operators.sizing import settle

RANKING_KS = (1, 3, 5, 10)
MONITOR_KS = (1, 3, 5)
FEATURE_TYPES = ("TFIDF", "SBERT", "RoBERTa")
SUMMARY_COLUMNS = (
    [f"Top_{k}_Accuracy" for k in RANKING_KS] + [f"Recall@{k}" for k in RANKING_KS] + ["MAP", "MRR"]
)


def with_ranks(df: DataFrame) -> DataFrame:
    """Adds ``_ranks`` (ranks of the true labels), ``_clean`` (the same without -1 marks) and
    ``_n_true`` from ``ranked`` if it is there, else from ``scores``."""
    n_true = F.size(F.filter("y", lambda v: v == 1)).alias("_n_true")
    if "ranked" in df.columns:
        ranks = R.ranks_in_order(F.col("ranked"), R.true_labels(F.col("y")))
        clean = R.ranks_in_order(F.array_remove("ranked", -1), R.true_labels(F.col("y")))
        return df.select("*", ranks.alias("_ranks"), clean.alias("_clean"), n_true)
    ranks = R.ranks_from_scores(F.col("scores"), F.col("y"))
    return df.select("*", ranks.alias("_ranks"), n_true).withColumn("_clean", F.col("_ranks"))


def _mean(values: Column) -> Column:
    return F.coalesce(F.avg(values), F.lit(0.0))


def recall_at_k(k: int) -> Column:
    return _mean(R.row_recall(F.col("_ranks"), F.col("_n_true"), k))


def precision_at_k(k: int) -> Column:
    return _mean(R.row_precision(F.col("_ranks"), k))


def top_k_accuracy(k: int) -> Column:
    return _mean(R.row_hit(F.col("_ranks"), k))


def mean_reciprocal_rank() -> Column:
    return _mean(R.row_reciprocal_rank(F.col("_clean"), F.col("_n_true")))


def mean_average_precision() -> Column:
    return _mean(R.row_average_precision(F.col("_ranks"), F.col("_n_true")))


def metric_columns(ks=RANKING_KS, precision: bool = True) -> list[Column]:
    out = []
    for k in ks:
        out.append(recall_at_k(k).alias(f"Recall@{k}"))
        if precision:
            out.append(precision_at_k(k).alias(f"Precision@{k}"))
        out.append(top_k_accuracy(k).alias(f"Top_{k}_Accuracy"))
    return out + [mean_reciprocal_rank().alias("MRR"), mean_average_precision().alias("MAP")]


def ranking_metrics(df: DataFrame, by: list[str] | None = None, ks=RANKING_KS) -> DataFrame:
    """All metrics for all k in one aggregate: rows are reduced map-side, whatever the groups."""
    return with_ranks(df).groupBy(*(by or [])).agg(*metric_columns(ks))


def train_monitor(df: DataFrame, ks=MONITOR_KS) -> DataFrame:
    """Metrics watched during training; rows whose scores do not fit the labels turn all to zero."""
    bad = F.count_if(_unusable()) > 0
    measured = with_ranks(df).agg(*metric_columns(ks, precision=False), bad.alias("_bad"))
    names = [c for c in measured.columns if c != "_bad"]
    renamed = {f"Recall@{k}": f"recall_at_{k}" for k in ks} | {f"Top_{k}_Accuracy": f"top_{k}_accuracy" for k in ks}
    return measured.select(
        *[F.when(F.col("_bad"), F.lit(0.0)).otherwise(F.col(c)).alias(renamed.get(c, c)) for c in names]
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores_of(tp: Column, predicted: Column, support: Column) -> list[Column]:
    return [
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, predicted + support).alias("f1"),
    ]


def classification_report(df: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, with micro, macro, weighted and samples means.

    ``df`` has ``y`` and ``predicted`` as multi-hot rows. Counts per label are three vector sums
    in one pass, so rows are not multiplied by labels; division by zero gives 0.
    """
    by = by or []
    both = F.zip_with("y", "predicted", lambda a, b: a * b)
    hits, given, true = (F.aggregate(c, F.lit(0), lambda s, v: s + v) for c in (both, F.col("predicted"), F.col("y")))
    rows = df.select(
        *by,
        *[
            array_to_vector(c.cast("array<double>")).alias(n)
            for c, n in ((both, "_tp"), (F.col("predicted"), "_pred"), (F.col("y"), "_true"))
        ],
        *[c.alias(f"_s_{c_name}") for c, c_name in zip(_scores_of(hits, given, true), ("precision", "recall", "f1"))],
    )
    sums = rows.groupBy(*by).agg(
        *[Summarizer.sum(F.col(c)).alias(c) for c in ("_tp", "_pred", "_true")],
        *[F.avg(f"_s_{c}").alias(f"_s_{c}") for c in ("precision", "recall", "f1")],
    )
    arrays = sums.select(
        *by,
        *[vector_to_array(c).alias(c) for c in ("_tp", "_pred", "_true")],
        *[f"_s_{c}" for c in ("precision", "recall", "f1")],
    )
    arrays = settle(arrays)  # one row per group, read by the label rows and by each mean
    labels = arrays.select(*by, F.posexplode(F.arrays_zip("_tp", "_pred", "_true")).alias("label_idx", "c"))
    counts = (F.col("c._tp"), F.col("c._pred"), F.col("c._true"))
    scored = labels.select(*by, "label_idx", *[c.alias(n) for c, n in zip(counts, ("tp", "pred", "true"))])
    scored = scored.select("*", *_scores_of(F.col("tp"), F.col("pred"), F.col("true")))
    shown = F.get(F.lit(names), F.col("label_idx")) if names else F.col("label_idx").cast("string")
    support = F.col("true").cast("long").alias("support")
    out = scored.select(*by, shown.alias("label"), "precision", "recall", "f1", support)

    groups = scored.groupBy(*by)
    total = F.sum("true").cast("long").alias("support")
    micro = groups.agg(*_scores_of(F.sum("tp"), F.sum("pred"), F.sum("true")), total)
    macro = groups.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total)
    weighted = groups.agg(
        *[_ratio(F.sum(F.col(c) * F.col("true")), F.sum("true")).alias(c) for c in ("precision", "recall", "f1")], total
    )
    samples = arrays.select(
        *by,
        *[F.col(f"_s_{c}").alias(c) for c in ("precision", "recall", "f1")],
        F.aggregate("_true", F.lit(0.0), lambda s, v: s + v).cast("long").alias("support"),
    )
    for name, rows in (("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted), ("samples avg", samples)):
        out = out.unionByName(rows.withColumn("label", F.lit(name)))
    return out


CUTS = {"probability": 0.5, "margin": 0.0}  # score from which a label is predicted, by kind of score


def _unusable() -> Column:
    """Rows whose scores are missing or do not have one value per label."""
    return (
        F.col("scores").isNull()
        | (F.size("scores") != F.size("y"))
        | F.exists("scores", lambda s: s.isNull() | F.isnan(s))
    )


def report_models(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The report of every model in ``scored`` (model, kind, scores, y) in one pass.

    Scores are read as floats, as they were stored, and cut by their kind: probabilities at 0.5,
    margins at 0. A model with scores that do not fit its labels becomes one error row."""
    marked = scored.withColumn("_bad", F.coalesce(_unusable(), F.lit(True)))
    bad = settle(marked.groupBy("model").agg(F.count_if("_bad").alias("_bad")).filter(F.col("_bad") > 0))  # one row a model
    fine = marked.join(F.broadcast(bad.select("model")), "model", "left_anti").withColumn("scores", F.col("scores").cast("array<float>"))
    cut = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(float(at))) for kind, at in CUTS.items()])
    rows = fine.withColumn("predicted", F.transform("scores", lambda s: (s.cast("double") >= cut).cast("int")))
    report = classification_report(rows, ["model"], names).withColumn("error", F.lit(None).cast("string"))
    text = F.concat(F.lit("scores do not fit the labels in "), F.col("_bad").cast("string"), F.lit(" rows"))
    return report.unionByName(bad.select("model", text.alias("error")), allowMissingColumns=True)


def benchmark(scored: DataFrame, registry: DataFrame, ks=RANKING_KS) -> DataFrame:
    """Metrics of every registered model in one pass over ``scored`` (model, id, scores, y).

    A model without rows or with scores that do not fit its labels becomes an error row; the
    others are not touched. Models of unknown feature type are left out.
    """
    measured = with_ranks(scored).groupBy("model").agg(*metric_columns(ks), F.count_if(_unusable()).alias("_bad"))
    known = registry.filter(F.col("feature_type").isin(*FEATURE_TYPES)).withColumnRenamed("model_key", "model")
    joined = known.join(measured, "model", "left")
    error = F.when(F.col("_bad").isNull(), F.lit("no predictions")).when(
        F.col("_bad") > 0, F.concat(F.lit("scores do not fit the labels in "), F.col("_bad").cast("string"), F.lit(" rows"))
    )
    metrics = [c for c in measured.columns if c not in ("model", "_bad")]
    fine = F.col("error").isNull()
    return joined.withColumn("error", error).select(
        *known.columns, *[F.when(fine, F.col(c)).alias(c) for c in metrics], "error"
    )


def compare_models(
    makers: dict[str, Callable[[], DataFrame]], registry: DataFrame, ks=RANKING_KS, at_once: int = 4
) -> DataFrame:
    """As :func:`benchmark` for models that are scored by calls; a call or job that fails becomes
    the model's error row. ``makers`` maps a model to a function giving (id, scores, y)."""
    spark = registry.sparkSession
    empty = ranking_metrics(
        spark.createDataFrame([], "model string, id long, scores array<double>, y array<int>"), ["model"], ks
    ).withColumn("error", F.lit(None).cast("string"))

    def run(name: str) -> DataFrame:
        try:
            rows = makers[name]().withColumn("model", F.lit(name))
            one = registry.filter(F.col("model_key") == name)
            return settle(benchmark(rows.select("model", "id", "scores", "y"), one, ks).select(empty.columns))
        except Exception as failure:  # noqa: BLE001 - any failure is this model's result
            lines = [line.strip() for line in str(failure).splitlines() if line.strip()]
            text = lines[0] if lines else type(failure).__name__
            return spark.createDataFrame([(name, text)], "model string, error string")

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        parts = list(pool.map(run, makers))
    for part in parts:
        empty = empty.unionByName(part, allowMissingColumns=True)
    known = registry.filter(F.col("feature_type").isin(*FEATURE_TYPES)).withColumnRenamed("model_key", "model")
    out = known.join(empty, "model", "left")
    metrics = [c for c in empty.columns if c not in ("model", "error")]
    missing = F.when(F.col("MAP").isNull() & F.col("error").isNull(), F.lit("no predictions")).otherwise(F.col("error"))
    return out.select(*known.columns, *metrics, missing.alias("error"))


def comparison_table(results: DataFrame, columns=SUMMARY_COLUMNS, digits: int = 4) -> DataFrame:
    """The summary columns that exist, rounded; every column if none of them exists."""
    present = [c for c in columns if c in results.columns]
    if not present:
        return results
    return results.select("model", *[F.round(F.col(c), digits).alias(c) for c in present])


def long_metrics(results: DataFrame) -> DataFrame:
    """(model, metric, value) from the wide table."""
    metrics = [c for c, kind in results.dtypes if kind == "double"]
    return results.select("model", *metrics).unpivot(["model"], metrics, "metric", "value")


def pivot_metrics(long: DataFrame, metrics=SUMMARY_COLUMNS) -> DataFrame:
    return long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def predicted_labels(df: DataFrame, cut: float | None = None, kind: str = "probability") -> DataFrame:
    """Multi-hot predictions. Probabilities are cut at 0.5 and margins at 0, if nothing else is said."""
    return df.withColumn("predicted", cut_scores(F.col("scores"), CUTS[kind] if cut is None else cut))
