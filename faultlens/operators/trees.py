"""One MLlib model per label: logistic, linear SVM and forests. Each fit is a distributed job."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.linear import LinearModels, Task, fold_counts

MAX_DEPTH = 30  # deepest tree the library grows


@dataclass
class LabelModels:
    """A fitted model per label, or the constant 0/1 where only one class was seen."""

    models: list
    kind: str


def as_vector(df: DataFrame, column: str = "features") -> DataFrame:
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))
    return df


def _fit_each(df: DataFrame, make, balanced: bool, kind: str, at_once: int) -> LabelModels:
    data = as_vector(df)
    ((n, positives),) = fold_counts(data, None).values()

    def fit(i: int):
        pos = float(positives[i])
        neg = n - pos
        if pos == 0 or neg == 0:
            return 0.0 if pos == 0 else 1.0
        w_pos, w_neg = (n / (2 * pos), n / (2 * neg)) if balanced else (1.0, 1.0)
        target = F.element_at("y", i + 1).cast("double")
        rows = data.select("features", target.alias("label"))
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, w_pos).otherwise(w_neg))
        return make(w_pos * pos + w_neg * neg).fit(rows)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return LabelModels(list(pool.map(fit, range(len(positives)))), kind)


def fit_ovr_logistic(
    df: DataFrame, C: float = 1.0, penalty: str = "l2", balanced: bool = True, steps: int = 100, at_once: int = 4
) -> LabelModels:
    """The library's strength C becomes a share of the weighted mean loss."""

    def make(weight_sum: float):
        return LogisticRegression(
            weightCol="weight",
            regParam=1.0 / (C * weight_sum),
            elasticNetParam=1.0 if penalty == "l1" else 0.0,
            standardization=False,
            maxIter=steps,
            tol=1e-9,
        )

    return _fit_each(df, make, balanced, "logistic", at_once)


def fit_ovr_linear_svm(
    df: DataFrame, C: float = 1.0, balanced: bool = False, steps: int = 100, at_once: int = 4
) -> LabelModels:
    """Hinge loss with an L2 penalty; other mixes go through ``linear.fit_linear``."""

    def make(weight_sum: float):
        return LinearSVC(weightCol="weight", regParam=1.0 / (C * weight_sum), standardization=False, maxIter=steps)

    return _fit_each(df, make, balanced, "svm", at_once)


def fit_ovr_forest(
    df: DataFrame,
    trees: int = 20,
    depth: int | None = None,
    leaf: int = 2,
    balanced: bool = True,
    seed: int = 42,
    at_once: int = 4,
) -> LabelModels:
    def make(_):
        return RandomForestClassifier(
            weightCol="weight",
            numTrees=trees,
            maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH),
            minInstancesPerNode=leaf,
            seed=seed,
        )

    return _fit_each(df, make, balanced, "forest", at_once)


def as_linear(fitted: LabelModels, C: float, penalty: str, balanced: bool) -> LinearModels:
    """Library models of a linear kind as one set of parameters."""
    tasks = [Task(0, i, None, C, penalty, balanced) for i in range(len(fitted.models))]
    held = [m for m in fitted.models if not isinstance(m, float)]
    width = len(held[0].coefficients) if held else 0
    coef = np.array([np.zeros(width) if isinstance(m, float) else m.coefficients.toArray() for m in fitted.models])
    intercept = np.array([m if isinstance(m, float) else m.intercept for m in fitted.models])
    constant = np.array([m if isinstance(m, float) else np.nan for m in fitted.models])
    return LinearModels(tasks, coef.reshape(len(tasks), width), intercept, constant, "logistic")


def forest_summary(spark: SparkSession, fitted: LabelModels) -> DataFrame:
    """label_idx, trees and the deepest tree's depth of each label's forest; null for a constant."""
    rows = [
        (i, None, None) if isinstance(m, float) else (i, m.getNumTrees, max(t.depth for t in m.trees))
        for i, m in enumerate(fitted.models)
    ]
    return spark.createDataFrame(rows, "label_idx int, trees int, depth int")


def score(df: DataFrame, fitted: LabelModels, out: str = "scores") -> DataFrame:
    """Per label: the probability if the model gives one, else the margin, else the prediction."""
    data = as_vector(df).withColumnRenamed("features", "_x")
    columns = []
    for i, model in enumerate(fitted.models):
        if isinstance(model, float):
            columns.append(F.lit(model))
            continue
        model = model.copy()
        if getattr(model, "hasSummary", False):  # it holds the session, which cannot be sent along once metrics were observed
            model._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
        model.setFeaturesCol("_x").setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        if hasattr(model, "setProbabilityCol"):
            model.setProbabilityCol(f"_q{i}")
        data = model.transform(data)
        source = next((c for c in (f"_q{i}", f"_r{i}") if c in data.columns), None)
        columns.append(vector_to_array(source)[1] if source else F.col(f"_p{i}"))
    kept = [c for c in df.columns if c != "features"]
    return data.select(*kept, F.array(*columns).alias(out))
