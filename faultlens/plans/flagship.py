"""Two ways to use the same vectors, scored against label centroids and compared in one pass."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.losses import dot
from faultlens.operators import evaluate as G
from faultlens.operators import features as X
from faultlens.plans import stand_ins as S


def fit_centroids(df: DataFrame, features: str = "embedding") -> DataFrame:
    """(label, c): the mean vector of each label. One vector summary per label."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    return df.groupBy("label").agg(vector_to_array(Summarizer.mean(vector)).alias("c"))


def centroid_scores(df: DataFrame, centroids: DataFrame, digits: int = 6, features: str = "embedding") -> DataFrame:
    """Adds ``scores``: dot product with each centroid, in label order.

    The centroids are model parameters (labels x dimensions) and travel as one row, joined by a constant.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_table")).withColumn("_one", F.lit(1))
    own = F.col(features).cast("array<double>")
    scores = F.transform("_table", lambda m: F.round(dot(own, m["c"]), digits))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(table), "_one")
    return joined.withColumn("scores", scores).drop("_table", "_one")


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(model, id, scores, y, truth) of both models, measured on the rows that they were made from:
    input for the metrics, not an estimate of quality."""
    raw = S.embeddings(spark, folder)
    scaled = X.apply_scaler(raw, X.fit_scaler(raw))
    parts = [
        centroid_scores(rows, fit_centroids(rows)).select(F.lit(name).alias("model"), "id", "scores", "y", "truth")
        for name, rows in (("raw", raw), ("scaled", scaled))
    ]
    return parts[0].unionByName(parts[1])


def registry(spark: SparkSession) -> DataFrame:
    rows = [
        ("raw", "centroid", "SBERT", "OG"),
        ("scaled", "centroid", "SBERT", "OG"),
        ("absent", "centroid", "SBERT", "SR"),
        ("other", "centroid", "unknown", "OG"),
    ]
    return spark.createDataFrame(rows, "model_key string, family string, feature_type string, variant string")


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return G.benchmark(model_scores(spark, folder), registry(spark))
