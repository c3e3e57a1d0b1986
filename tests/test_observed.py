from pyspark.sql import Observation
from pyspark.sql import functions as F

from faultlens.operators import trees as M


def test_models_score_after_metrics_were_observed(spark):
    """A session that has observed metrics cannot be serialised, so models must not bring it along."""
    seen = Observation("rows")
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get["n"] == 3
    rows = [(i, [float(i % 5), 1.0], [int(i % 5 > 2), int(i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y array<int>")
    for fit in (lambda: M.fit_ovr_logistic(df, C=1.0), lambda: M.fit_ovr_linear_svm(df, C=0.1, steps=5), lambda: M.fit_ovr_forest(df, trees=2, depth=3)):
        assert len(M.score(df, fit()).collect()) == 40
