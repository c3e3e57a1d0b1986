"""What a stage leaves out, counted on the pass that writes what it keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultlens.operators.sizing import settle

REPORT = "stage string, outcome string, n_rows long"


def settle_counted(df: DataFrame, stage: str, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows for which no reason holds, written; and (stage, outcome, n_rows) with the rows read and the rows left
    out for each reason, zeros included.

    A row counts under the first reason that holds; a null one does not hold. The counts are metrics that Spark gathers in the
    tasks that write, so the input is not read a second time, and only the counts come to the driver."""
    names = list(reasons)
    why = F.coalesce(*[F.when(F.coalesce(held, F.lit(False)), F.lit(i)) for i, held in enumerate(reasons.values())], F.lit(-1))
    seen = Observation(f"{stage}-{uuid.uuid4().hex}")
    counts = [F.count_if(F.col("_why") == i).alias(f"n{i}") for i in range(len(names))]
    watched = df.withColumn("_why", why).observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    kept = settle(watched.filter("_why < 0").drop("_why"))
    got = seen.get
    rows = [(stage, "read", got["rows"]), *((stage, name, got[f"n{i}"]) for i, name in enumerate(names))]
    return kept, df.sparkSession.createDataFrame(rows, REPORT)
