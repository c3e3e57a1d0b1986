"""Session builder for local runs; on a cluster use the session you are given."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: dict[str, str] = {}  # the application that already has the package


def local_session(cpus: int | str = 8, app: str = "faultlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that functions that run
    there can import it wherever the driver was started."""
    context = spark.sparkContext
    if context.getConf().get("spark.submit.pyFiles", "") or _SENT.get("app") == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="faultlens-package-"))
    archive = shutil.make_archive(str(folder / "faultlens"), "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SENT["app"] = context.applicationId
