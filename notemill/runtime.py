"""What every job needs from the session it runs in."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Parameters: rows and bytes of a batch that goes to a Python worker, so that long texts don't add up in its memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def reach(spark: SparkSession) -> SparkSession:
    """Python workers that Spark starts from now on find this package, from whatever folder the driver was started. BATCH holds for
    the session from now on, as plans run after their functions have returned."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
