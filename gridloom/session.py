"""What a session needs before its first Python task."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Workers that start from now on find this package where it lies, whatever folder the driver was started in. On a
    cluster the package is installed on the executors, and the extra entry of their path is harmless."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark
