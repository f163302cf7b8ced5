"""What a session needs so that Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path, where the session was started without it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
