"""Python workers that find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Adds the folder of this package to what Python workers search, for sessions whose program found it by other means than PYTHONPATH.

    On a cluster the package comes with the job (``--py-files`` or an image); a folder that a machine doesn't have is passed over.
    """
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
