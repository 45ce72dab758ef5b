"""One place for the session settings the engine is tuned with."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Python workers on this machine find the package where the driver found it; clusters ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def build_session(cores: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session instead."""
    return let_workers_import(
        SparkSession.builder.master(f"local[{cores or os.cpu_count() or 8}]")
        .appName("quiltnet")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
