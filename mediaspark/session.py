"""Session defaults for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mediaspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let executors import the package where neither their path nor their folder has it, by Spark's file server."""
    found = {str(Path(p).resolve()) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if str(HERE.parent) in found or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="mediaspark-")) / f"{HERE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in HERE.rglob("*.py"):
            z.write(f, f.relative_to(HERE.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
