"""Sessions, and the library's code on the executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="idforge-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(root, f"{folder}/tree/{root.name}", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", f"{folder}/tree"))
        _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that sees to it that the executors have the code."""

    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return query(spark, d)

    return run


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
