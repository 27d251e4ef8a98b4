"""Cut lineage through a table in the folder that all executors share.

A table written to reliable storage survives the loss of an executor, keeps
column pruning (unlike an RDD checkpoint) and is computed exactly once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a local one is made only where that is unset.

    A machine-local folder is used for ``local[*]`` masters alone; on a cluster
    an unset folder is an error, as other executors couldn't read a local one.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="idforge-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone; the folder's owner clears it


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that go when the application ends."""
    path = f"{shared_dir(spark)}/idforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The files go when the application ends; ``release`` drops them earlier.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._idforge_path = path
    return out


def release(df: DataFrame) -> None:
    """Drop the files behind a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_idforge_path", None)
    if path:
        _drop(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input is one or a few splits, as with a small file of one row group.

    An input with enough splits, which any large one has, stays as it is and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
