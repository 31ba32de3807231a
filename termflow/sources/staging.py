"""What every plan needs from the cluster: intermediate tables in the shared folder, and this package on the workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession



def staged(df: DataFrame) -> DataFrame:
    """`df` as a written table under `spark.checkpoint.dir`, or in the warehouse where that is unset, as in tests."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
    own = f"{folder}/staged-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Drop the application's tables when it ends; a session that has stopped before leaves them to the folder's owner."""
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    The archive is served from the driver's own temporary folder until the driver ends.
    """
    ctx = spark.sparkContext
    if ctx.applicationId not in _shipped:
        _shipped[ctx.applicationId] = folder = tempfile.TemporaryDirectory()
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        shutil.copytree(f"{top}/termflow", f"{folder.name}/src/termflow", ignore=shutil.ignore_patterns("__pycache__"))
        ctx.addPyFile(shutil.make_archive(f"{folder.name}/termflow_package", "zip", f"{folder.name}/src"))
