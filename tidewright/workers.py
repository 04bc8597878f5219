"""What a cluster needs of this package: workers must find it (ship it with --py-files; where the folder is at hand, reach() names it to them), and driver and executors share one folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_LOCAL: dict[str, str] = {}


def reach(spark: SparkSession) -> None:
    """Put the package's folder on the path of the workers of functions that are made from now on."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process (tests) may lack it and gets a folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOCAL.get(context.applicationId) or tempfile.mkdtemp(prefix="tidewright-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


def files(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what reads it again doesn't make it again; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{name}-{uuid.uuid4().hex}"
    folder, system = files(spark, path)
    system.deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
