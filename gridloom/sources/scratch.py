"""Folders that driver and executors share for what a job writes on its way.

The session names the base in ``spark.checkpoint.dir``. All folders of an application are below one
of its own, which the file system deletes when the application ends; what is used up before can
be discarded at once.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def base_folder(spark: SparkSession) -> str:
    """Where ``spark.checkpoint.dir`` is unset and the executors are threads of this process, as in
    tests, a temporary folder; on any other master that raises."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.gettempdir()


def scratch(spark: SparkSession) -> str:
    """A new folder below the application's."""
    base, app = base_folder(spark), spark.sparkContext.applicationId
    key = f"{base} {app}"
    if key not in _ROOTS:
        root = f"{base}/gridloom-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``scratch`` has named."""
    if "/gridloom-" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that several results of it compute it once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
