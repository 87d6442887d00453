"""Tables of intermediate results in the folder that driver and executors share, so a lost executor costs a read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Local sessions may leave it out and get a private one; clusters may not."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext
    if not app.master.startswith("local") or app.master.startswith("local-cluster"):
        raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
    if app.applicationId not in _own:
        _own[app.applicationId] = tempfile.mkdtemp(prefix="lumigrid-core-")
        atexit.register(shutil.rmtree, _own[app.applicationId], True)
    return "file://" + _own[app.applicationId]


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet: its scan, and the path for ``remove``."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
