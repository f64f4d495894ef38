"""Tables that are built once and read again by later queries: the term index, candidate rankings, evaluation rows.

They lie in the folder that driver and executors share. A table is built anew when its input's size or time has changed or when
it was deleted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_built: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only where it is unset and all runs on this machine, a folder of the session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = ("folder", spark.sparkContext.applicationId)
    if key not in _built:
        _built[key] = "file://" + tempfile.mkdtemp(prefix="lexquarry-store-")
    return _built[key]


def located(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def fingerprint(spark: SparkSession, path: str) -> tuple:
    system, where = located(spark, path)
    return path, system.getContentSummary(where).getLength(), system.getFileStatus(where).getModificationTime()


def exists(spark: SparkSession, path: str) -> bool:
    system, where = located(spark, path)
    return system.exists(where)


def folder_of(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None]) -> str:
    """The folder that build(folder) filled for these inputs, now or earlier in this application."""
    key = (spark.sparkContext.applicationId, name, *(fingerprint(spark, p) for p in inputs))
    if key not in _built or not exists(spark, _built[key]):
        path = f"{shared_folder(spark)}/lexquarry-{name}-{uuid.uuid4().hex}"
        build(path)
        _built[key] = path
    return _built[key]


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written once."""
    return spark.read.parquet(folder_of(spark, name, inputs, lambda path: make().write.option("compression", "zstd").parquet(path)))
