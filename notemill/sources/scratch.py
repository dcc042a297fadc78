"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: Whether Spark drops what a query shuffled as soon as it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local folder serves a local session; a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="notemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/notemill/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    store, found = folder(spark, path)
    return [x.getPath().getName() for x in store.listStatus(found) if x.isDirectory()]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    if "/notemill/" not in path:
        raise ValueError(f"not a scratch table: {path}")
    store, found = folder(spark, path)
    store.delete(found, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files; otherwise those stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
