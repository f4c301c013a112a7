"""Tables in a folder that driver and executors share, to cut lineage and to keep what two passes must find alike."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all executors share; removed when Python ends.

    Where that is unset, a local folder, and only if the executors are this
    machine's: elsewhere they would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    shared = bool(base)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "spindle-scratch")
    own = f"{base.rstrip('/')}/spindle-{spark.sparkContext.applicationId}"
    if own not in _roots:
        _roots.add(own)
        atexit.register(*((_remove, spark, own) if shared else (shutil.rmtree, own, True)))
    return own


def folder(spark: SparkSession) -> str:
    """A new place in it."""
    return f"{root(spark)}/{uuid.uuid4().hex}"


def opened(spark: SparkSession, path: str):
    """The path and its file system, as Spark opens them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the application still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    place, store = opened(spark, path)
    store.delete(place, True)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it again.

    The table stays until dropped() or the end of the application.
    """
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spindle_scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of saved() that nothing lazy reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._spindle_scratch)
