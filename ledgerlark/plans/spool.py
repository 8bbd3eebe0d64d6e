"""Intermediate results as Parquet in the shared folder, removed after use.

``spool`` writes a DataFrame once and reads it back: lineage is cut, later reads take
only the columns and row groups they need, and a lost executor repeats nothing before
it.  The folder is the one ``spark.checkpoint.dir`` names.

A spooled table is removed when the ``scope`` it was written in ends, and at the latest
when the session's file systems close.  Results that still read it must be written or
collected inside the scope.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.session import ensure_checkpoint_dir

_SCOPES = threading.local()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/spool-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def register(spark: SparkSession, path: str) -> None:
    """Have ``path``, which exists, removed with the innermost scope or the session."""
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a spooled table that nothing reads any more."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


@contextmanager
def scope(spark: SparkSession):
    """Removes the tables spooled inside when the block ends, also after an error."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            discard(spark, path)


def spool(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    register(spark, path)
    return spark.read.schema(df.schema).parquet(path)
