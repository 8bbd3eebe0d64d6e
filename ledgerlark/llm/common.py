"""Shared pieces of the training-data operators: spooled intermediates, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.plans.spool import discard, register, shared_path

__all__ = ["components", "discard", "partitions", "register", "shared_path", "small_batches", "spool", "union_labels"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that a lost executor repeats only what follows, and lets Spark
    remove the shuffle files of the finished job.  Returns the frame and its path,
    for :func:`discard`; what is not discarded goes with the scope it was written in
    (``ledgerlark.plans.spool.scope``) or with the session.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    register(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of an Arrow batch, at most (a single row may be longer).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``: a task has several copies of one.

    Results don't depend on it.
    """
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_labels(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest-index labels of the components of ``n`` nodes under edges ``a - b``."""
    parent = np.arange(n) if parent is None else parent.copy()
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: one row ``(node, root)`` per node.

    ``root`` is the smallest node of the component.  Alternates large-star and
    small-star steps until the edge set stands still; every step is a partial
    aggregation and an equi-join whose two sides are plain shuffles, so AQE can split
    the rows of a hub.  Each round is spooled.  Self-links and repeated edges are
    harmless; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    cur, cur_path = spool(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = cur.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = spool(
            both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo")),
            "low",
        )
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v")).distinct()
        large, large_path = spool(large, "large")
        low2, low2_path = spool(large.groupBy("u").agg(F.min("v").alias("lo")), "low")
        small = large.join(low2, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("lo").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("lo").alias("v")),
                )
            ).alias("e")
        )
        nxt, nxt_path = spool(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for p in (cur_path, low_path, large_path, low2_path):
            discard(spark, p)
        cur, cur_path = nxt, nxt_path
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
