"""Vectors for the two embedding operators: cleaning, classes of copies, blocks of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, spool

#: Rows of one side in a task's block, at most about.
BLOCK_ROWS = 16384


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the rows with an id and a vector that is not zero, of finite numbers."""
    vec = F.col(vec_col)
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(vec, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & vec.isNotNull() & finite & nonzero).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def copies(rows: DataFrame, keep: int) -> DataFrame:
    """``(rep, vec, ids)`` per distinct vector: smallest id, and the ``keep`` smallest
    ids in order.

    Spark limits the groups before the shuffle, so a common vector sends few rows.
    """
    ids = rows.distinct()
    near = ids.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("k") <= keep)
    ids = near.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("rep"), "vec", "ids")


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    flat = col.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of both sides dealt so that every left row meets every right row of its key.

    A key with more than ``rows`` rows on a side is cut there, by hash, into blocks of
    about that many; ``(*keys, lb, rb)`` is one pair of blocks.  ``side`` is 0 for left,
    1 for right rows.  Only the large keys are joined to the rows, in a table that
    Spark may broadcast or not by its size.
    """
    spark = left.sparkSession

    def large(df, name):
        blocks = F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name)
        return df.groupBy(*keys).agg(blocks).where(F.col(name) > 1)

    both, _ = spool(large(left, "lbs").join(large(right, "rbs"), keys, "full_outer"), "large")
    if both.isEmpty():
        both = None

    def dealt(df, side, own, other):
        cols = [c for c in df.columns if c not in keys]
        if both is None:
            return df.select(*keys, F.lit(0).alias("lb"), F.lit(0).alias("rb"), F.lit(side).alias("side"), *cols)
        owns, others = (F.coalesce(F.col(c), F.lit(1)) for c in (own + "s", other + "s"))
        mine = F.pmod(F.xxhash64("rep"), owns.cast("long")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), others - 1)).alias(other)
        return df.join(both, keys, "left").select(*keys, mine, every, F.lit(side).alias("side"), *cols).select(*keys, "lb", "rb", "side", *cols)

    blocks = dealt(left, 0, "lb", "rb").unionByName(dealt(right, 1, "rb", "lb"))
    return blocks.repartition(partitions(spark), *keys, "lb", "rb")
