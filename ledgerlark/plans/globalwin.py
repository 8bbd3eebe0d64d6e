"""Global (un-partitioned) RANK and running SUM without a single-partition window.

``RANK() OVER (ORDER BY k DESC)`` and ``SUM(v) OVER (ORDER BY k DESC, id ROWS
UNBOUNDED PRECEDING)`` have no PARTITION BY, so Spark's built-in window moves every
row into one task.  That is fine for a few thousand vendors and fatal for a billion.

Plan used here (all partitions work in parallel, built-in functions only):
  1. ``repartitionByRange(k, id)``: rows are range-partitioned on the full sort key, so
     partition p holds a contiguous slice of the global order.  Ties on ``k`` may
     straddle partitions (a hot value is split, never piled into one task).  The rows
     are spooled with their partition number, so that what follows agrees on it.
  2. Built-in windows per range partition: row number, rank and running sum.
  3. One summary row per partition: rows, total, first and last key, rows of the last
     tie.  A carry over these N rows (N = partition count, a fixed bound) gives each
     partition the rows and total before it, and the rows before it that tie with its
     first key.  Whether two keys tie is Spark's ``<=>``: NULL ties with NULL, NaN with
     NaN, and neither with the other.
  4. A broadcast join with the N carried rows adds the offsets to every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.plans.spool import spool

_PART, _NO, _RANK, _SUM = "_gw_part", "_gw_no", "_gw_rank", "_gw_sum"


def _sort_cols(key: str, tiebreak: list[str], descending: bool, nulls_first: bool):
    k = F.col(key)
    if descending:
        kk = k.desc_nulls_first() if nulls_first else k.desc_nulls_last()
    else:
        kk = k.asc_nulls_first() if nulls_first else k.asc_nulls_last()
    return [kk] + [F.col(t).asc_nulls_last() for t in tiebreak]


def _carried(summary: DataFrame) -> DataFrame:
    """Offsets per range partition from the summary rows: a scan over N rows.

    ``tied`` says that a partition begins with the key its predecessor ends with; then the
    predecessor's last tie lies before its first row, and more of them where whole
    partitions hold one key.  A run of such partitions shares ``chain``.
    """
    order = Window.orderBy(_PART)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = summary.withColumn("tied", F.lag(F.struct("last")).over(order)["last"].eqNullSafe(F.col("first")) & (F.row_number().over(order) > 1))
    through = F.col("tied") & F.col("first").eqNullSafe(F.col("last"))
    chained = linked.withColumn("chain", F.sum(F.when(through, 0).otherwise(1)).over(upto))
    in_chain = Window.partitionBy("chain").orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = chained.withColumn("tail", F.sum("n_last").over(in_chain))
    return tails.select(
        _PART,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_gw_before"),
        F.when(F.col("tied"), F.lag("tail").over(order)).otherwise(F.lit(0)).alias("_gw_tied"),
        F.sum("total").over(before).alias("_gw_total"),
    )


def rank_and_running_total(
    df: DataFrame,
    key: str,
    tiebreak: list[str],
    value: str | None = None,
    *,
    descending: bool = True,
    nulls_first: bool = True,
    rank_col: str | None = "rank",
    running_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add global RANK() over ``key`` and/or running SUM(``value``) over (key, tiebreak).

    ``tiebreak`` must make the order total (e.g. the primary key); it only decides the
    running-sum order inside a tie group, never the rank.  A running sum is NULL until
    the first value that isn't, like the built-in window's.
    """
    spark = df.sparkSession
    order = _sort_cols(key, tiebreak, descending, nulls_first)
    # Without an explicit count, AQE sizes the range partitions (coalescing adjacent
    # ranges keeps the global order).
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    rows = spool(ranged.withColumn(_PART, F.spark_partition_id()), "globalwin")

    # partition numbers dealt by range again: one task per partition, none shared
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = Window.partitionBy(_PART).orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_key = Window.partitionBy(_PART).orderBy(order[0])
    scanned = rows.repartitionByRange(parts, _PART).select(
        "*",
        F.row_number().over(local).alias(_NO),
        F.rank().over(by_key).cast("long").alias(_RANK),
        (F.sum(value).over(running) if value else F.lit(None)).alias(_SUM),
    )
    summary = scanned.groupBy(_PART).agg(
        F.max(_NO).cast("long").alias("n"),
        (F.max(_NO) - F.max(_RANK) + 1).alias("n_last"),
        F.min_by(F.struct(F.col(key).alias("k")), _NO)["k"].alias("first"),
        F.max_by(F.struct(F.col(key).alias("k")), _NO)["k"].alias("last"),
        F.max_by(F.struct(F.col(_SUM).alias("s")), _NO)["s"].alias("total"),
    )
    offsets = spool(_carried(spool(summary, "globalwin-parts")), "globalwin-offsets")
    out = scanned.join(F.broadcast(offsets), _PART)
    if rank_col:
        tied = F.when(F.col(_RANK) == 1, F.col("_gw_tied")).otherwise(F.lit(0))
        out = out.withColumn(rank_col, (F.col("_gw_before") + F.col(_RANK) - tied).cast("long"))
    if value and running_col:
        both = F.col("_gw_total") + F.col(_SUM)
        out = out.withColumn(running_col, F.coalesce(both, F.col(_SUM), F.col("_gw_total")))
    return out.drop(_PART, _NO, _RANK, _SUM, "_gw_before", "_gw_tied", "_gw_total")


def single_partition_rank_and_running_total(
    df: DataFrame,
    key: str,
    tiebreak: list[str],
    value: str | None = None,
    *,
    descending: bool = True,
    nulls_first: bool = True,
    rank_col: str | None = "rank",
    running_col: str | None = None,
) -> DataFrame:
    """Reference implementation with Spark's built-in (single-partition) windows."""
    from pyspark.sql import Window as W

    order = _sort_cols(key, tiebreak, descending, nulls_first)
    out = df
    if rank_col:
        out = out.withColumn(rank_col, F.rank().over(W.orderBy(order[0])).cast("long"))
    if value and running_col:
        w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumn(running_col, F.sum(value).over(w))
    return out
