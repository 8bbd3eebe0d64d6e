"""Per-group statistics on every row of the group, with hot groups split by salting.

Rows, unless they are few, are first counted by a hash of their group in ``CELLS`` cells.  If
no cell is large, no group is: then one shuffle by key brings each group together, and a window gives its rows
their statistics.  Otherwise the statistics are taken by themselves and joined back.

A group statistic joined back to its rows is a sort-merge join on the group key
whose statistics side is an aggregate, so AQE's skew-join rule (which needs plain
shuffle stages on both sides) cannot split a hot key.  Here it is split explicitly:

  * a group is *hot* when it holds at least ``split`` rows: the average
    shuffle-partition size (``total / spark.sql.shuffle.partitions``).  There are therefore at most ``spark.sql.shuffle.partitions`` hot
    groups: the hot-key list has a proven bound and is broadcast;
  * each row of a hot group gets a salt in ``[0, ceil(count / split))`` from a
    hash of its row key; the hot group's single statistics row is replicated once
    per salt.  Cold groups keep salt 0 and are not replicated;
  * the join runs on (key, salt), so a hot group is spread over many tasks.

The rows are spooled before their statistics are taken, narrow, so what leads to them (the
header-detail join) is worked out once; then they are shuffled once, by key and salt.
Where the caller has counted what the rows are made of, and found it small, they go to the
window as they come.
The statistics are spooled as well (one row per group), being read three times.  A group's
size counts all its rows, also those whose value is NULL.  Keys are compared null-safe:
rows with a NULL key are a group like any other, meet its statistics and are salted with
it.  The result equals the plain null-safe left join (every row meets exactly its group's
row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.plans.spool import spool

SALT = "_salt"
N_SALT = "_n_salt"
GROUP_ROWS = "_group_rows"
#: Cells of the count by hash, rows of a group that a window may hold, and rows below which
#: the statistics are few enough to be broadcast, so that the rows need no shuffle at all.
CELLS = 1 << 14
WINDOW_ROWS = 100_000
BROADCAST_ROWS = 10_000
LINE_ID_COLS = ("purchaseorderid", "vendorid", "purchaseorderdetailid", "productid")


def line_row_key(df: DataFrame) -> list[str]:
    """Columns identifying a purchase line, as far as ``df`` has them."""
    return [c for c in LINE_ID_COLS if c in df.columns]


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where NULL equals NULL; key columns come from the left."""
    right = right.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(right, on, "left").drop(*(f"_right_{k}" for k in keys))


def groups_are_small(rows: DataFrame, keys: list[str]) -> bool:
    """Whether, of ``BROADCAST_ROWS`` rows or more, no group holds ``WINDOW_ROWS`` rows or a
    shuffle partition's share of all.

    True is certain: a cell counts at least the rows of each group in it.
    """
    cells = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("cell")).count()
    total, largest = cells.agg(F.sum("count"), F.max("count")).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None or total < BROADCAST_ROWS:
        return False
    return largest < min(WINDOW_ROWS, -(-total // parts))


def attach_group_stats(rows: DataFrame, keys: list[str], aggregates, derive, small: bool = False) -> DataFrame:
    """``rows`` with statistics of their group: ``aggregates`` over ``keys``, from which
    ``derive(stats)`` makes the columns to join (and may drop groups).

    ``aggregates`` by name (a dict) may be taken over a window; ``derive(rows, columns)``
    then adds the derived columns to ``columns`` of the rows and may not drop any.

    ``small``: the caller has seen that groups are small.  The rows are neither spooled nor
    counted then, and a shuffle that brought them together by some of ``keys`` serves the
    window as well.  A wrong guess costs time, the rows are the same.
    """
    named = aggregates if isinstance(aggregates, dict) else {}
    small = small and bool(named)
    if not small:
        rows = spool(rows, "rows")
    if small or named and groups_are_small(rows, keys):
        group = Window.partitionBy(*keys)
        found = rows.withColumns({GROUP_ROWS: F.count(F.lit(1)).over(group)} | {n: c.over(group) for n, c in named.items()})
        return derive(found, rows.columns).drop(GROUP_ROWS)
    aggregates = [c.alias(n) for n, c in named.items()] or aggregates
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(GROUP_ROWS), *aggregates)
    return join_group_stats(rows, derive(stats), keys, GROUP_ROWS, line_row_key(rows)).drop(GROUP_ROWS)


def join_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    count_col: str,
    row_key: list[str],
) -> DataFrame:
    """``rows`` left-joined null-safe to ``stats`` on ``keys``, with hot groups salted."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # statistics are read three times (total, hot list, join): write them once
    stats = spool(stats, "stats")
    total = stats.agg(F.sum(count_col)).first()[0] or 0
    split = max(1, -(-total // parts))
    # at most `parts` groups can hold total / parts rows each: a bounded list
    salts = F.ceil(F.col(count_col) / F.lit(split)).cast("int").alias(N_SALT)
    hot_b = F.broadcast(spool(stats.where(F.col(count_col) >= split).select(*keys, salts), "hot"))
    salted_rows = _null_safe_left(rows, hot_b, keys).withColumn(
        SALT,
        F.when(
            F.col(N_SALT).isNotNull(),
            F.pmod(F.xxhash64(*[F.col(c) for c in row_key]), F.col(N_SALT)),
        ).otherwise(F.lit(0)).cast("int"),
    ).drop(N_SALT)
    salted_stats = _null_safe_left(stats, hot_b, keys).withColumn(
        SALT,
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(N_SALT), F.lit(1)) - 1)),
    ).drop(N_SALT)
    return _null_safe_left(salted_rows, salted_stats, [*keys, SALT]).drop(SALT)
