"""Exact mean and sample deviation of a DECIMAL column as mergeable sums.

A group's moments are its count ``n``, its sum and its sum of squares, the latter in whole
units of the column's last decimal place: partial moments merge without rounding in any
order.
The deviation takes ``n * squares - sum**2`` exactly and rounds once: equal prices have a
deviation of exactly zero, whatever their size and number.  Sums that leave 38 digits
raise (ANSI mode) instead of losing any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a value in units; its square and 10**18 of them stay within 38 digits at 10.
UNIT_DIGITS = 18


def _scale(df: DataFrame, col: str) -> int:
    kind = df.schema[col].dataType
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"{col} must be DECIMAL, not {kind.simpleString()}")
    return kind.scale


def moment_sums(df: DataFrame, col: str) -> dict[str, Column]:
    """Aggregates ``m_n``, ``m_sum`` and ``m_squares`` of ``col``; NULL counts nowhere."""
    scale = _scale(df, col)
    unit = (F.col(col) * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal({UNIT_DIGITS},0)")
    return {"m_n": F.count(col), "m_sum": F.sum(col), "m_squares": F.sum(unit * unit)}  # squares: DECIMAL(38,0)


def moments(df: DataFrame, col: str) -> list[Column]:
    """The aggregates of :func:`moment_sums` under their names."""
    return [c.alias(name) for name, c in moment_sums(df, col).items()]


def mean() -> Column:
    """Mean from the moments as DOUBLE, the exact sum divided once."""
    return F.col("m_sum").cast("double") / F.nullif(F.col("m_n").cast("double"), F.lit(0.0))


def deviation(df: DataFrame, col: str) -> Column:
    """Sample deviation from the moments as DOUBLE; NULL for fewer than two values."""
    scale = _scale(df, col)
    n, one = F.col("m_n").cast("decimal(18,0)"), F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    total = (F.col("m_sum") * one).cast("decimal(38,0)")
    spread = (n * F.col("m_squares")).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    pairs = F.col("m_n").cast("double") * (F.col("m_n") - 1).cast("double")
    return F.when(F.col("m_n") > 1, F.sqrt(spread.cast("double") / pairs) / F.lit(float(10**scale)))
