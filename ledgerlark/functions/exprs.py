"""Column-expression helpers that pin down null, rounding and division semantics.

All helpers return plain ``Column`` expressions (JVM side, whole-stage codegen).
  * money stays exact DECIMAL until the final projection;
  * ``round_money`` rounds an exact decimal half away from zero;
  * ratios of exact numbers (``exact_ratio``, ``pct``, ``growth_pct``) are divided in
    whole units; the remainder decides the rounding, half away from zero;
  * ratios of DOUBLEs are snapped to 10 decimal places, then rounded half away from
    zero, so the result does not depend on the last binary digit;
  * ``np_round`` reproduces pandas/numpy ``.round(d)`` (scale, round-half-even, unscale);
  * every division is guarded: a zero denominator yields NULL, never an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
FRACTION = "decimal(9,4)"
RATIO_SNAP = "decimal(38,10)"
EXACT_PLACES = 4  # decimal places of the numbers whose ratios are exact
EXACT = f"decimal(37,{EXACT_PLACES})"
UNITS = "decimal(38,0)"
MICROS_PER_DAY = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Cast a numeric to the exact money type used by the stand-in tables."""
    return col(c).cast(MONEY)


def round_money(c, places: int = 2) -> Column:
    """ROUND(decimal, places) (half away from zero), emitted as DOUBLE."""
    return F.round(col(c), places).cast("double")


def nullif_zero(c) -> Column:
    return F.nullif(col(c), F.lit(0))


def safe_div(num, den) -> Column:
    """num / NULLIF(den, 0) in DOUBLE."""
    return col(num).cast("double") / nullif_zero(col(den).cast("double"))


def round_ratio(c, places: int = 2) -> Column:
    """Round a DOUBLE ratio half away from zero after snapping to 10 places."""
    return F.round(col(c).cast(RATIO_SNAP), places).cast("double")


def _units(c) -> Column:
    """An exact number in units of its fourth decimal place, as DECIMAL(38,0)."""
    return (col(c).cast(EXACT) * F.lit(10**EXACT_PLACES).cast("decimal(5,0)")).cast(UNITS)


def exact_ratio(num, den, places: int = 2, factor: int = 1) -> Column:
    """ROUND(factor * num / NULLIF(den, 0), places) of exact numbers as DOUBLE.

    Both become whole units of 10**-4, so DECIMAL(19,4) and whole numbers enter exactly;
    the quotient of ``num * factor * 10**places`` is whole, and twice the remainder against
    the denominator decides the rounding, half away from zero.  Holds while
    ``num * factor * 10**places`` stays below 10**34; beyond, ANSI mode raises.
    """
    scaled = (_units(num) * F.lit(factor * 10**places).cast("decimal(9,0)")).cast(UNITS)
    base = nullif_zero(_units(den).cast(UNITS))
    rest = scaled % base
    whole = ((scaled - rest).cast(UNITS) / base).cast(UNITS)
    away = F.when(F.abs(rest) >= F.abs(base) - F.abs(rest), F.signum(rest) * F.signum(base)).otherwise(F.lit(0.0))
    step = F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places + 1},{places})")
    return ((whole + away.cast("decimal(1,0)")).cast(UNITS) * step).cast("double")


def pct(num, den, places: int = 2) -> Column:
    """ROUND(num / NULLIF(den, 0) * 100, places) as DOUBLE; NULL on a zero base."""
    return exact_ratio(num, den, places, factor=100)


def growth_pct(cur, prev, places: int = 2) -> Column:
    """ROUND((cur - prev) / NULLIF(prev, 0) * 100, places)."""
    return exact_ratio(col(cur).cast(EXACT) - col(prev).cast(EXACT), prev, places, factor=100)


def np_round(c, places: int = 2) -> Column:
    """pandas ``Series.round(places)``: multiply, round half to even, divide."""
    scale = float(10**places)
    return F.bround(col(c).cast("double") * F.lit(scale), 0) / F.lit(scale)


def exact_avg(c, scale: int = 12) -> Column:
    """AVG of an exact decimal, result carried at ``scale`` fractional digits.

    Spark's AVG adds 4 digits of scale to its input, so the input is widened to
    ``scale - 4`` digits first (decimal(28, 8) -> avg decimal(32, 12)).
    """
    return F.avg(col(c).cast(f"decimal(28,{scale - 4})"))


def month_start(ts) -> Column:
    """DATE_TRUNC('month', ts) as a wall-clock timestamp (timestamp_ntz)."""
    return F.date_trunc("month", col(ts)).cast("timestamp_ntz")


def year_month(ts) -> Column:
    """TO_CHAR(ts, 'YYYY-MM')."""
    return F.date_format(col(ts), "yyyy-MM")


def ymd(ts) -> Column:
    """TO_CHAR(ts, 'YYYY-MM-DD')."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def dow0(ts) -> Column:
    """EXTRACT(DOW): 0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(col(ts)) - F.lit(1)


def micros(ts) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp (session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def lead_days(start, end) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 86400 as fractional days (DOUBLE)."""
    return (micros(end) - micros(start)).cast("double") / F.lit(float(MICROS_PER_DAY))


def desc_nulls_first(c) -> Column:
    """PostgreSQL ``DESC`` order: NULL sorts as the largest value."""
    return col(c).desc_nulls_first()


def asc_nulls_last(c) -> Column:
    """PostgreSQL ``ASC`` order."""
    return col(c).asc_nulls_last()
