"""Exact linearly-interpolated quantile by radix selection.

``percentile(x, q)`` is exact, but its final aggregation holds every distinct value of
the column in one task.  Here each value becomes a whole number of 64 bits that sorts as
the value does (the number's own bits for values above zero, their negative below), and
the order statistics are found 16 bits at a time: a pass counts the rows by their next 16
bits among those that share the bits found so far, and the counts say in which of at most
65 536 cells the wanted rank lies.  Four passes over one column give the exact values at
ranks ``floor((n - 1) q)`` and the next; they are interpolated linearly, as numpy does.

A pass is one aggregate with partial sums before its shuffle, and at most twice 65 536
counts reach the driver, whatever the input.  Passes after the first work out the keys of
the values between the ends of the cells found, and no others.  NULL and NaN are no values.  The input is
read four times: pass a spooled or file-backed DataFrame.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a pass, and the shifts of the passes.
DIGIT = 16
SHIFTS = (48, 32, 16, 0)
_FRACTION = float(1 << 52)
INFINITE = 2047 << 52  # the key of infinity, the largest


def order_key(x: Column) -> Column:
    """Whole number of 64 bits that sorts as the DOUBLE ``x`` (no NULL or NaN).

    ``x`` is split exactly into an exponent and a fraction of 53 bits: a logarithm
    guesses the exponent, and one step up or down mends the guess.
    """
    size = F.abs(x)
    guess = _guess(size)
    part = size / F.pow(F.lit(2.0), guess)
    return _bits(x, guess, part)


def _guess(size: Column) -> Column:
    return F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("double")))


def _bits(x: Column, guess: Column, part: Column) -> Column:
    size = F.abs(x)
    more = F.when(part >= 2.0, F.lit(1)).when((part < 1.0) & (guess > -1022.0), F.lit(-1)).otherwise(F.lit(0))
    fraction = F.when(part >= 2.0, part / 2.0).when((part < 1.0) & (guess > -1022.0), part * 2.0).otherwise(part)
    bits = F.shiftleft((guess + 1022.0).cast("long") + more, 52) + (fraction * _FRACTION).cast("long")
    bits = F.when(size == float("inf"), F.lit(INFINITE)).when(size == 0, F.lit(0)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def order_keys(df: DataFrame, col: str) -> DataFrame:
    """:func:`order_key` of every value of ``col`` (NULL and NaN left out) as ``k``.

    The logarithm and the power stand in projections of their own, each used more than
    once above: the optimizer leaves those apart, so either is worked out once a row.  No
    filter may follow on ``k``; pushed below, it would work them out again.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    guessed = x.select("x", _guess(F.abs("x")).alias("guess"))
    parted = guessed.select("x", "guess", (F.abs("x") / F.pow(F.lit(2.0), F.col("guess"))).alias("part"))
    return parted.select(_bits(F.col("x"), F.col("guess"), F.col("part")).alias("k"))


def key_value(key: int) -> float:
    """The number whose :func:`order_key` is ``key``."""
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


def order_statistics(df: DataFrame, col: str, rank_of) -> tuple[int, list[float]]:
    """Number of values of ``col``, and the values at the ranks (from 0) ``rank_of(n)``.

    Exactly four reads of ``col``; the first counts the values as well.
    """
    keys = order_keys(df, col)
    n, wanted, prefix = None, [], []
    for shift in SHIFTS:
        digit = F.shiftright("k", shift)
        if prefix:
            # only values between the ends of the cells found: their keys alone are worked out
            low, high = (min(prefix) << (shift + DIGIT)), ((max(prefix) + 1) << (shift + DIGIT)) - 1
            value = F.col(col).cast("double")
            near = df.where((value >= key_value(low)) & (value <= key_value(min(high, INFINITE))))
            keys = order_keys(near, col)
            digit = digit.bitwiseAND(F.lit((1 << DIGIT) - 1))
            above = F.shiftright("k", shift + DIGIT)
            inside = above.isin(*set(prefix))  # all other rows are one group, of nulls
            cells = keys.groupBy(F.when(inside, above).alias("above"), F.when(inside, digit).alias("digit"))
        else:
            cells = keys.groupBy(F.lit(0).alias("above"), digit.alias("digit"))
        counts: dict = {}
        for r in cells.count().collect():
            counts.setdefault(r["above"], []).append((r["digit"], r["count"]))
        if n is None:
            n = sum(c for _, c in counts.get(0, []))
            wanted = list(rank_of(n)) if n else []
            prefix = [0] * len(wanted)
        found = []
        for i, p in enumerate(prefix):
            for d, c in sorted(counts[p]):
                if wanted[i] < c:
                    found.append((p << DIGIT) + d)
                    break
                wanted[i] -= c
        prefix = found
        if not prefix:
            break
    return n, [key_value(p) for p in prefix]


def quantile_value(df: DataFrame, col: str, q: float) -> float | None:
    """Exact ``q`` quantile of ``col`` (NULL and NaN ignored); None without any value."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")

    def ranks(n):
        low = int(math.floor((n - 1) * q))
        return low, min(low + 1, n - 1)

    n, values = order_statistics(df, col, ranks)
    if not n:
        return None
    at = (n - 1) * q
    low, high = values
    return low if low == high else low + (high - low) * (at - math.floor(at))
