"""Result sinks: CSV reports and bucketed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain_number(c: F.Column) -> F.Column:
    """DOUBLE as the shortest text that reads back as the same number (``0.0``,
    ``866774125.69``); exponents only below 0.001 and from 1e27; NULL, NaN -> empty.

    From 1e7 on the shortest text has at most 10 decimals, so the decimal is exact."""
    short = c.cast("double").cast("string")
    large = (F.abs(c) >= 1e7) & (F.abs(c) < 1e27)
    plain = F.regexp_replace(F.when(large, short.cast("decimal(38,10)")).cast("string"), r"0+$", "")
    text = F.when(large, F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(short)
    return F.when(c.isNull() | F.isnan(c), F.lit(None)).otherwise(text)


def _pandas_style(df: DataFrame) -> DataFrame:
    """Booleans as True/False and doubles without exponent, as the original CSV
    reports print them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = _plain_number(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", pandas_style: bool = True) -> None:
    """CSV with a header; quotes are escaped by doubling (RFC 4180), NULL is empty.

    Output is one file per partition (written in parallel); it is never funnelled
    through one task.  A report with a global order keeps it across the part files.
    """
    out = _pandas_style(df) if pandas_style else df
    (
        out.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A catalog table bucketed and sorted on ``keys``, one file per bucket.

    Tables written with equal ``keys`` and ``buckets`` (a purchase-order header and its
    lines) join on them without a shuffle, whichever query joins them.
    """
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    w = w.bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
