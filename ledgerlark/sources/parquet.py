"""Parquet / JDBC readers for the input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)

# The 13 logical tables of the workload, schema-qualified as in the source database.
LOGICAL_TABLES = (
    "purchasing.vendor",
    "purchasing.purchaseorderheader",
    "purchasing.purchaseorderdetail",
    "sales.salesorderheader",
    "sales.salesorderdetail",
    "sales.salesterritory",
    "sales.salesperson",
    "sales.specialoffer",
    "production.product",
    "production.productsubcategory",
    "production.productcategory",
    "humanresources.employee",
    "person.person",
)


# Whole-number keys of the tables that grow with the business.
FACT_KEYS = {
    "purchasing.purchaseorderheader": "purchaseorderid",
    "purchasing.purchaseorderdetail": "purchaseorderid",
    "sales.salesorderheader": "salesorderid",
    "sales.salesorderdetail": "salesorderid",
}


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``{base_dir}/{name}.parquet`` (a file or a directory of part files).

    The read is lazy: Catalyst prunes columns and pushes filters into the scan.
    """
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def table_bytes(spark: SparkSession, base_dir: str, name: str) -> int:
    """Bytes of the files that :func:`read_table` reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base_dir, f"{name}.parquet"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def read_logical_parquet(spark: SparkSession, base_dir: str) -> dict[str, DataFrame]:
    """Load the 13 logical tables stored as ``{base_dir}/{schema.table}.parquet``."""
    return {t: read_table(spark, base_dir, t) for t in LOGICAL_TABLES}


def read_logical_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict | None = None,
    partitioning: dict | None = None,
) -> dict[str, DataFrame]:
    """Load the logical tables straight from a database over JDBC.

    ``partitioning`` maps a table to ``(column, lower, upper, num_partitions)``: range
    queries that run side by side.  A fact table without an entry is read by ranges of
    its key, whose ends the database is asked for, over ``spark.sql.shuffle.partitions``
    connections; the other tables over one.
    """
    props = dict(properties or {})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for t in LOGICAL_TABLES:
        spec = (partitioning or {}).get(t)
        if not spec and t in FACT_KEYS:
            key = FACT_KEYS[t]
            ends = spark.read.jdbc(url, f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {t}) ends", properties=props).first()
            if ends["low"] is not None:  # the upper end itself belongs to the last range
                spec = (key, int(ends["low"]), int(ends["high"]) + 1, parts)
        if spec:
            column, lower, upper, n = spec
            out[t] = spark.read.jdbc(
                url, t, column=column, lowerBound=lower, upperBound=upper,
                numPartitions=n, properties=props,
            )
        else:
            out[t] = spark.read.jdbc(url, t, properties=props)
    return out


class LogicalTables:
    """The 13 logical tables under their short names (``vendor``, ``product`` ...),
    from a ``{schema.table: DataFrame}`` mapping (parquet directory or JDBC)."""

    po_key = ("purchaseorderid",)

    def __init__(self, tables: dict[str, DataFrame]):
        for qualified, df in tables.items():
            setattr(self, qualified.split(".", 1)[1], df)
        self.salesorderheader_untagged = getattr(self, "salesorderheader", None)

    @classmethod
    def from_parquet(cls, spark: SparkSession, base_dir: str) -> "LogicalTables":
        return cls(read_logical_parquet(spark, base_dir))

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, **kw) -> "LogicalTables":
        return cls(read_logical_jdbc(spark, url, **kw))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str = "default", tables=LOGICAL_TABLES) -> "LogicalTables":
        """Tables of a catalog under their short names, e.g. as ``write_bucketed`` left them."""
        return cls({t: spark.table(f"{database}.{t.split('.', 1)[1]}") for t in tables})

    def register_views(self) -> None:
        """Expose the tables to ``spark.sql`` under their short names."""
        for name in (t.split(".", 1)[1] for t in LOGICAL_TABLES):
            getattr(self, name).createOrReplaceTempView(name)
