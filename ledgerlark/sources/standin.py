"""Logical procurement / sales tables derived from the TPC-H-style test tables.

The workload is written against 13 logical tables (vendor, purchase-order header and
detail, sales-order header and detail, territory, salesperson, special offer, product,
subcategory, category, employee, person).  The test data ships TPC-H-like tables
instead; this module derives each logical table from them with DataFrame code, so
every query reads the given tables and its work grows with them.

All tables are lazy DataFrames; Catalyst prunes unused columns and derivations.
The same mapping, written as SQL, feeds the DuckDB oracle (``ledgerlark.oracle``).

Fixed values of the mapping:
  * vendor credit rating = 1 + nation key % 5; preferred when account balance > 0
  * purchase-order status = first character of the order priority (1..5)
  * rejected quantity = line number (capped at the quantity) for return flag 'R'
  * standard cost = list price * (50 + size) / 100
  * territory / salesperson "YTD" year = latest year of orders, "last year" = the one before
  * territory cost forced to 0 for nation key >= 20; salespeople of nation >= 20
    have no territory; quota is NULL for a negative account balance,
    else balance * 10000; bonus = 100 * (nation + 1); commission = (nation % 5) / 100
  * special offer id = round(discount * 100); description 'Discount <id>%';
    type 'No Discount' for 0 else 'Volume Discount'; category 'Reseller'
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.exprs import FRACTION, money
from ledgerlark.session import size_shuffles
from ledgerlark.sources.parquet import read_table, table_bytes

NO_COST_FROM_NATION = 20
NO_TERRITORY_FROM_NATION = 20
QUOTA_FACTOR = 10000


def _offer_id(discount) -> F.Column:
    return F.round(discount * F.lit(100)).cast("int")


def _in_years(ts_col: str, year: int) -> F.Column:
    """Range predicate on ``year`` and the one before (pushed into the parquet scan)."""
    return (F.col(ts_col) >= F.lit(f"{year - 1}-01-01").cast("timestamp_ntz")) & (
        F.col(ts_col) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    )


def _year_sum(ts_col: str, value, year: int) -> F.Column:
    return F.sum(F.when(F.year(F.col(ts_col)) == year, value))


class StandInTables:
    """The 13 logical tables over one test-data directory."""

    # Purchase orders are keyed by (vendor, order) in the stand-in: a TPC-H order holds
    # lines of several suppliers, and each supplier's share is one purchase order.
    po_key = ("vendorid", "purchaseorderid")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.sf_dir, name)
        return self._raw[name]

    @cached_property
    def ytd_year(self) -> int:
        """Latest year of orders (1970 without any): one narrow read, then a literal."""
        last = self.raw("orders").agg(F.year(F.max("o_orderdate"))).first()[0]
        return 1970 if last is None else int(last)

    # ---- purchasing --------------------------------------------------------------
    @cached_property
    def vendor(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("businessentityid"),
            F.col("s_name").alias("name"),
            (F.lit(1) + F.col("s_nationkey") % 5).cast("int").alias("creditrating"),
            (F.col("s_acctbal") > 0).alias("preferredvendorstatus"),
        )

    @cached_property
    def purchaseorderheader(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy("l_suppkey", "l_orderkey", "o_orderdate", "o_orderpriority")
            .agg(
                F.sum(money("l_extendedprice")).alias("subtotal"),
                F.max("l_shipdate").alias("shipdate"),
            )
            .select(
                F.col("l_orderkey").alias("purchaseorderid"),
                F.col("l_suppkey").alias("vendorid"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("status"),
                F.col("o_orderdate").alias("orderdate"),
                "shipdate",
                "subtotal",
            )
        )

    @cached_property
    def purchaseorderdetail(self) -> DataFrame:
        li = self.raw("lineitem")
        qty = F.col("l_quantity").cast("int")
        rejected = F.when(F.col("l_returnflag") == "R", F.least(F.col("l_linenumber"), qty)).otherwise(0)
        return li.select(
            F.col("l_orderkey").alias("purchaseorderid"),
            F.col("l_suppkey").alias("vendorid"),
            F.col("l_linenumber").alias("purchaseorderdetailid"),
            F.col("l_partkey").alias("productid"),
            qty.alias("orderqty"),
            money("l_extendedprice").alias("unitprice"),
            (qty - rejected).cast("decimal(8,2)").alias("receivedqty"),
            rejected.cast("decimal(8,2)").alias("rejectedqty"),
        )

    # ---- sales -------------------------------------------------------------------
    @cached_property
    def salesorderheader(self) -> DataFrame:
        """Sales orders with their territory (the customer's nation)."""
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        return (
            self.raw("orders")
            .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                F.col("o_orderkey").alias("salesorderid"),
                F.col("o_custkey").alias("customerid"),
                F.col("c_nationkey").alias("territoryid"),
                F.col("o_orderdate").alias("orderdate"),
                money("o_totalprice").alias("subtotal"),
            )
        )

    @cached_property
    def salesorderheader_untagged(self) -> DataFrame:
        """Sales orders without the territory column (no customer lookup needed)."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("salesorderid"),
            F.col("o_custkey").alias("customerid"),
            F.col("o_orderdate").alias("orderdate"),
            money("o_totalprice").alias("subtotal"),
        )

    @cached_property
    def salesorderdetail(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_linenumber").alias("salesorderdetailid"),
            F.col("l_orderkey").alias("salesorderid"),
            _offer_id(F.col("l_discount")).alias("specialofferid"),
            F.col("l_quantity").cast("int").alias("orderqty"),
            money("l_extendedprice").alias("unitprice"),
            F.col("l_discount").cast(FRACTION).alias("unitpricediscount"),
        )

    @cached_property
    def specialoffer(self) -> DataFrame:
        d = self.raw("lineitem").select("l_discount").distinct()
        oid = _offer_id(F.col("l_discount"))
        return d.select(
            oid.alias("specialofferid"),
            F.concat(F.lit("Discount "), oid.cast("string"), F.lit("%")).alias("description"),
            F.when(F.col("l_discount") == 0, F.lit("No Discount"))
            .otherwise(F.lit("Volume Discount"))
            .alias("type"),
            F.lit("Reseller").alias("category"),
            F.col("l_discount").cast(FRACTION).alias("discountpct"),
        )

    @cached_property
    def salesterritory(self) -> DataFrame:
        n = self.raw("nation")
        r = self.raw("region")
        o = self.raw("orders").where(_in_years("o_orderdate", self.ytd_year))
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        sales = (
            o.join(c, o.o_custkey == c.c_custkey)
            .groupBy("c_nationkey")
            .agg(
                _year_sum("o_orderdate", money("o_totalprice"), self.ytd_year).alias("sales_ytd"),
                _year_sum("o_orderdate", money("o_totalprice"), self.ytd_year - 1).alias("sales_ly"),
            )
        )
        li = self.raw("lineitem").where(_in_years("l_shipdate", self.ytd_year))
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        cost = (
            li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy("s_nationkey")
            .agg(
                _year_sum("l_shipdate", money("l_extendedprice"), self.ytd_year).alias("cost_ytd"),
                _year_sum("l_shipdate", money("l_extendedprice"), self.ytd_year - 1).alias("cost_ly"),
            )
        )
        no_cost = F.col("n_nationkey") >= NO_COST_FROM_NATION
        zero = F.lit(0).cast("decimal(22,2)")
        return (
            n.join(r, n.n_regionkey == r.r_regionkey)
            .join(sales, n.n_nationkey == sales.c_nationkey, "left")
            .join(cost, n.n_nationkey == cost.s_nationkey, "left")
            .select(
                F.col("n_nationkey").alias("territoryid"),
                F.col("n_name").alias("name"),
                F.col("r_name").alias("countryregioncode"),
                F.col("r_name").alias("group"),
                F.coalesce("sales_ytd", zero).alias("salesytd"),
                F.coalesce("sales_ly", zero).alias("saleslastyear"),
                F.when(no_cost, zero).otherwise(F.coalesce("cost_ytd", zero)).alias("costytd"),
                F.when(no_cost, zero).otherwise(F.coalesce("cost_ly", zero)).alias("costlastyear"),
            )
        )

    @cached_property
    def salesperson(self) -> DataFrame:
        s = self.raw("supplier")
        li = self.raw("lineitem").where(_in_years("l_shipdate", self.ytd_year))
        ship = li.groupBy("l_suppkey").agg(
            _year_sum("l_shipdate", money("l_extendedprice"), self.ytd_year).alias("ytd"),
            _year_sum("l_shipdate", money("l_extendedprice"), self.ytd_year - 1).alias("ly"),
        )
        zero = F.lit(0).cast("decimal(22,2)")
        return s.join(ship, s.s_suppkey == ship.l_suppkey, "left").select(
            F.col("s_suppkey").alias("businessentityid"),
            F.when(F.col("s_nationkey") < NO_TERRITORY_FROM_NATION, F.col("s_nationkey"))
            .alias("territoryid"),
            F.when(F.col("s_acctbal") < 0, F.lit(None))
            .otherwise(money("s_acctbal") * F.lit(QUOTA_FACTOR))
            .alias("salesquota"),
            F.coalesce("ytd", zero).alias("salesytd"),
            F.coalesce("ly", zero).alias("saleslastyear"),
            (F.lit(100) * (F.col("s_nationkey") + 1)).cast("decimal(19,4)").alias("bonus"),
            ((F.col("s_nationkey") % 5) / F.lit(100)).cast(FRACTION).alias("commissionpct"),
        )

    @cached_property
    def employee(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("businessentityid"))

    @cached_property
    def person(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("businessentityid"),
            F.split_part("s_name", F.lit("#"), F.lit(1)).alias("firstname"),
            F.split_part("s_name", F.lit("#"), F.lit(2)).alias("lastname"),
        )

    # ---- production --------------------------------------------------------------
    @cached_property
    def product(self) -> DataFrame:
        p = self.raw("part")
        listprice = money("p_retailprice")
        return p.select(
            F.col("p_partkey").alias("productid"),
            F.col("p_name").alias("name"),
            F.concat_ws("|", "p_brand", "p_type").alias("productsubcategoryid"),
            (listprice * (F.lit(50) + F.col("p_size")) * F.lit(0.01).cast("decimal(3,2)"))
            .cast("decimal(18,4)")
            .alias("standardcost"),
            listprice.alias("listprice"),
        )

    @cached_property
    def productsubcategory(self) -> DataFrame:
        return (
            self.raw("part")
            .select(
                F.concat_ws("|", "p_brand", "p_type").alias("productsubcategoryid"),
                F.col("p_brand").alias("productcategoryid"),
                F.col("p_type").alias("name"),
            )
            .distinct()
        )

    @cached_property
    def productcategory(self) -> DataFrame:
        return (
            self.raw("part")
            .select(F.col("p_brand").alias("productcategoryid"), F.col("p_brand").alias("name"))
            .distinct()
        )

    def register_views(self) -> None:
        """Expose the logical tables to ``spark.sql`` under their plain names."""
        for name in (
            "vendor", "purchaseorderheader", "purchaseorderdetail", "salesorderheader",
            "salesorderdetail", "specialoffer", "salesterritory", "salesperson",
            "employee", "person", "product", "productsubcategory", "productcategory",
        ):
            getattr(self, name).createOrReplaceTempView(name)


_CACHE: dict = {}


def standin(spark: SparkSession, sf_dir: str) -> StandInTables:
    """Stand-in tables for a directory, shared by all queries of one session (the
    DataFrames are immutable; sharing them saves re-reading parquet footers).  Shuffles are
    sized for the largest table, the lines."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = StandInTables(spark, sf_dir)
    size_shuffles(spark, table_bytes(spark, sf_dir, "lineitem"))
    return _CACHE[key]
