"""Revenue, margin and performance operators (workload operators 5-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.exprs import (
    asc_nulls_last,
    exact_avg,
    exact_ratio,
    growth_pct,
    month_start,
    pct,
    round_money,
    round_ratio,
    safe_div,
    year_month,
)
from ledgerlark.plans.globalwin import (
    rank_and_running_total,
    single_partition_rank_and_running_total,
)

# Revenue trend labels.
TREND_GROWING, TREND_FLAT, TREND_DECLINING = "Growing", "Flat", "Declining"


def margin_by_category(
    product: DataFrame, subcategory: DataFrame, category: DataFrame
) -> DataFrame:
    """Per (category, subcategory) of priced products: counts, average cost / price /
    margin / margin %, price range.  Grouped by names, as the report shows them."""
    p = product.where(F.col("listprice") > 0).select(
        "productid", "productsubcategoryid", "standardcost", "listprice"
    )
    psc = subcategory.select(
        "productsubcategoryid", "productcategoryid", F.col("name").alias("subcategory")
    )
    pc = category.select("productcategoryid", F.col("name").alias("category"))
    margin_pct = F.when(
        F.col("listprice") > 0,
        (F.col("listprice").cast("double") - F.col("standardcost").cast("double"))
        / F.col("listprice").cast("double")
        * F.lit(100.0),
    )
    agg = (
        p.join(psc, "productsubcategoryid")
        .join(pc, "productcategoryid")
        .groupBy("category", "subcategory")
        .agg(
            F.count("productid").alias("product_count"),
            exact_avg("standardcost").alias("avg_cost"),
            exact_avg("listprice").alias("avg_list"),
            exact_avg(F.col("listprice") - F.col("standardcost")).alias("avg_margin"),
            F.avg(margin_pct).alias("avg_margin_pct_raw"),
            F.min("listprice").alias("min_price"),
            F.max("listprice").alias("max_price"),
        )
    )
    return agg.select(
        "category",
        "subcategory",
        F.col("product_count").cast("long"),
        round_money("avg_cost").alias("avg_standard_cost"),
        round_money("avg_list").alias("avg_list_price"),
        round_money("avg_margin").alias("avg_gross_margin"),
        round_ratio("avg_margin_pct_raw").alias("avg_margin_pct"),
        round_money("min_price").alias("min_price"),
        round_money("max_price").alias("max_price"),
    ).orderBy(F.col("avg_margin_pct").desc_nulls_first(), "category", "subcategory")


def territory_growth(soh: DataFrame, territory: DataFrame, calendar_exact: bool = False) -> DataFrame:
    """Monthly revenue per territory with month-over-month and year-over-year growth.

    ``LAG(revenue, 1)`` / ``LAG(revenue, 12)`` are positional over the territory's
    months, as in the original report (a missing month shifts the comparison).  With
    ``calendar_exact=True`` the previous month / same month last year are looked up by
    month number instead (RANGE window frames), which is immune to gaps.

    The window partitions by territory; each partition holds one row per month, so
    its size is bounded by the calendar however many orders a territory has.
    """
    st = territory.select(
        "territoryid", F.col("name").alias("territory"), F.col("countryregioncode").alias("country")
    )
    # customers are counted by a second aggregate over one row per customer and month:
    # orders are combined on the way, and no row is expanded for the distinct count
    per_customer = (
        soh.join(st, "territoryid")
        .groupBy("territory", "country", month_start("orderdate").alias("period_date"), "customerid")
        .agg(F.sum("subtotal").alias("revenue"), F.count("salesorderid").alias("order_count"))
    )
    monthly = per_customer.groupBy("territory", "country", "period_date").agg(
        F.round(F.sum("revenue"), 2).alias("revenue"),
        F.sum("order_count").alias("order_count"),
        F.count("customerid").alias("unique_customers"),
    )
    if calendar_exact:
        # RANGE frames over a month number pick exactly the row 1 / 12 months earlier
        # (NULL when that month is missing): one window pass, no self-join
        m = F.year("period_date") * 12 + F.month("period_date")
        monthly = monthly.withColumn("_month_no", m)
        w = Window.partitionBy("territory").orderBy("_month_no")
        with_lags = monthly.select(
            "*",
            # a NULL month has no month before it
            F.when(F.col("_month_no").isNotNull(), F.max("revenue").over(w.rangeBetween(-1, -1))).alias("prev_rev"),
            F.when(F.col("_month_no").isNotNull(), F.max("revenue").over(w.rangeBetween(-12, -12))).alias("ly_rev"),
        )
    else:
        w = Window.partitionBy("territory").orderBy(asc_nulls_last("period_date"))
        with_lags = monthly.select(
            "*",
            F.lag("revenue", 1).over(w).alias("prev_rev"),
            F.lag("revenue", 12).over(w).alias("ly_rev"),
        )
    return with_lags.select(
        "territory",
        "country",
        year_month("period_date").alias("period"),
        F.col("revenue").cast("double"),
        F.col("order_count").cast("long"),
        F.col("unique_customers").cast("long"),
        F.col("prev_rev").cast("double").alias("prev_month_revenue"),
        growth_pct("revenue", "prev_rev").alias("mom_growth_pct"),
        F.col("ly_rev").cast("double").alias("same_month_last_year"),
        growth_pct("revenue", "ly_rev").alias("yoy_growth_pct"),
    ).orderBy(asc_nulls_last("territory"), asc_nulls_last("period"))


def territory_yoy_variance(territory: DataFrame) -> DataFrame:
    """Row-wise territory sales and cost: this year vs last year, trend, cost ratio."""
    ytd, ly = F.col("salesytd"), F.col("saleslastyear")
    cytd, cly = F.col("costytd"), F.col("costlastyear")
    trend = (
        F.when(ytd > ly, F.lit(TREND_GROWING))
        .when(ytd == ly, F.lit(TREND_FLAT))
        .otherwise(F.lit(TREND_DECLINING))
    )
    growth = growth_pct(ytd, ly)
    return territory.select(
        F.col("name").alias("territory"),
        F.col("countryregioncode").alias("country"),
        F.col("group").alias("region_group"),
        round_money(ytd).alias("actual_sales_ytd"),
        round_money(ly).alias("sales_last_year"),
        round_money(cytd).alias("actual_cost_ytd"),
        round_money(cly).alias("cost_last_year"),
        round_money(ytd - ly).alias("revenue_yoy_variance"),
        growth.alias("revenue_yoy_growth_pct"),
        trend.alias("revenue_trend"),
        round_money(cytd - cly).alias("cost_yoy_variance"),
        growth_pct(cytd, cly).alias("cost_yoy_change_pct"),
        pct(cytd, ytd).alias("cost_to_revenue_ratio_pct"),
    ).orderBy(F.col("revenue_yoy_growth_pct").desc_nulls_first(), "territory")


def salesperson_attainment(
    salesperson: DataFrame,
    employee: DataFrame,
    person: DataFrame,
    territory: DataFrame,
    distributed: bool = True,
) -> DataFrame:
    """Quota attainment per salesperson with a global performance rank.

    The rank orders by YTD / quota descending with NULL first (a zero quota has no
    ratio and ranks 1, as in PostgreSQL).  Salespeople without a quota are dropped.
    """
    sp = salesperson.where(F.col("salesquota").isNotNull())
    e = employee.select("businessentityid")
    p = person.select("businessentityid", "firstname", "lastname")
    st = territory.select("territoryid", F.col("name").alias("territory"))
    joined = (
        sp.join(e, "businessentityid")
        .join(p, "businessentityid")
        .join(st, "territoryid", "left")
        .withColumn("ratio", safe_div("salesytd", "salesquota"))
    )
    ranker = rank_and_running_total if distributed else single_partition_rank_and_running_total
    ranked = ranker(
        joined, "ratio", ["businessentityid"], None,
        descending=True, nulls_first=True, rank_col="performance_rank",
    )
    return ranked.select(
        F.concat(F.col("firstname"), F.lit(" "), F.col("lastname")).alias("salesperson_name"),
        "territory",
        round_money("salesquota").alias("quota"),
        round_money("salesytd").alias("actual_ytd"),
        round_money("saleslastyear").alias("last_year_sales"),
        round_money(F.col("salesytd") - F.col("salesquota")).alias("variance"),
        pct("salesytd", "salesquota").alias("attainment_pct"),
        F.col("performance_rank").cast("long"),
        round_money("bonus").alias("bonus"),
        round_money(F.col("commissionpct") * F.lit(100)).alias("commission_pct"),
        "businessentityid",
    ).orderBy(F.col("attainment_pct").desc_nulls_first(), "businessentityid").drop(
        "businessentityid"
    )


def promotion_impact(offer: DataFrame, sod: DataFrame) -> DataFrame:
    """Per special offer: lines, units, gross / discount / net revenue and rates.

    Few offers, many lines: the partial aggregate combines each offer's lines map-side,
    so a dominant offer (e.g. 'No Discount') never lands in one task.
    """
    price_qty = F.col("unitprice") * F.col("orderqty")
    per_offer = sod.groupBy("specialofferid").agg(
        F.count("salesorderdetailid").alias("line_items_sold"),
        F.sum("orderqty").alias("total_units"),
        F.sum(price_qty).alias("gross_raw"),
        F.sum(price_qty * F.col("unitpricediscount")).alias("discount_raw"),
        F.sum(price_qty * (F.lit(1) - F.col("unitpricediscount"))).alias("net_raw"),
    )
    so = offer.select(
        "specialofferid",
        F.col("description").alias("offer_description"),
        F.col("type").alias("offer_type"),
        F.col("category").alias("offer_category"),
        "discountpct",
    )
    # pre-aggregated lines joined to the offer dimension (inner: offers without sales
    # disappear); grouping keys of the original query are all offer attributes
    j = so.join(per_offer, "specialofferid").select(
        "*",
        F.round("gross_raw", 2).alias("gross"),
        F.round("discount_raw", 2).alias("disc"),
        F.round("net_raw", 2).alias("net"),
    )
    return j.select(
        "offer_description",
        "offer_type",
        "offer_category",
        round_money(F.col("discountpct") * F.lit(100)).alias("discount_pct"),
        F.col("line_items_sold").cast("long"),
        F.col("total_units").cast("long"),
        F.col("gross").cast("double").alias("gross_revenue"),
        F.col("disc").cast("double").alias("total_discount_given"),
        F.col("net").cast("double").alias("net_revenue"),
        pct("disc", "gross").alias("effective_discount_rate_pct"),
        exact_ratio("net", "line_items_sold").alias("revenue_per_line_item"),
    ).orderBy(F.col("net_revenue").desc_nulls_first(), "offer_description")
