"""Vendor-spend operators (workload operators 1-4).

Inputs are the logical tables as DataFrames.  ``po_key`` names the columns that join
a purchase-order header to its lines (``("purchaseorderid",)`` on the original
schema; the stand-in tables use ``("vendorid", "purchaseorderid")``).

Plan shape shared by all of them: join header to lines on the PO key, aggregate to
one row per vendor / month (partial + final hash aggregate, so a hot vendor is
pre-combined map-side), and only then join the small dimension side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.exprs import (
    asc_nulls_last,
    exact_avg,
    lead_days,
    month_start,
    pct,
    round_money,
    round_ratio,
    year_month,
)
from ledgerlark.plans.globalwin import (
    rank_and_running_total,
    single_partition_rank_and_running_total,
)

DEFAULT_PO_KEY = ("purchaseorderid",)

# Purchase-order status codes and Pareto tier labels.
STATUS_PENDING, STATUS_APPROVED, STATUS_REJECTED, STATUS_COMPLETE = 1, 2, 3, 4
TIER_CRITICAL = "Critical Vendor"
TIER_TAIL = "Tail Spend"


def _ranker(distributed: bool):
    return rank_and_running_total if distributed else single_partition_rank_and_running_total


def po_lines(poh: DataFrame, pod: DataFrame, po_key=DEFAULT_PO_KEY, header_cols=()) -> DataFrame:
    """Purchase-order lines joined to their header (inner join on the PO key)."""
    key = list(po_key)
    hcols = list(dict.fromkeys(key + ["vendorid", *header_cols]))
    pcols = [c for c in pod.columns if c not in hcols or c in key]
    return poh.select(*hcols).join(pod.select(*pcols), key)


def vendor_spend_ranked(
    vendor: DataFrame,
    poh: DataFrame,
    pod: DataFrame,
    po_key=DEFAULT_PO_KEY,
    distributed: bool = True,
) -> DataFrame:
    """Per vendor: orders, units, spend, average unit price, spend rank, running spend.

    RANK is on the unrounded spend (ties share a rank, the next rank is skipped); the
    running total follows spend descending with vendor id as the tie order, and both
    spend figures are rounded only at the end.
    """
    lines = po_lines(poh, pod, po_key)
    per_vendor = lines.groupBy("vendorid").agg(
        F.count_distinct(*[F.col(c) for c in po_key]).alias("total_orders"),
        F.sum("orderqty").alias("total_units_ordered"),
        F.sum(F.col("orderqty") * F.col("unitprice")).alias("spend_raw"),
        exact_avg("unitprice").alias("avg_raw"),
    )
    v = vendor.select(
        F.col("businessentityid").alias("vendor_id"),
        F.col("name").alias("vendor_name"),
        "creditrating",
        F.col("preferredvendorstatus").alias("is_preferred"),
    )
    joined = v.join(per_vendor, v.vendor_id == per_vendor.vendorid).drop("vendorid")
    ranked = _ranker(distributed)(
        joined, "spend_raw", ["vendor_id"], "spend_raw",
        rank_col="spend_rank", running_col="running_raw",
    )
    return ranked.select(
        F.col("vendor_id").cast("long"),
        "vendor_name",
        F.col("creditrating").cast("long"),
        "is_preferred",
        F.col("total_orders").cast("long"),
        F.col("total_units_ordered").cast("long"),
        round_money("spend_raw").alias("total_spend"),
        round_money("avg_raw").alias("avg_unit_price"),
        F.col("spend_rank").cast("long"),
        round_money("running_raw").alias("running_total_spend"),
    ).orderBy("spend_rank", "vendor_id")


def vendor_pareto(
    vendor: DataFrame,
    poh: DataFrame,
    pod: DataFrame,
    po_key=DEFAULT_PO_KEY,
    threshold: float = 80,
    distributed: bool = True,
) -> DataFrame:
    """80/20 classification: share and cumulative share of rounded vendor spend."""
    lines = po_lines(poh, pod, po_key)
    per_vendor = lines.groupBy("vendorid").agg(
        F.round(F.sum(F.col("orderqty") * F.col("unitprice")), 2).alias("total_spend_dec")
    )
    vs = vendor.select(
        F.col("businessentityid").alias("vendor_id"), F.col("name").alias("vendor_name")
    ).join(per_vendor, F.col("vendor_id") == per_vendor.vendorid).drop("vendorid")
    ranked = _ranker(distributed)(
        vs, "total_spend_dec", ["vendor_id"], "total_spend_dec",
        rank_col="spend_rank", running_col="cum_spend",
    )
    # grand total of the rounded vendor totals, as a scalar subquery over the ranked
    # rows (the distributed ranker has materialized them: no second pass over lines)
    ranked = ranked.withColumn("grand_total", ranked.agg(F.sum("total_spend_dec")).scalar())
    cumulative = pct("cum_spend", "grand_total")
    return ranked.select(
        F.col("vendor_id").cast("long"),
        "vendor_name",
        F.col("total_spend_dec").cast("double").alias("total_spend"),
        pct("total_spend_dec", "grand_total").alias("spend_pct"),
        cumulative.alias("cumulative_pct"),
        F.col("spend_rank").cast("long"),
        F.when(cumulative <= F.lit(threshold), F.lit(TIER_CRITICAL))
        .otherwise(F.lit(TIER_TAIL))
        .alias("vendor_tier"),
    ).orderBy("spend_rank", "vendor_id")


def po_status_breakdown(vendor: DataFrame, poh: DataFrame) -> DataFrame:
    """Per (vendor name, credit rating): PO counts by status, rejection %, value, lead time."""

    def n_status(code: int):
        return F.sum(F.when(F.col("status") == code, 1).otherwise(0))

    lead = lead_days("orderdate", "shipdate")
    # pre-aggregate per vendor id, then merge vendors that share (name, rating)
    per_vendor = poh.groupBy("vendorid").agg(
        F.count("purchaseorderid").alias("n_pos"),
        n_status(STATUS_PENDING).alias("n1"),
        n_status(STATUS_APPROVED).alias("n2"),
        n_status(STATUS_REJECTED).alias("n3"),
        n_status(STATUS_COMPLETE).alias("n4"),
        F.sum("subtotal").alias("value"),
        F.sum(lead).alias("lead_sum"),
        F.count(lead).alias("lead_n"),
    )
    v = vendor.select("businessentityid", F.col("name").alias("vendor_name"), "creditrating")
    grouped = (
        v.join(per_vendor, v.businessentityid == per_vendor.vendorid)
        .groupBy("vendor_name", "creditrating")
        .agg(
            F.sum("n_pos").alias("total_pos"),
            F.sum("n1").alias("pending"),
            F.sum("n2").alias("approved"),
            F.sum("n3").alias("rejected"),
            F.sum("n4").alias("complete"),
            F.sum("value").alias("value"),
            F.sum("lead_sum").alias("lead_sum"),
            F.sum("lead_n").alias("lead_n"),
        )
    )
    return grouped.select(
        "vendor_name",
        F.col("creditrating").cast("long"),
        F.col("total_pos").cast("long"),
        F.col("pending").cast("long"),
        F.col("approved").cast("long"),
        F.col("rejected").cast("long"),
        F.col("complete").cast("long"),
        pct("rejected", "total_pos").alias("rejection_rate_pct"),
        round_money("value").alias("total_po_value"),
        round_ratio(F.col("lead_sum") / F.nullif(F.col("lead_n").cast("double"), F.lit(0.0)), 1)
        .alias("avg_lead_time_days"),
    ).orderBy(F.col("total_po_value").desc_nulls_first(), "vendor_name", "creditrating")


def monthly_spend_vs_revenue(
    poh: DataFrame, pod: DataFrame, soh: DataFrame, po_key=DEFAULT_PO_KEY
) -> DataFrame:
    """Monthly sales revenue (left side) with the month's vendor spend and prior month.

    Months without revenue are dropped (revenue is the preserved side).  The LAG runs
    over months: at most 12 rows per calendar year, so the one-partition window is
    bounded by the calendar, not by the data volume.
    """
    lines = po_lines(poh, pod, po_key, header_cols=("orderdate",))
    spend = lines.groupBy(month_start("orderdate").alias("month")).agg(
        F.round(F.sum(F.col("orderqty") * F.col("unitprice")), 2).alias("total_spend")
    )
    revenue = soh.groupBy(month_start("orderdate").alias("month")).agg(
        F.round(F.sum("subtotal"), 2).alias("total_revenue"),
        F.count("salesorderid").alias("order_count"),  # the header's key: each once
    )
    spend_c = F.coalesce(F.col("total_spend"), F.lit(0).cast("decimal(38,2)"))
    joined = revenue.join(spend, "month", "left").withColumn("spend_c", spend_c)
    w = Window.orderBy(asc_nulls_last("month"))
    return joined.select(
        year_month("month").alias("period"),
        F.col("month").alias("period_date"),
        F.col("total_revenue").cast("double"),
        F.col("spend_c").cast("double").alias("total_vendor_spend"),
        F.col("order_count").cast("long"),
        pct("spend_c", "total_revenue").alias("spend_to_revenue_ratio_pct"),
        F.lag("spend_c").over(w).cast("double").alias("prior_month_spend"),
    ).orderBy(asc_nulls_last("period_date"))
