"""Named workload queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry wires the stand-in logical tables of one test-data directory into an
operator.  ``__spark_entry__.queries()`` exposes this registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark import reports
from ledgerlark.functions.exprs import round_ratio
from ledgerlark.operators import anomaly, iforest, revenue, spend
from ledgerlark.plans.spool import spool
from ledgerlark.sources.standin import standin

QueryFn = Callable[[SparkSession, str], DataFrame]


def _vendor_spend_ranked(spark, sf_dir):
    t = standin(spark, sf_dir)
    return spend.vendor_spend_ranked(
        t.vendor, t.purchaseorderheader, t.purchaseorderdetail, po_key=t.po_key
    )


def _vendor_pareto(spark, sf_dir):
    t = standin(spark, sf_dir)
    return spend.vendor_pareto(
        t.vendor, t.purchaseorderheader, t.purchaseorderdetail, po_key=t.po_key
    )


def _po_status_breakdown(spark, sf_dir):
    t = standin(spark, sf_dir)
    return spend.po_status_breakdown(t.vendor, t.purchaseorderheader)


def _monthly_spend_vs_revenue(spark, sf_dir):
    t = standin(spark, sf_dir)
    return spend.monthly_spend_vs_revenue(
        t.purchaseorderheader, t.purchaseorderdetail, t.salesorderheader_untagged,
        po_key=t.po_key,
    )


def _margin_by_category(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.margin_by_category(t.product, t.productsubcategory, t.productcategory)


def _territory_growth(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.territory_growth(t.salesorderheader, t.salesterritory)


def _territory_growth_calendar(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.territory_growth(t.salesorderheader, t.salesterritory, calendar_exact=True)


def _territory_yoy_variance(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.territory_yoy_variance(t.salesterritory)


def _salesperson_attainment(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.salesperson_attainment(t.salesperson, t.employee, t.person, t.salesterritory)


def _promotion_impact(spark, sf_dir):
    t = standin(spark, sf_dir)
    return revenue.promotion_impact(t.specialoffer, t.salesorderdetail)


# ---- anomaly detection ---------------------------------------------------------

LINE_ID_COLS = ["purchaseorderid", "purchaseorderdetailid", "vendorid", "productid"]


def _line_base(spark, sf_dir):
    return reports.line_base(standin(spark, sf_dir))


def _featured(spark, sf_dir, columns=()):
    """The lines' keys and features, and ``columns``."""
    return reports.featured_lines(standin(spark, sf_dir), [*anomaly.FEATURES, *columns])


_detect = reports.detect


def _labelled_fixed(spark, sf_dir, columns):
    return _detect(_featured(spark, sf_dir, columns), iforest.fixed_forest(anomaly.FEATURES), columns=columns)


def _labelled_iforest(spark, sf_dir, columns):
    featured = spool(_featured(spark, sf_dir, columns), "features")
    return _detect(featured, reports.fit_forest(featured), columns=columns)


def _price_deviation_flags(spark, sf_dir):
    t = standin(spark, sf_dir)
    return anomaly.price_deviation_flags(
        t.purchaseorderheader, t.purchaseorderdetail, t.vendor, t.product,
        t.productsubcategory, t.productcategory, po_key=t.po_key,
    )


def _price_deviation_flags_by_subcategory(spark, sf_dir):
    t = standin(spark, sf_dir)
    return anomaly.price_deviation_flags(
        t.purchaseorderheader, t.purchaseorderdetail, t.vendor, t.product,
        t.productsubcategory, t.productcategory, po_key=t.po_key,
        group_keys=("vendorid", "subcategory"),
    )


def _po_line_base(spark, sf_dir):
    return anomaly.as_report(_line_base(spark, sf_dir))


def _group_price_stats(spark, sf_dir):
    small = anomaly.few_lines_a_product(standin(spark, sf_dir).purchaseorderdetail)
    df = anomaly.group_price_stats(_line_base(spark, sf_dir).select(*LINE_ID_COLS, "unitprice"), small=small)
    return anomaly.as_report(
        df.select(*LINE_ID_COLS, "unitprice", "vp_avg_price", "vp_std_price", "vp_count"),
        round_features=6,
    )


def _line_features(spark, sf_dir):
    df = _featured(spark, sf_dir, ["price_deviation"])
    return anomaly.as_report(
        df.select(*LINE_ID_COLS, "price_deviation", *anomaly.FEATURES), round_features=6
    )


def _standardize(spark, sf_dir):
    df = anomaly.standardize(_featured(spark, sf_dir).select(*LINE_ID_COLS, *anomaly.FEATURES), anomaly.FEATURES)
    return anomaly.as_report(
        df.select(*LINE_ID_COLS, *[f"{c}_scaled" for c in anomaly.FEATURES]), round_features=6
    )


def _iforest_model(spark, sf_dir):
    featured = spool(_featured(spark, sf_dir).select(*LINE_ID_COLS, *anomaly.FEATURES), "features")
    nodes, _ = iforest.fit_nodes(featured, anomaly.FEATURES, reports.LINE_KEY)
    return nodes.withColumn("threshold", round_ratio("threshold", 6))


def _iforest_scores(spark, sf_dir):
    featured = spool(_featured(spark, sf_dir).select(*LINE_ID_COLS, *anomaly.FEATURES), "features")
    model = reports.fit_forest(featured)
    return anomaly.as_report(
        iforest.iforest_score(featured, model).select(*LINE_ID_COLS, "anomaly_raw"),
        round_features=6,
    )


def _fixed_forest_scores(spark, sf_dir):
    model = iforest.fixed_forest(anomaly.FEATURES)
    return anomaly.as_report(
        iforest.iforest_score(_featured(spark, sf_dir), model).select(*LINE_ID_COLS, "anomaly_raw"),
        round_features=6,
    )


def _contamination_flag(spark, sf_dir):
    df = _labelled_fixed(spark, sf_dir, reports.NARROW)
    return anomaly.as_report(
        df.select(*LINE_ID_COLS, "anomaly_raw", "is_anomaly", "anomaly_score"), round_features=6
    )


def _anomaly_label(spark, sf_dir):
    df = _labelled_fixed(spark, sf_dir, reports.NARROW)
    return anomaly.as_report(
        df.select(*LINE_ID_COLS, "is_anomaly", "z_score", "rejection_rate", "anomaly_flag"),
        round_features=6,
    )


def _anomaly_report(spark, sf_dir):
    return anomaly.as_report(anomaly.anomaly_report(_labelled_fixed(spark, sf_dir, reports.REPORT)), round_features=6)


def _compared(summary):
    """z statistics rounded for the value comparison with SQL (adding 0 drops the sign of -0)."""
    return summary.withColumns({
        c: round_ratio(c, n) + F.lit(0.0) for c, n in (("avg_z_score", 3), ("max_z_score", 4))
    })


def _anomaly_summary(spark, sf_dir):
    return _compared(anomaly.anomaly_summary(_labelled_fixed(spark, sf_dir, reports.SUMMARY)))


def _anomaly_breakdown(spark, sf_dir):
    return anomaly.anomaly_breakdown(_labelled_fixed(spark, sf_dir, reports.NARROW))


def _run_metrics(spark, sf_dir):
    return anomaly.run_metrics(_labelled_fixed(spark, sf_dir, reports.NARROW))


def _anomaly_report_iforest(spark, sf_dir):
    return anomaly.as_report(anomaly.anomaly_report(_labelled_iforest(spark, sf_dir, reports.REPORT)), round_features=6)


def _anomaly_summary_iforest(spark, sf_dir):
    return _compared(anomaly.anomaly_summary(_labelled_iforest(spark, sf_dir, reports.SUMMARY)))


def _anomaly_breakdown_iforest(spark, sf_dir):
    return anomaly.anomaly_breakdown(_labelled_iforest(spark, sf_dir, reports.NARROW))


def _run_metrics_iforest(spark, sf_dir):
    return anomaly.run_metrics(_labelled_iforest(spark, sf_dir, reports.NARROW))


QUERIES: dict[str, QueryFn] = {
    "vendor_spend_ranked": _vendor_spend_ranked,
    "vendor_pareto": _vendor_pareto,
    "po_status_breakdown": _po_status_breakdown,
    "monthly_spend_vs_revenue": _monthly_spend_vs_revenue,
    "margin_by_category": _margin_by_category,
    "territory_growth": _territory_growth,
    "territory_growth_calendar": _territory_growth_calendar,
    "territory_yoy_variance": _territory_yoy_variance,
    "salesperson_attainment": _salesperson_attainment,
    "promotion_impact": _promotion_impact,
    "price_deviation_flags": _price_deviation_flags,
    "price_deviation_flags_by_subcategory": _price_deviation_flags_by_subcategory,
    "po_line_base": _po_line_base,
    "group_price_stats": _group_price_stats,
    "line_features": _line_features,
    "standardize": _standardize,
    "iforest_model": _iforest_model,
    "iforest_scores": _iforest_scores,
    "fixed_forest_scores": _fixed_forest_scores,
    "contamination_flag": _contamination_flag,
    "anomaly_label": _anomaly_label,
    "anomaly_report": _anomaly_report,
    "anomaly_summary": _anomaly_summary,
    "anomaly_breakdown": _anomaly_breakdown,
    "run_metrics": _run_metrics,
    "anomaly_report_iforest": _anomaly_report_iforest,
    "anomaly_summary_iforest": _anomaly_summary_iforest,
    "anomaly_breakdown_iforest": _anomaly_breakdown_iforest,
    "run_metrics_iforest": _run_metrics_iforest,
}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)
