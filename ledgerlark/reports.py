"""Report runs: every workload report from one set of logical tables, exported as CSV.

    python -m ledgerlark.reports --standin /root/testdata/sf0.01 --out /some/dir
    python -m ledgerlark.reports --parquet /data/logical_tables --out /some/dir

The logical tables come either from the stand-in mapping over the test tables or
from 13 parquet tables named ``schema.table``.  Each report is written as its own CSV
directory; row counts are collected with ``DataFrame.observe`` during the write (no
second pass over the data).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlark.operators import anomaly, iforest, revenue, spend
from ledgerlark.plans.spool import scope, spool
from ledgerlark.session import build_session, ensure_checkpoint_dir
from ledgerlark.sources.sinks import write_csv

LINE_KEY = ["purchaseorderid", "vendorid", "purchaseorderdetailid", "productid"]


def line_base(t) -> DataFrame:
    return anomaly.po_line_base(
        t.purchaseorderheader, t.purchaseorderdetail, t.vendor, t.product,
        t.productsubcategory, t.productcategory, po_key=t.po_key,
    )


#: What the features are worked out from.
FEATURE_INPUTS = ["unitprice", "standardcost", "orderqty", "rejectedqty", "line_total", "po_subtotal"]


def featured_lines(t, columns: list[str] | None = None) -> DataFrame:
    """PO lines with group price statistics and the eight model features.

    Only the line's key and ``columns`` of them, if given: the lines are shuffled to their
    statistics, and where products have many lines spooled before, which costs by their width.
    """
    lines, small = line_base(t), anomaly.few_lines_a_product(t.purchaseorderdetail)
    if columns is None:
        return anomaly.line_features(anomaly.group_price_stats(lines, small=small))
    lines = lines.select(*[c for c in lines.columns if c in {*LINE_KEY, *FEATURE_INPUTS, *columns}])
    found = anomaly.line_features(anomaly.group_price_stats(lines, small=small))
    return found.select(*[c for c in found.columns if c in {*LINE_KEY, *columns}])


#: What the vendor summary reads of the lines, and what the other reports beyond the line report do.
SUMMARY = ["purchaseorderdetailid", "vendor_name", "line_total", "z_score", "rejection_rate"]
NARROW = [*LINE_KEY, "price_deviation", "z_score", "rejection_rate"]
#: What the line report reads.
REPORT = [*LINE_KEY, *anomaly.REPORT_COLUMNS]


def fit_forest(featured: DataFrame, **kw) -> iforest.IsolationForestModel:
    row_key = [c for c in LINE_KEY if c in featured.columns]
    return iforest.iforest_fit(featured, anomaly.FEATURES, row_key=row_key, **kw)


def detect(
    featured: DataFrame,
    model,
    contamination: float = anomaly.CONTAMINATION,
    columns: list[str] | None = None,
) -> DataFrame:
    """Score -> spool -> contamination threshold -> flags -> labels.

    The scored lines are spooled once, only ``columns`` of them if given: the exact
    threshold reads the scores alone, the reports what they need, and the forest is never
    evaluated again.
    """
    scored = iforest.iforest_score(featured, model)
    if columns is not None:
        scored = scored.select(*[c for c in scored.columns if c in {*columns, "anomaly_raw"}])
    scored = spool(scored, "scored")
    return anomaly.anomaly_label(anomaly.contamination_flag(scored, "anomaly_raw", contamination))


def procurement_reports(t) -> dict[str, DataFrame]:
    poh, pod, key = t.purchaseorderheader, t.purchaseorderdetail, t.po_key
    return {
        "vendor_spend_ranked": spend.vendor_spend_ranked(t.vendor, poh, pod, po_key=key),
        "vendor_pareto": spend.vendor_pareto(t.vendor, poh, pod, po_key=key),
        "po_status_breakdown": spend.po_status_breakdown(t.vendor, poh),
        "monthly_spend_vs_revenue": spend.monthly_spend_vs_revenue(
            poh, pod, t.salesorderheader_untagged, po_key=key
        ),
        "margin_by_category": revenue.margin_by_category(
            t.product, t.productsubcategory, t.productcategory
        ),
        "territory_growth": revenue.territory_growth(t.salesorderheader, t.salesterritory),
        "territory_yoy_variance": revenue.territory_yoy_variance(t.salesterritory),
        "salesperson_attainment": revenue.salesperson_attainment(
            t.salesperson, t.employee, t.person, t.salesterritory
        ),
        "promotion_impact": revenue.promotion_impact(t.specialoffer, t.salesorderdetail),
        "price_deviation_flags": anomaly.price_deviation_flags(
            poh, pod, t.vendor, t.product, t.productsubcategory, t.productcategory, po_key=key
        ),
    }


def anomaly_reports(t, model=None) -> dict[str, DataFrame]:
    featured = spool(featured_lines(t, [*REPORT, *anomaly.FEATURES]), "features")
    model = model or fit_forest(featured)
    labelled = detect(featured, model)
    return {
        "anomaly_report": anomaly.anomaly_report(labelled),
        "anomaly_summary": anomaly.anomaly_summary(labelled),
        "anomaly_breakdown": anomaly.anomaly_breakdown(labelled),
        "run_metrics": anomaly.run_metrics(labelled),
    }


def export(reports: dict[str, DataFrame], out_dir: str) -> dict[str, int]:
    """Write each report as CSV under ``out_dir``; return its row count."""
    counts = {}
    for name, df in reports.items():
        obs = Observation(name)
        write_csv(df.observe(obs, F.count(F.lit(1)).alias("rows")), os.path.join(out_dir, name))
        counts[name] = int(obs.get["rows"])
    return counts


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--standin", help="directory of the TPC-H style test tables")
    src.add_argument("--parquet", help="directory of the 13 logical tables (schema.table.parquet)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    spark = build_session(args.master)
    ensure_checkpoint_dir(spark)
    if args.standin:
        from ledgerlark.sources.standin import standin

        t = standin(spark, args.standin)
    else:
        from ledgerlark.sources.parquet import LogicalTables

        t = LogicalTables.from_parquet(spark, args.parquet)
    with scope(spark):  # what the reports spool goes when they are written
        counts = export(procurement_reports(t), args.out)
        counts.update(export(anomaly_reports(t), args.out))
    for name, n in counts.items():
        print(f"{name}: {n:,} rows")


if __name__ == "__main__":
    main()
