"""Streaming scoring, CSV export with observed row counts, SQL over the views."""

import csv
import glob
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlark import reports
from ledgerlark.operators import anomaly, iforest
from ledgerlark.sources.standin import standin
from ledgerlark.streaming.scoring import batch_group_stats, score_stream, start_scoring
from tests.conftest import SF_SMALL

KEY = ["purchaseorderid", "vendorid", "purchaseorderdetailid", "productid"]


def test_stream_scoring_matches_batch(spark):
    t = standin(spark, SF_SMALL)
    base = reports.line_base(t)
    scratch = tempfile.mkdtemp(prefix="ledgerlark-stream-")
    src = os.path.join(scratch, "arriving")
    base.write.parquet(src)
    model = iforest.fixed_forest(anomaly.FEATURES)
    batch = reports.detect(reports.featured_lines(t), model)
    thr = anomaly.contamination_threshold(batch)
    stats = batch_group_stats(base)

    stream = spark.readStream.schema(base.schema).parquet(src)
    q = (
        score_stream(stream, stats, model, thr)
        .writeStream.format("memory").queryName("scored_lines").outputMode("append").start()
    )
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_lines").select(*KEY, "anomaly_raw", "is_anomaly", "anomaly_flag")
    want = batch.select(*KEY, "anomaly_raw", "is_anomaly", "anomaly_flag")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0

    out = os.path.join(scratch, "out")
    q2 = start_scoring(stream, stats, model, thr, out, os.path.join(scratch, "ckpt"))
    q2.processAllAvailable()
    q2.stop()
    assert spark.read.parquet(out).count() == base.count()


def test_csv_export_counts_and_format(spark):
    t = standin(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="ledgerlark-csv-")
    counts = reports.export({"vendor_spend_ranked": reports.procurement_reports(t)["vendor_spend_ranked"]}, out)
    n = t.vendor.count()
    assert counts == {"vendor_spend_ranked": n}
    rows = []
    for f in sorted(glob.glob(os.path.join(out, "vendor_spend_ranked", "part-*.csv"))):
        with open(f, newline="") as fh:
            rows.extend(csv.DictReader(fh))
    assert len(rows) == n
    assert {r["is_preferred"] for r in rows} <= {"True", "False"}


def test_sql_over_registered_views(spark):
    t = standin(spark, SF_SMALL)
    t.register_views()
    got = spark.sql(
        "SELECT COUNT(DISTINCT poh.vendorid) AS n FROM purchaseorderheader poh "
        "JOIN vendor v ON v.businessentityid = poh.vendorid"
    ).first().n
    assert got == spend_vendors(t)


def spend_vendors(t):
    return t.purchaseorderheader.select("vendorid").distinct().count()


def test_run_metrics_and_breakdown_consistent(spark):
    t = standin(spark, SF_SMALL)
    labelled = reports.detect(reports.featured_lines(t), iforest.fixed_forest(anomaly.FEATURES))
    m = anomaly.run_metrics(labelled).first()
    b = anomaly.anomaly_breakdown(labelled).agg(F.sum("count")).first()[0] or 0
    assert m.n_flagged == b
    assert m.n_flagged <= 0.03 * m.n_lines + 1


def test_csv_number_format(spark):
    from ledgerlark.sources.sinks import _pandas_style

    df = spark.createDataFrame(
        [(866774125.69, 0.0, None, float("nan"), -2.5, True)],
        "a double, b double, c double, d double, e double, f boolean",
    )
    r = _pandas_style(df).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("866774125.69", "0.0", None, None, "-2.5", "True")


def test_fitted_forest_reports_end_to_end(spark):
    t = standin(spark, SF_SMALL)
    out = reports.anomaly_reports(t)
    rep = out["anomaly_report"]
    rows = rep.select("anomaly_raw", "is_anomaly", "anomaly_flag").collect()
    scores = [r.anomaly_raw for r in rows]
    assert scores == sorted(scores)  # most anomalous first
    flagged = [r for r in rows if r.is_anomaly]
    assert 0 < len(flagged) <= 0.03 * len(rows) + 1
    assert all(r.anomaly_flag != "Normal" for r in flagged)
    assert all(r.anomaly_flag == "Normal" for r in rows if not r.is_anomaly)
    # every flagged score lies strictly below every unflagged one
    assert max(r.anomaly_raw for r in flagged) < min(r.anomaly_raw for r in rows if not r.is_anomaly)
    summary = out["anomaly_summary"].agg(
        F.sum("total_line_items").alias("n"), F.sum("flagged_items").alias("f")
    ).first()
    assert (summary.n, summary.f) == (len(rows), len(flagged))
    breakdown = out["anomaly_breakdown"].agg(F.sum("count")).first()[0]
    assert breakdown == len(flagged)
    assert out["run_metrics"].first().n_flagged == len(flagged)


def test_package_shipped_to_workers(spark):
    import zipfile

    from ledgerlark import session

    session.ship_package(spark)
    session.ship_package(spark)  # once per SparkContext
    assert spark.sparkContext.applicationId in session._SHIPPED
    names = set(zipfile.ZipFile(session._PACKAGE_ZIP).namelist())
    for module in ("ledgerlark/__init__.py", "ledgerlark/plans/globalwin.py",
                   "ledgerlark/operators/iforest.py", "ledgerlark/session.py"):
        assert module in names
