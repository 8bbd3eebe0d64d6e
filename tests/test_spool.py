"""Spooled tables: read back pruned, removed with their scope."""

import os

import pytest

from ledgerlark import reports
from ledgerlark.operators import anomaly
from ledgerlark.plans.spool import scope, spool
from ledgerlark.session import ensure_checkpoint_dir
from ledgerlark.sources.standin import standin
from tests.conftest import SF_SMALL


def _spooled(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("spool-")}


def test_scope_leaves_nothing_behind(spark, tmp_path):
    before = _spooled(spark)
    with scope(spark):
        t = standin(spark, SF_SMALL)
        counts = reports.export(reports.anomaly_reports(t), str(tmp_path))
        inside = _spooled(spark) - before
        assert {f.split("-")[1] for f in inside} >= {"rows", "stats", "features", "forest", "scored"}
    assert _spooled(spark) == before and counts["anomaly_report"] == 6000


def test_scope_ends_after_an_error_and_nests(spark):
    before = _spooled(spark)
    with pytest.raises(RuntimeError), scope(spark):
        spool(spark.range(5), "outer")
        with scope(spark):
            kept = spool(spark.range(7), "inner")
            assert kept.count() == 7 and len(_spooled(spark) - before) == 2
        assert len(_spooled(spark) - before) == 1
        raise RuntimeError
    assert _spooled(spark) == before


def test_breakdown_reads_narrow(spark):
    """Threshold and breakdown scan the columns they need."""
    with scope(spark):
        featured = spool(reports.featured_lines(standin(spark, SF_SMALL)), "features")
        from ledgerlark.operators import iforest

        labelled = reports.detect(featured, iforest.fixed_forest(anomaly.FEATURES))
        plan = anomaly.anomaly_breakdown(labelled)._jdf.queryExecution().executedPlan().toString()
        schema = plan.split("ReadSchema: ")[1].split("\n")[0]
        assert schema.count(":") == 3 and "anomaly_raw" in schema  # score, z score, rejection rate
