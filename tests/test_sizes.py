"""What grows with the input: shuffle partitions, spooled widths, work of the exact quantile."""

import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark import reports, session, workload
from ledgerlark.functions import moments, quantile
from ledgerlark.operators import anomaly, iforest
from ledgerlark.plans import skew
from ledgerlark.sources.standin import standin

LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


@pytest.fixture
def made(spark, tmp_path):
    """Test tables of 400 lines in 100 orders of 10 vendors."""
    n = spark.range(400)
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(id % 300))")
    li = n.select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 8).alias("l_partkey"), (F.col("id") % 10).alias("l_suppkey"),
        (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 7 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 1.25 + 3).cast("double").alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), day.alias("l_shipdate"),
    )
    tables = {
        "lineitem": spark.createDataFrame(li.rdd, LINES),
        "orders": n.where("id < 100").select(
            F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
            F.lit(9.0).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("4-LOW").alias("o_orderpriority"),
        ),
        "supplier": n.where("id < 10").select(
            F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), "id").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")
        ),
        "part": n.where("id < 8").select(
            F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"),
            F.lit(3).alias("p_size"), F.lit(20.0).alias("p_retailprice"),
        ),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    session.size_shuffles(spark, 0)


def test_shuffle_partitions_grow_with_the_lines(spark, made, monkeypatch):
    def dealt():
        plan = standin(spark, made).purchaseorderheader.select("*")._jdf.queryExecution().executedPlan().toString()
        return max(int(x) for x in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan))

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt() == least
    monkeypatch.setattr(session, "INPUT_BYTES_OF_PARTITION", 64)
    assert least < dealt() <= session.MOST_PARTITIONS
    monkeypatch.setattr(session, "MOST_PARTITIONS", least + 5)
    assert dealt() == least + 5


def test_results_do_not_depend_on_the_number_of_partitions(spark, made, monkeypatch):
    names = ["po_line_base", "po_status_breakdown", "price_deviation_flags", "line_features", "run_metrics"]

    def results():
        return {k: sorted(tuple(r) for r in workload.QUERIES[k](spark, made).collect()) for k in names}

    want = results()
    assert len(want["po_line_base"]) == 400
    monkeypatch.setattr(session, "INPUT_BYTES_OF_PARTITION", 256)
    assert results() == want


def test_lines_are_spooled_as_wide_as_the_query_needs(spark, made, monkeypatch):
    seen, spool = {}, skew.spool
    monkeypatch.setattr(skew, "spool", lambda df, name: seen.setdefault(name, df.columns) and spool(df, name))
    workload.QUERIES["run_metrics"](spark, made)
    assert {"unitprice", "po_subtotal", "rejectedqty"} < set(seen["rows"])
    assert not {"product_name", "vendor_name", "category", "subcategory", "orderdate"} & set(seen["rows"])
    seen.clear()
    assert workload.QUERIES["anomaly_report"](spark, made).count() == 400
    assert {"product_name", "vendor_name", "category", "orderdate"} < set(seen["rows"])


def test_quantile_takes_one_logarithm_and_one_power_a_row(spark, tmp_path):
    spark.range(50).select((F.col("id") * 0.7 - 9).alias("x")).write.parquet(f"{tmp_path}/x")
    keys = quantile.order_keys(spark.read.parquet(f"{tmp_path}/x"), "x")
    k = F.shiftright("k", 48)
    cells = keys.groupBy(F.when(k.isin(1023), k).alias("a"), F.shiftright("k", 32).bitwiseAND(F.lit(65535)).alias("d")).count()
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2(") == 1 and plan.upper().count("POWER(") == 1
    rows = spark.read.parquet(f"{tmp_path}/x")
    assert sorted(r.k for r in keys.collect()) == sorted(r.k for r in rows.select(quantile.order_key(F.col("x")).alias("k")).collect())


def test_started_settings_stay(spark, monkeypatch):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        monkeypatch.setattr(type(spark.sparkContext.getConf()), "contains", lambda self, k: k == key)
        session.size_shuffles(spark, 0)
        assert spark.conf.get(key) == "77"
        monkeypatch.undo()
        session.size_shuffles(spark, 0)
        assert spark.conf.get(key) == session.SMALL_TASKS[key]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 8])
def test_scores_of_trees_of_any_depth(depth):
    rng = np.random.default_rng(depth)
    slots = 2 ** (depth + 1) - 1
    m = {"feature": rng.integers(0, 3, (4, slots)), "threshold": rng.normal(size=(4, slots)), "leaf_value": rng.integers(1, 99, (4, slots)) / 8, "depth": depth, "c_psi": 10.0}
    x = rng.normal(size=(30, 3))
    for row, got in zip(x, iforest.score_matrix(x, m), strict=True):
        paths = 0.0
        for t in range(4):
            h = 0
            for _ in range(depth):
                h = 2 * h + 1 + int(row[m["feature"][t, h]] > m["threshold"][t, h])
            paths += m["leaf_value"][t, h]
        assert got == pytest.approx(-(2.0 ** (-(paths / 4) / 10.0)), rel=1e-14)


def test_products_meet_their_categories_before_the_lines(spark):
    """No join of the lines looks up a subcategory or category: products do, once each."""
    day = "timestamp_ntz'2024-01-01 00:00:00'"
    poh = spark.sql(f"SELECT id AS purchaseorderid, 1L AS vendorid, 4 AS status, {day} AS orderdate, {day} AS shipdate, 9.00BD AS subtotal FROM range(4)")
    pod = spark.sql("SELECT id AS purchaseorderid, 1 AS purchaseorderdetailid, id AS productid, 2 AS orderqty, cast(3 AS decimal(12,2)) AS unitprice, 1BD AS receivedqty, 0BD AS rejectedqty FROM range(4)")
    vendor = spark.sql("SELECT 1L AS businessentityid, 'V' AS name, 1 AS creditrating")
    product = spark.sql("SELECT * FROM VALUES (0L, 'P0', 's', 1BD), (1L, 'P1', NULL, 1BD), (2L, 'P2', 'none', 1BD), (2L, 'again', 't', 1BD) AS t(productid, name, productsubcategoryid, standardcost)")
    sub = spark.sql("SELECT * FROM VALUES ('s', 'c', 'S'), ('s', 'd', 'S2'), ('t', NULL, 'T'), (NULL, 'c', 'N') AS t(productsubcategoryid, productcategoryid, name)")
    cat = spark.sql("SELECT * FROM VALUES ('c', 'C'), (NULL, 'N') AS t(productcategoryid, name)")
    lines = anomaly.po_line_base(poh, pod, vendor, product, sub, cat)
    got = sorted(map(str, lines.select("productid", "product_name", "subcategory", "category").toDF("a", "b", "c", "d").collect()))
    assert got == sorted([
        "Row(a=0, b='P0', c='S', d='C')", "Row(a=0, b='P0', c='S2', d=None)", "Row(a=1, b='P1', c=None, d=None)",
        "Row(a=2, b='P2', c=None, d=None)", "Row(a=2, b='again', c='T', d=None)",
    ])
    plan = lines._jdf.queryExecution().analyzed().toString()
    assert "Join Inner" in next(row for row in plan.splitlines() if "Join" in row)
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")


def _small_groups(spark):
    """300 lines in groups of one to three, some of them without a vendor or a price."""
    return spark.range(300).select(
        F.col("id").alias("purchaseorderid"), F.lit(1).alias("purchaseorderdetailid"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("vendorid"), (F.col("id") % 60).alias("productid"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * F.col("id") % 97).cast("decimal(12,2)")).alias("unitprice"),
    )


def test_small_groups_take_one_shuffle(spark, monkeypatch):
    """Statistics of small groups come by one shuffle of the rows, without a join, and equal the joined ones."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 300)
    rows = _small_groups(spark)
    got = anomaly.group_price_stats(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Exchange hash", plan)) == 1
    joined = skew.attach_group_stats(
        rows, ["vendorid", "productid"], moments.moments(rows, "unitprice"),
        lambda stats: stats.select("vendorid", "productid", skew.GROUP_ROWS, *anomaly.price_stats(rows)),
    )
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == joined.dtypes and sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    n = {(r.vendorid, r.productid): r["count"] for r in rows.where("unitprice IS NOT NULL").groupBy("vendorid", "productid").count().collect()}
    assert all(r.vp_count == n.get((r.vendorid, r.productid), 0) for r in got.collect())


def test_large_groups_are_seen(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 100).alias("k"))
    assert not skew.groups_are_small(rows, ["k"])  # few rows
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert skew.groups_are_small(rows, ["k"])
    assert not skew.groups_are_small(rows.select(F.when(F.col("k") > 40, F.col("k")).alias("k")), ["k"])  # 123 without a key
    monkeypatch.setattr(skew, "WINDOW_ROWS", 3)
    assert not skew.groups_are_small(rows, ["k"])
    assert not skew.groups_are_small(rows.limit(0), ["k"])


def test_later_passes_of_the_quantile_work_out_few_keys(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    made, order_keys = [], quantile.order_keys
    monkeypatch.setattr(quantile, "order_keys", lambda df, col: made.append(df.count()) or order_keys(df, col))
    values = [-(2.0 ** (i / 100)) for i in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in [*values, nan, None]], "x double")
    assert quantile.quantile_value(df, "x", 0.03) == pytest.approx(np.quantile(values, 0.03), rel=1e-15)
    assert made[0] == 1002 and len(made) == 4 and max(made[1:]) < 20
    odd = [-inf, -inf, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e308, inf, inf]
    df = spark.createDataFrame([(v,) for v in [*odd, nan, None]], "x double")
    for rank in range(10):
        assert quantile.order_statistics(df, "x", lambda n, rank=rank: [rank]) == (10, [odd[rank]])
    assert quantile.order_statistics(df, "x", lambda n: [0, 5, 9]) == (10, [-inf, 0.0, inf])


def _tables_of_small_groups(spark):
    """300 lines of 60 products, 5 each, in 100 orders; some without a price, vendor or known product."""
    day = "timestamp_ntz'2024-01-01 00:00:00'"
    return SimpleNamespace(
        po_key=("purchaseorderid",),
        purchaseorderheader=spark.sql(f"SELECT id AS purchaseorderid, if(id = 9, NULL, id % 7) AS vendorid, 4 AS status, {day} AS orderdate, {day} AS shipdate, 90.00BD AS subtotal FROM range(100)"),
        purchaseorderdetail=spark.sql(
            "SELECT id % 100 AS purchaseorderid, cast(id / 100 AS int) AS purchaseorderdetailid, if(id = 11, NULL, id % 60) AS productid, cast(id % 4 AS int) AS orderqty,"
            " if(id % 13 = 5, NULL, cast(id * id % 97 AS decimal(12,2))) AS unitprice, 1BD AS receivedqty, 0BD AS rejectedqty FROM range(300)"
        ),
        vendor=spark.sql("SELECT id AS businessentityid, concat('V', id) AS name, 1 AS creditrating FROM range(6)"),
        product=spark.sql("SELECT id AS productid, 'P' AS name, 's' AS productsubcategoryid, 1BD AS standardcost FROM range(58) UNION ALL SELECT 3L, 'again', 's', 2BD"),
        productsubcategory=spark.sql("SELECT 's' AS productsubcategoryid, 'c' AS productcategoryid, 'S' AS name"),
        productcategory=spark.sql("SELECT 'c' AS productcategoryid, 'C' AS name"),
    )


def test_lines_of_small_products_are_shuffled_to_them_once(spark, monkeypatch):
    """Where no product has many lines, the shuffle to the products serves their statistics; nothing is spooled for them."""
    t, spooled, spool = _tables_of_small_groups(spark), [], skew.spool
    monkeypatch.setattr(skew, "spool", lambda df, name: spooled.append(name) or spool(df, name))
    flags = [t.purchaseorderheader, t.purchaseorderdetail, t.vendor, t.product, t.productsubcategory, t.productcategory, t.po_key]

    def results():
        rows = reports.featured_lines(t), anomaly.price_deviation_flags(*flags)
        return [df.dtypes for df in rows], [sorted(map(str, df.collect())) for df in rows], [r.paid_unit_price for r in rows[1].collect()]

    joined = results()
    assert spooled.count("rows") == 2  # few lines: as before
    spooled.clear()
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 300)
    assert results() == joined and len(joined[1][0]) > 200 and not spooled
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.featured_lines(t)._jdf.queryExecution().executedPlan().toString()
        flagged = anomaly.price_deviation_flags(*flags)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above = plan[: plan.index("SortMergeJoin")]
    assert "Window" in above and "Exchange" not in above
    assert "spool-flags" in flagged and "Window" not in flagged  # the sort reads its input twice


def test_many_lines_of_a_product_are_spooled(spark, monkeypatch):
    t, spooled, spool = _tables_of_small_groups(spark), [], skew.spool
    monkeypatch.setattr(skew, "spool", lambda df, name: spooled.append(name) or spool(df, name))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    hot = t.purchaseorderdetail.withColumn("productid", F.when(F.col("productid") < 30, F.lit(1)).otherwise(F.col("productid")))
    assert anomaly.few_lines_a_product(t.purchaseorderdetail) and not anomaly.few_lines_a_product(hot)
    t.purchaseorderdetail = hot
    assert reports.featured_lines(t).where("productid = 1").count() > 100 and "rows" in spooled
