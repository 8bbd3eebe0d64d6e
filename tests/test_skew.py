"""A group holding a third of all lines: AQE splits it in the join, results unchanged."""

import datetime as dt
from decimal import Decimal as D

from ledgerlark.operators import anomaly, spend
from tests.test_fixtures import POD_SCHEMA, POH_SCHEMA, VENDOR_SCHEMA

T0 = dt.datetime(2024, 1, 1)
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _hot_tables(spark, n=6000):
    poh, pod = [], []
    for i in range(n):
        hot = i % 3 == 0
        vendor = 1 if hot else 2 + i % 40
        product = 1 if hot else 2 + i % 97
        price = D(100 + (i % 17)) if not (hot and i % 999 == 0) else D(900)
        poh.append((i, vendor, 4, T0, T0, price))
        pod.append((i, 1, product, 1 + i % 5, price, D(1), D(0)))
    vendors = [(v, f"V{v}", 1, True) for v in range(1, 42)]
    product = spark.createDataFrame(
        [(p, f"P{p}", "s", D("50.0000"), D("120.00")) for p in range(1, 99)],
        "productid long, name string, productsubcategoryid string, standardcost decimal(18,4), "
        "listprice decimal(12,2)",
    )
    sub = spark.createDataFrame([("s", "c", "Sub")], "productsubcategoryid string, productcategoryid string, name string")
    cat = spark.createDataFrame([("c", "Cat")], "productcategoryid string, name string")
    return (
        spark.createDataFrame(poh, POH_SCHEMA),
        spark.createDataFrame(pod, POD_SCHEMA),
        spark.createDataFrame(vendors, VENDOR_SCHEMA),
        product, sub, cat,
    )


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_group_price_flags_unchanged_under_skew_split(spark):
    poh, pod, v, p, s, c = _hot_tables(spark)
    base = sorted(tuple(r) for r in anomaly.price_deviation_flags(poh, pod, v, p, s, c).collect())

    def skewed():
        df = anomaly.price_deviation_flags(poh, pod, v, p, s, c)
        rows = sorted(tuple(r) for r in df.collect())
        return rows, df._jdf.queryExecution().executedPlan().toString()

    rows, plan = _with_conf(spark, SKEW_CONF, skewed)
    assert rows == base
    assert "_salt" in plan  # the hot group was salted over several join keys
    hot = [r for r in rows if r[3] == "P1"]
    assert len(hot) == 2000 and any(r[-1] == "FLAG" for r in hot)


def test_hot_vendor_spend_unchanged(spark):
    poh, pod, v, *_ = _hot_tables(spark)
    base = sorted(tuple(r) for r in spend.vendor_spend_ranked(v, poh, pod).collect())
    rows = _with_conf(
        spark, SKEW_CONF,
        lambda: sorted(tuple(r) for r in spend.vendor_spend_ranked(v, poh, pod).collect()),
    )
    assert rows == base
    assert [r for r in rows if r[0] == 1][0][8] == 1  # the hot vendor ranks first


def test_salted_join_spreads_hot_group(spark):
    from pyspark.sql import functions as F

    from ledgerlark.plans import skew

    poh, pod, *_ = _hot_tables(spark)
    lines = pod.join(poh.select("purchaseorderid", "vendorid"), "purchaseorderid")
    stats = lines.groupBy("vendorid", "productid").agg(F.count(F.lit(1)).alias("n"))
    salted = lines.join(F.broadcast(stats.where("n >= 100").withColumn("k", F.ceil(F.col("n") / 400))),
                        ["vendorid", "productid"])
    buckets = salted.select(
        F.pmod(F.xxhash64("purchaseorderid", "vendorid", "purchaseorderdetailid", "productid"), F.col("k"))
    ).distinct().count()
    assert buckets > 1
    plain = lines.join(stats, ["vendorid", "productid"], "left")
    via = skew.join_group_stats(lines, stats, ["vendorid", "productid"], "n",
                                ["purchaseorderid", "vendorid", "purchaseorderdetailid", "productid"])
    assert via.count() == plain.count() == lines.count()
    assert via.exceptAll(plain.select(*via.columns)).count() == 0


def test_null_group_meets_its_statistics_and_is_spread(spark):
    """A NULL key is a group like any other, salted over several tasks."""
    from pyspark.sql import functions as F

    from ledgerlark.plans import skew

    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("purchaseorderid")
    )
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = _with_conf(
        spark, SKEW_CONF,
        lambda: skew.join_group_stats(rows, stats, ["k"], "n", ["purchaseorderid"])
        .withColumn("task", F.spark_partition_id()).where("k is null").groupBy("n", "task").count().collect(),
    )
    assert {r["n"] for r in got} == {3000} and sum(r["count"] for r in got) == 3000
    assert len(got) > 1 and max(r["count"] for r in got) < 3000


def test_header_detail_join_is_worked_out_once(spark):
    """The final plan reads spooled lines and statistics, not the tables again."""
    poh, pod, v, p, s, c = _hot_tables(spark, 600)
    plan = anomaly.price_deviation_flags(poh, pod, v, p, s, c)._jdf.queryExecution().executedPlan().toString()
    assert "spool-rows" in plan and "spool-stats" in plan and "ExistingRDD" not in plan


def test_hot_group_without_prices_is_spread(spark):
    """A group counts all its rows, so one whose prices are NULL is salted as well."""
    from pyspark.sql import functions as F

    from ledgerlark.functions.moments import mean, moments
    from ledgerlark.plans import skew

    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("purchaseorderid"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("decimal(12,2)")).alias("price"),
    )

    def run():
        out = skew.attach_group_stats(rows, ["k"], moments(rows, "price"), lambda t: t.select("k", skew.GROUP_ROWS, "m_n", mean().alias("avg")))
        return out.withColumn("task", F.spark_partition_id()).where("k = -1").groupBy("m_n", "avg", "task").count().collect()

    got = _with_conf(spark, SKEW_CONF, run)
    assert {(r.m_n, r.avg) for r in got} == {(0, None)} and sum(r["count"] for r in got) == 3000
    assert len(got) > 1 and max(r["count"] for r in got) < 3000


def test_bucketed_orders_join_without_a_shuffle(spark, tmp_path):
    from ledgerlark.sources.parquet import LogicalTables
    from ledgerlark.sources.sinks import write_bucketed

    poh, pod, v, *_ = _hot_tables(spark, 900)
    names = {"purchasing.purchaseorderheader": poh, "purchasing.purchaseorderdetail": pod}
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed LOCATION '" + str(tmp_path / "db") + "'")
    try:
        for t, df in names.items():
            write_bucketed(df, "bucketed." + t.split(".")[1], ["purchaseorderid"], 6, str(tmp_path / t))
        t = LogicalTables.from_catalog(spark, "bucketed", tables=names)

        def run():
            lines = spend.po_lines(t.purchaseorderheader, t.purchaseorderdetail, header_cols=("orderdate",))
            plan = lines._jdf.queryExecution().executedPlan().toString()
            per_vendor = sorted(tuple(r) for r in spend.vendor_spend_ranked(v, t.purchaseorderheader, t.purchaseorderdetail).collect())
            return plan, sorted(tuple(r) for r in lines.collect()), per_vendor

        plan, rows, ranked = _with_conf(spark, SKEW_CONF, run)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows == sorted(tuple(r) for r in spend.po_lines(poh, pod, header_cols=("orderdate",)).collect())
        assert ranked == sorted(tuple(r) for r in spend.vendor_spend_ranked(v, poh, pod).collect())
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_prices_of_four_places(spark):
    """DECIMAL(19,4) prices: equal prices have no deviation, others that of exact sums."""
    from pyspark.sql import functions as F

    poh, pod, v, p, s, c = _hot_tables(spark, 900)
    fine = pod.withColumn("unitprice", (F.col("unitprice").cast("decimal(19,4)") + F.lit("0.0001").cast("decimal(19,4)")).cast("decimal(19,4)"))
    lines = anomaly.po_line_base(poh, fine, v, p, s, c)
    got = {(r.vendorid, r.productid, r.vp_count): r for r in anomaly.group_price_stats(lines).collect()}
    plain = {(r.vendorid, r.productid, r.vp_count): r for r in anomaly.group_price_stats(anomaly.po_line_base(poh, pod, v, p, s, c)).collect()}
    assert set(got) == set(plain) and len(got) > 20
    for key, r in got.items():
        if r.vp_std_price is None:
            assert plain[key].vp_std_price is None
        else:  # a shift of all prices leaves the deviation as it is
            assert abs(r.vp_std_price - plain[key].vp_std_price) <= 1e-13 * max(1.0, r.vp_std_price)
        assert abs(r.vp_avg_price - plain[key].vp_avg_price - 0.0001) < 1e-9
