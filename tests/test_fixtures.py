"""Hand-made fixtures for cases the generated tables cannot reach (nulls, ties,
zero denominators, singleton groups, missing months)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import anomaly, revenue, spend

VENDOR_SCHEMA = "businessentityid long, name string, creditrating int, preferredvendorstatus boolean"
POH_SCHEMA = (
    "purchaseorderid long, vendorid long, status int, orderdate timestamp_ntz, "
    "shipdate timestamp_ntz, subtotal decimal(19,2)"
)
POD_SCHEMA = (
    "purchaseorderid long, purchaseorderdetailid long, productid long, orderqty int, "
    "unitprice decimal(12,2), receivedqty decimal(8,2), rejectedqty decimal(8,2)"
)
T0 = dt.datetime(2024, 1, 1)


def _spend_tables(spark, spends):
    """One vendor per spend value, one PO with a single line of qty 1 at that price."""
    vendors = [(i + 1, f"V{i + 1}", 1, True) for i in range(len(spends))]
    poh = [(100 + i, i + 1, 4, T0, T0, D(s)) for i, s in enumerate(spends)]
    pod = [(100 + i, 1, 7, 1, D(s), D(1), D(0)) for i, s in enumerate(spends)]
    return (
        spark.createDataFrame(vendors, VENDOR_SCHEMA),
        spark.createDataFrame(poh, POH_SCHEMA),
        spark.createDataFrame(pod, POD_SCHEMA),
    )


@pytest.mark.parametrize("distributed", [True, False])
def test_rank_ties_and_running_total(spark, distributed):
    v, poh, pod = _spend_tables(spark, ["100.00", "80.00", "80.00", "50.00"])
    rows = spend.vendor_spend_ranked(v, poh, pod, distributed=distributed).collect()
    assert [r.spend_rank for r in rows] == [1, 2, 2, 4]
    assert [r.running_total_spend for r in rows] == [100.0, 180.0, 260.0, 310.0]
    assert [r.vendor_id for r in rows] == [1, 2, 3, 4]


def test_pareto_boundary(spark):
    v, poh, pod = _spend_tables(spark, ["80.00", "20.00"])
    rows = spend.vendor_pareto(v, poh, pod).collect()
    assert [(r.cumulative_pct, r.vendor_tier) for r in rows] == [
        (80.0, "Critical Vendor"),
        (100.0, "Tail Spend"),
    ]
    assert [r.spend_pct for r in rows] == [80.0, 20.0]


def test_status_pivot_and_lead_time(spark):
    v = spark.createDataFrame([(1, "V", 2, True)], VENDOR_SCHEMA)
    statuses = [1, 3, 3, 4, 4, 4]
    poh = [
        (i, 1, s, T0, T0 + dt.timedelta(days=2, hours=12), D("1.00"))
        for i, s in enumerate(statuses)
    ]
    poh.append((99, 1, 2, T0, None, D("1.00")))
    r = spend.po_status_breakdown(v, spark.createDataFrame(poh, POH_SCHEMA)).first()
    assert (r.pending, r.approved, r.rejected, r.complete) == (1, 1, 2, 3)
    assert r.total_pos == 7
    assert r.rejection_rate_pct == 28.57
    assert r.avg_lead_time_days == 2.5  # the NULL ship date is ignored


def test_monthly_left_join_and_lag(spark):
    soh = spark.createDataFrame(
        [(1, 1, dt.datetime(2024, 1, 5), D("100.00")), (2, 1, dt.datetime(2024, 2, 5), D("0.00"))],
        "salesorderid long, customerid long, orderdate timestamp_ntz, subtotal decimal(12,2)",
    )
    poh = spark.createDataFrame(
        [
            (10, 1, 4, dt.datetime(2024, 1, 9), None, D("40.00")),
            (11, 1, 4, dt.datetime(2024, 3, 9), None, D("9.00")),
        ],
        POH_SCHEMA,
    )
    pod = spark.createDataFrame(
        [(10, 1, 7, 1, D("40.00"), D(1), D(0)), (11, 1, 7, 1, D("9.00"), D(1), D(0))],
        POD_SCHEMA,
    )
    rows = spend.monthly_spend_vs_revenue(poh, pod, soh).collect()
    assert [r.period for r in rows] == ["2024-01", "2024-02"]
    jan, feb = rows
    assert (jan.spend_to_revenue_ratio_pct, jan.prior_month_spend) == (40.0, None)
    assert (feb.total_vendor_spend, feb.spend_to_revenue_ratio_pct, feb.prior_month_spend) == (
        0.0, None, 40.0,
    )


def test_margin_filter(spark):
    product = spark.createDataFrame(
        [(1, "a", "s1", D("5.00"), D("0.00")), (2, "b", "s1", D("4.00"), D("10.00"))],
        "productid long, name string, productsubcategoryid string, standardcost decimal(18,4), "
        "listprice decimal(12,2)",
    )
    sub = spark.createDataFrame([("s1", "c1", "Sub")], "productsubcategoryid string, productcategoryid string, name string")
    cat = spark.createDataFrame([("c1", "Cat")], "productcategoryid string, name string")
    r = revenue.margin_by_category(product, sub, cat).collect()
    assert len(r) == 1 and r[0].product_count == 1 and r[0].avg_margin_pct == 60.0


@pytest.mark.parametrize("calendar_exact", [False, True])
def test_missing_month(spark, calendar_exact):
    soh = spark.createDataFrame(
        [(1, 1, 5, dt.datetime(2024, 1, 3), D("100.00")), (2, 2, 5, dt.datetime(2024, 3, 3), D("150.00"))],
        "salesorderid long, customerid long, territoryid int, orderdate timestamp_ntz, subtotal decimal(12,2)",
    )
    st = spark.createDataFrame([(5, "T", "C")], "territoryid int, name string, countryregioncode string")
    rows = revenue.territory_growth(soh, st, calendar_exact=calendar_exact).collect()
    mar = rows[1]
    if calendar_exact:  # February is missing: no previous month by date
        assert (mar.prev_month_revenue, mar.mom_growth_pct) == (None, None)
    else:  # positional LAG, as in the original report
        assert (mar.prev_month_revenue, mar.mom_growth_pct) == (100.0, 50.0)


def test_territory_trend_and_zero_base(spark):
    st = spark.createDataFrame(
        [
            (1, "Zero", "X", "G", D(5), D(0), D(0), D(0)),
            (2, "Flat", "X", "G", D(5), D(5), D(1), D(1)),
            (3, "Up", "X", "G", D(6), D(5), D(1), D(2)),
            (4, "Down", "X", "G", D(4), D(5), D(0), D(0)),
        ],
        "territoryid int, name string, countryregioncode string, group string, salesytd decimal(19,4), "
        "saleslastyear decimal(19,4), costytd decimal(19,4), costlastyear decimal(19,4)",
    )
    rows = revenue.territory_yoy_variance(st).collect()
    assert rows[0].territory == "Zero"  # NULL growth sorts first (DESC NULLS FIRST)
    got = {r.territory: (r.revenue_trend, r.revenue_yoy_growth_pct) for r in rows}
    assert got["Zero"] == ("Growing", None)
    assert got["Flat"][0] == "Flat" and got["Up"][0] == "Growing" and got["Down"][0] == "Declining"
    assert {r.territory: r.cost_yoy_change_pct for r in rows}["Zero"] is None


@pytest.mark.parametrize("distributed", [True, False])
def test_quota_ranking(spark, distributed):
    sp = spark.createDataFrame(
        [
            (1, 1, None, D(50), D(0), D(1), D("0.01")),
            (2, 1, D(0), D(50), D(0), D(1), D("0.01")),
            (3, None, D(100), D(50), D(0), D(1), D("0.01")),
        ],
        "businessentityid long, territoryid int, salesquota decimal(19,4), salesytd decimal(19,4), "
        "saleslastyear decimal(19,4), bonus decimal(19,4), commissionpct decimal(9,4)",
    )
    emp = spark.createDataFrame([(1,), (2,), (3,)], "businessentityid long")
    person = spark.createDataFrame(
        [(1, "A", "X"), (2, "B", "Y"), (3, "C", None)],
        "businessentityid long, firstname string, lastname string",
    )
    st = spark.createDataFrame([(1, "T1")], "territoryid int, name string")
    rows = revenue.salesperson_attainment(sp, emp, person, st, distributed=distributed).collect()
    assert len(rows) == 2  # NULL quota dropped
    assert [(r.salesperson_name, r.attainment_pct, r.performance_rank) for r in rows] == [
        ("B Y", None, 1),
        (None, 50.0, 2),
    ]
    assert rows[1].territory is None  # unmatched left join
    assert rows[0].commission_pct == 1.0


def test_promotion_discount_and_offer_without_sales(spark):
    offer = spark.createDataFrame(
        [(1, "Ten", "Volume", "Reseller", D("0.1000")), (2, "Unused", "Volume", "Reseller", D("0.2000"))],
        "specialofferid int, description string, type string, category string, discountpct decimal(9,4)",
    )
    sod = spark.createDataFrame(
        [(1, 1, 2, D("10.00"), D("0.1000")), (2, 1, 1, D("5.00"), D("0.0000"))],
        "salesorderdetailid long, specialofferid int, orderqty int, unitprice decimal(12,2), "
        "unitpricediscount decimal(9,4)",
    )
    rows = revenue.promotion_impact(offer, sod).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.gross_revenue, r.total_discount_given, r.net_revenue) == (25.0, 2.0, 23.0)
    assert (r.effective_discount_rate_pct, r.revenue_per_line_item) == (8.0, 11.5)
    assert r.discount_pct == 10.0


def _price_tables(spark, groups):
    """groups: {productid: [prices]} for one vendor."""
    v = spark.createDataFrame([(1, "V", 1, True)], VENDOR_SCHEMA)
    poh_rows, pod_rows = [], []
    n = 0
    for pid, prices in groups.items():
        for p in prices:
            n += 1
            poh_rows.append((n, 1, 4, T0, T0, D(p)))
            pod_rows.append((n, 1, pid, 1, D(p), D(1), D(0)))
    product = spark.createDataFrame(
        [(pid, f"P{pid}", "s", D("1.0000"), D("2.00")) for pid in groups],
        "productid long, name string, productsubcategoryid string, standardcost decimal(18,4), "
        "listprice decimal(12,2)",
    )
    sub = spark.createDataFrame([("s", "c", "Sub")], "productsubcategoryid string, productcategoryid string, name string")
    cat = spark.createDataFrame([("c", "Cat")], "productcategoryid string, name string")
    return (
        spark.createDataFrame(poh_rows, POH_SCHEMA),
        spark.createDataFrame(pod_rows, POD_SCHEMA),
        v, product, sub, cat,
    )


def test_price_deviation_groups(spark):
    tables = _price_tables(
        spark, {1: ["10.00"], 2: ["7.00", "7.00", "7.00"], 3: ["10.00"] * 9 + ["20.00"]}
    )
    rows = anomaly.price_deviation_flags(*tables).collect()
    single = [r for r in rows if r.product_name == "P1"][0]
    assert (single.vendor_avg_price, single.stddev_unit_price, single.price_deviation) == (None, None, None)
    assert (single.z_score, single.anomaly_flag) == (0.0, "Normal")
    assert {(r.z_score, r.anomaly_flag) for r in rows if r.product_name == "P2"} == {(0.0, "Normal")}
    out = [r for r in rows if r.product_name == "P3"]
    spike = [r for r in out if r.paid_unit_price == 20.0][0]
    assert (spike.vendor_avg_price, spike.stddev_unit_price) == (11.0, 3.1623)
    assert (spike.z_score, spike.anomaly_flag) == (2.85, "FLAG")
    assert {(r.z_score, r.anomaly_flag) for r in out if r.paid_unit_price == 10.0} == {(-0.32, "Normal")}
    assert rows[0].anomaly_flag == "FLAG"  # sorted by |z| descending


def test_feature_fills_and_day_of_week(spark):
    lines = spark.createDataFrame(
        [(D("5.00"), D("0.0000"), 0, D("1.00"), D("3.00"), D("0.00"), 5.0, None)],
        "unitprice decimal(12,2), standardcost decimal(18,4), orderqty int, rejectedqty decimal(8,2), "
        "line_total decimal(12,2), po_subtotal decimal(19,2), vp_avg_price double, vp_std_price double",
    )
    r = anomaly.line_features(lines).first()
    assert (r.price_to_stdcost_ratio, r.rejection_rate, r.line_pct_of_po, r.z_score) == (1.0, 0.0, 0.0, 0.0)
    sunday = spark.createDataFrame([(dt.datetime(2024, 1, 7),)], "d timestamp_ntz")
    from ledgerlark.functions.exprs import dow0

    assert sunday.select(dow0("d").alias("x")).first().x == 0


def test_label_precedence(spark):
    df = spark.createDataFrame(
        [(True, 3.0, 0.5), (True, -3.0, 0.0), (True, 0.0, 0.5), (True, 0.0, 0.0), (False, 9.0, 0.0)],
        "is_anomaly boolean, z_score double, rejection_rate double",
    )
    got = [r.anomaly_flag for r in anomaly.anomaly_label(df).collect()]
    assert got == [
        "High Price Spike", "Unusually Low Price", "High Rejection Rate",
        "Abnormal Order Volume", "Normal",
    ]


def test_contamination_ties_flag_nothing(spark):
    scores = [(-0.9,)] * 10 + [(-0.4,)] * 90
    df = spark.createDataFrame(scores, "anomaly_raw double")
    assert anomaly.contamination_threshold(df) == -0.9
    out = anomaly.contamination_flag(df)
    assert out.where(F.col("is_anomaly")).count() == 0


def test_half_even_flag_rate(spark):
    rows = [("V", i, i == 0, 0.0, D("1.00")) for i in range(800)]
    df = spark.createDataFrame(
        rows,
        "vendor_name string, purchaseorderdetailid long, is_anomaly boolean, z_score double, "
        "line_total decimal(12,2)",
    )
    r = anomaly.anomaly_summary(df).first()
    assert (r.flagged_items, r.total_line_items, r.flag_rate_pct) == (1, 800, 0.12)
    assert r.avg_z_score == 0.0


def test_approximate_contamination_threshold_is_close(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vals = rng.normal(size=20000)
    df = spark.createDataFrame([(float(v),) for v in vals], "anomaly_raw double")
    exact = anomaly.contamination_threshold(df)
    approx = anomaly.contamination_threshold(df, exact=False)
    assert exact == pytest.approx(float(np.percentile(vals, 3)), abs=1e-12)
    # rank error of the sketch is at most n / accuracy = 0.2 rows here
    ranks = np.searchsorted(np.sort(vals), [exact, approx])
    assert abs(int(ranks[0]) - int(ranks[1])) <= 2


def test_lag_puts_null_months_last(spark):
    from ledgerlark.operators import revenue

    orders = spark.createDataFrame(
        [(1, None, 1, 7.0), (2, "2000-01-05", 1, 100.0), (3, "2000-02-05", 1, 150.0)],
        "salesorderid long, d string, territoryid long, total double",
    ).selectExpr(
        "salesorderid", "cast(d as timestamp_ntz) orderdate", "territoryid", "salesorderid customerid",
        "cast(total as decimal(19,4)) totaldue", "cast(total as decimal(19,4)) subtotal",
    )
    territory = spark.createDataFrame([(1, "T", "G", "US")], "territoryid long, name string, `group` string, countryregioncode string")
    for exact in (False, True):
        out = revenue.territory_growth(orders, territory, calendar_exact=exact).collect()
        assert [r["period"] for r in out][:2] == ["2000-01", "2000-02"] and out[2]["period"] is None
        assert [r["prev_month_revenue"] for r in out][:2] == [None, 100.0]


def test_csv_doubles_read_back_exactly(spark, tmp_path):
    from ledgerlark.sources.sinks import write_csv

    values = [1.2345678901234567, 3e-11, 0.1 + 0.2, 866774125.69, 12345678.123456789, -0.0, 1e27, 5e-324, 123456789012.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    write_csv(df, str(tmp_path / "csv"))
    back = {r["k"]: float(r["x"]) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).selectExpr("int(k) k", "x").collect()}
    assert [back[k] for k in range(len(values))] == values


def test_every_tree_gets_exactly_psi_rows(spark):
    from ledgerlark.operators import iforest

    df = spark.range(3000).selectExpr("id", "rand(1) a", "rand(2) b")
    for psi in (2, 16, 256):
        model = iforest.iforest_fit(df, ["a", "b"], row_key=["id"], n_trees=40, max_samples=psi, seed=3)
        sizes = {}
        for r in model.to_dataframe(spark).where("node_id = 0").collect():
            sizes[r["tree_id"]] = r["size"]
        assert set(sizes.values()) == {psi} and len(sizes) == 40
