"""Purchase-line anomaly operators (workload operators 10-14 and 17-22).

Two detectors share one wide purchase-line table (``po_line_base``):
  * ``price_deviation_flags``: z-score of the paid unit price inside its
    (vendor, product) group, |z| > 2 flagged;
  * the isolation-forest chain: group price statistics -> line features ->
    forest score (``ledgerlark.operators.iforest``) -> contamination threshold ->
    labels -> per-line report, per-vendor summary, label breakdown, run metrics.

Group statistics are an aggregate joined back to the lines (not a window): the
aggregate is combined map-side, so a hot (vendor, product) group is never buffered
in one task, and the join back salts hot groups over many tasks (``plans.skew``).
The lines are written once and read narrow for the statistics; deviations come from
exact moments (``functions.moments``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlark.functions.exprs import (
    dow0,
    exact_avg,
    np_round,
    pct,
    round_money,
    round_ratio,
    ymd,
)
from ledgerlark.functions.moments import deviation, mean, moment_sums
from ledgerlark.functions.quantile import quantile_value
from ledgerlark.operators.spend import DEFAULT_PO_KEY, po_lines
from ledgerlark.plans.skew import GROUP_ROWS, attach_group_stats, groups_are_small
from ledgerlark.plans.spool import spool

# Feature order of the forest, label texts and rule thresholds.
FEATURES = [
    "unitprice",
    "orderqty",
    "line_total",
    "z_score",
    "price_to_stdcost_ratio",
    "rejection_rate",
    "line_pct_of_po",
    "price_deviation_pct",
]
LABEL_SPIKE = "High Price Spike"
LABEL_LOW = "Unusually Low Price"
LABEL_REJECTION = "High Rejection Rate"
LABEL_VOLUME = "Abnormal Order Volume"
LABEL_NORMAL = "Normal"
FLAG = "FLAG"
Z_LIMIT = 2.0
REJECTION_LIMIT = 0.2
CONTAMINATION = 0.03

REPORT_COLUMNS = [
    "purchaseorderid", "purchaseorderdetailid", "vendor_name", "product_name", "category",
    "orderqty", "unitprice", "standardcost", "vp_avg_price", "price_deviation",
    "price_deviation_pct", "z_score", "rejection_rate", "line_total", "anomaly_raw",
    "is_anomaly", "anomaly_flag", "orderdate", "order_year", "order_month",
]


def _z_expr(price, avg, sd) -> F.Column:
    """CASE WHEN sd > 0 THEN (price - avg) / sd ELSE 0 END, in DOUBLE."""
    return F.when(
        sd > 0, (price - avg).cast("double") / sd.cast("double")
    ).otherwise(F.lit(0.0))


def few_lines_a_product(pod: DataFrame) -> bool:
    """Whether no product has many lines, nor any group of lines of one product.

    Counted on the lines alone, before anything is joined to them; where headers, vendors or
    products repeat their keys, a group holds that many times more.
    """
    return groups_are_small(pod.select("productid"), ["productid"])


def price_deviation_flags(
    poh: DataFrame,
    pod: DataFrame,
    vendor: DataFrame,
    product: DataFrame,
    subcategory: DataFrame,
    category: DataFrame,
    po_key=DEFAULT_PO_KEY,
    group_keys=("vendorid", "productid"),
    z_threshold: float = Z_LIMIT,
) -> DataFrame:
    """Per PO line: its group's average / sample stddev (4 places, groups of >= 2),
    deviation, z-score and 'FLAG' when |z| > ``z_threshold``.

    ``group_keys`` defaults to (vendor, product).  ('vendorid', 'subcategory') groups
    by vendor and product subcategory instead.
    """
    lines = _wide_lines(poh, pod, vendor, product, subcategory, category, po_key)
    keys = list(group_keys)
    needed = [
        "purchaseorderid", "purchaseorderdetailid", "vendorid", "productid", "vendor_name", "product_name",
        "category", "orderqty", "unitprice", "standardcost", "orderdate",
    ]
    lines = lines.select(*dict.fromkeys([*needed, *keys]))

    def derive(stats, kept=keys):
        # groups of one line have no statistics, however hot the join finds others
        shown = F.col(GROUP_ROWS) >= 2
        return stats.select(
            *kept, GROUP_ROWS,
            F.when(shown, F.round("avg_price", 4)).alias("vendor_avg"),
            F.when(shown, round_ratio(deviation(lines, "unitprice"), 4)).alias("stddev_unit_price"),
        )

    aggregates = {"avg_price": exact_avg("unitprice")} | moment_sums(lines, "unitprice")
    small = "productid" in keys and few_lines_a_product(pod)
    j = attach_group_stats(lines, keys, aggregates, derive, small)
    sd = F.col("stddev_unit_price")
    z = _z_expr(F.col("unitprice"), F.col("vendor_avg"), sd)
    out = j.select(
        F.col("purchaseorderid").cast("long"),
        F.col("purchaseorderdetailid").cast("long"),
        "vendor_name",
        "product_name",
        "category",
        F.col("orderqty").cast("long"),
        F.col("unitprice").cast("double").alias("paid_unit_price"),
        F.col("standardcost").cast("double").alias("standard_cost"),
        F.col("vendor_avg").cast("double").alias("vendor_avg_price"),
        F.col("stddev_unit_price").cast("double").alias("stddev_unit_price"),
        round_money(F.col("unitprice") - F.col("vendor_avg"), 4).alias("price_deviation"),
        round_ratio(z).alias("z_score"),
        round_money(F.col("orderqty") * F.col("unitprice")).alias("line_total"),
        ymd("orderdate").alias("order_date"),
        F.when(F.abs(z) > F.lit(z_threshold), F.lit(FLAG)).otherwise(F.lit(LABEL_NORMAL))
        .alias("anomaly_flag"),
        F.abs(z).alias("_abs_z"),
        "vendorid",
        "productid",
    )
    if small:  # a sort reads its input twice; joins and window are worked out once
        out = spool(out, "flags")
    return out.orderBy(
        F.col("_abs_z").desc_nulls_first(), "purchaseorderid", "vendorid", "productid",
        "purchaseorderdetailid",
    ).drop("_abs_z", "vendorid", "productid")


def _wide_lines(poh, pod, vendor, product, subcategory, category, po_key) -> DataFrame:
    """PO lines with vendor, product, subcategory and category attributes.

    A product meets its subcategory and category before the lines meet the product: those
    are looked up once a product, not once a line, and no task of the lines holds them.
    """
    lines = po_lines(poh, pod, po_key, header_cols=("orderdate", "status", "subtotal"))
    v = vendor.select(
        F.col("businessentityid").alias("vendorid"),
        F.col("name").alias("vendor_name"),
        "creditrating",
    )
    p = product.select(
        "productid",
        F.col("name").alias("product_name"),
        "productsubcategoryid",
        "standardcost",
    )
    psc = subcategory.select(
        "productsubcategoryid", "productcategoryid", F.col("name").alias("subcategory")
    )
    pc = category.select("productcategoryid", F.col("name").alias("category"))
    p = p.join(psc, "productsubcategoryid", "left").join(pc, "productcategoryid", "left")
    return lines.join(v, "vendorid").join(p, "productid")


def po_line_base(
    poh: DataFrame,
    pod: DataFrame,
    vendor: DataFrame,
    product: DataFrame,
    subcategory: DataFrame,
    category: DataFrame,
    po_key=DEFAULT_PO_KEY,
) -> DataFrame:
    """Wide purchase-line fact: line total (rounded), calendar parts, PO status.

    Money columns stay exact decimals here; ``as_report`` casts them for output.
    """
    w = _wide_lines(poh, pod, vendor, product, subcategory, category, po_key)
    return w.select(
        "purchaseorderid",
        "purchaseorderdetailid",
        "vendorid",
        "vendor_name",
        "creditrating",
        "productid",
        "product_name",
        "category",
        "subcategory",
        "orderqty",
        "unitprice",
        "receivedqty",
        "rejectedqty",
        "standardcost",
        F.round(F.col("orderqty") * F.col("unitprice"), 2).alias("line_total"),
        F.col("subtotal").alias("po_subtotal"),
        "orderdate",
        F.year("orderdate").alias("order_year"),
        F.month("orderdate").alias("order_month"),
        dow0("orderdate").alias("order_dow"),
        F.col("status").alias("po_status"),
    )


def group_price_stats(
    lines: DataFrame, keys=("vendorid", "productid"), price: str = "unitprice", small: bool = False
) -> DataFrame:
    """Left-merge mean, sample std and count of ``price`` per group onto every line.

    ``small``: groups are known to be small (``few_lines_a_product``).
    The mean is the exact decimal sum divided by the count in DOUBLE (one rounding),
    so constant groups have exactly zero deviation.
    """
    keys = list(keys)

    def derive(stats, kept=keys):
        return stats.select(*kept, GROUP_ROWS, *price_stats(lines, price))

    return attach_group_stats(lines, keys, moment_sums(lines, price), derive, small)


def price_stats(lines: DataFrame, price: str = "unitprice") -> list[F.Column]:
    """Average, sample deviation and count of a group's prices from its moments."""
    return [
        mean().alias("vp_avg_price"),
        deviation(lines, price).alias("vp_std_price"),
        F.col("m_n").alias("vp_count"),
    ]


def line_features(lines: DataFrame) -> DataFrame:
    """Model features per line (input: ``group_price_stats`` output).

    price_deviation_pct keeps NULL for a zero average; z_score NULL -> 0;
    price_to_stdcost_ratio NULL -> 1; rejection_rate NULL -> 0; line_pct_of_po NULL -> 0.
    """
    d = F.col("unitprice").cast("double") - F.col("vp_avg_price")
    return lines.withColumns(
        {
            "price_deviation": d,
            "price_deviation_pct": d / F.nullif(F.col("vp_avg_price"), F.lit(0.0)) * F.lit(100.0),
            "z_score": F.coalesce(d / F.nullif(F.col("vp_std_price"), F.lit(0.0)), F.lit(0.0)),
            "price_to_stdcost_ratio": F.coalesce(
                F.col("unitprice").cast("double")
                / F.nullif(F.col("standardcost").cast("double"), F.lit(0.0)),
                F.lit(1.0),
            ),
            "rejection_rate": F.coalesce(
                F.col("rejectedqty").cast("double")
                / F.nullif(F.col("orderqty").cast("double"), F.lit(0.0)),
                F.lit(0.0),
            ),
            "line_pct_of_po": F.coalesce(
                F.col("line_total").cast("double")
                / F.nullif(F.col("po_subtotal").cast("double"), F.lit(0.0))
                * F.lit(100.0),
                F.lit(0.0),
            ),
        }
    )


def standardize(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / population std per column, NULL -> 0 first; a zero-variance column
    keeps scale 1.  The statistics (two numbers a column) are observed while ``df`` is
    spooled, so it is worked out once and no pass is made for them."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    seen = Observation("standardize")
    moved = [F.avg(filled[c]).alias(f"mu{i}") for i, c in enumerate(cols)]
    spread = [F.stddev_pop(filled[c]).alias(f"sd{i}") for i, c in enumerate(cols)]
    df = spool(df.observe(seen, *moved, *spread), "features")
    stats = seen.get
    scaled = {}
    for i, c in enumerate(cols):
        mu, sd = stats[f"mu{i}"], stats[f"sd{i}"]
        scale = 1.0 if sd is None or sd == 0 else float(sd)
        scaled[f"{c}{suffix}"] = (filled[c] - F.lit(mu).cast("double")) / F.lit(scale)
    return df.withColumns(scaled)


def contamination_threshold(
    scored: DataFrame,
    score: str = "anomaly_raw",
    contamination: float = CONTAMINATION,
    exact: bool = True,
    accuracy: int = 100_000,
) -> float | None:
    """The ``contamination`` quantile of the scores.

    ``exact=True``: linear interpolation between order statistics, as numpy does
    (four reads of the one column, see ``functions.quantile``).  ``exact=False``: one
    ``percentile_approx`` pass, rank error at most ``n / accuracy``.
    """
    if exact:
        return quantile_value(scored, score, contamination)
    return scored.agg(
        F.percentile_approx(F.col(score).cast("double"), contamination, accuracy)
    ).first()[0]


def contamination_flag(
    scored: DataFrame,
    score: str = "anomaly_raw",
    contamination: float = CONTAMINATION,
    threshold: float | None = None,
    exact: bool = True,
) -> DataFrame:
    """is_anomaly = score strictly below the contamination quantile; anomaly_score is
    -1 for anomalies and 1 otherwise."""
    if threshold is None:
        threshold = contamination_threshold(scored, score, contamination, exact=exact)
    if threshold is None:
        flagged = F.lit(False)
    else:
        flagged = F.coalesce(F.col(score) < F.lit(float(threshold)), F.lit(False))
    return scored.withColumn("is_anomaly", flagged).withColumn(
        "anomaly_score", F.when(flagged, F.lit(-1)).otherwise(F.lit(1))
    )


def anomaly_label(df: DataFrame) -> DataFrame:
    """First matching rule: price spike, low price, rejection rate, volume, else Normal."""
    a = F.col("is_anomaly")
    z = F.col("z_score")
    label = (
        F.when(a & (z > Z_LIMIT), F.lit(LABEL_SPIKE))
        .when(a & (z < -Z_LIMIT), F.lit(LABEL_LOW))
        .when(a & (F.col("rejection_rate") > REJECTION_LIMIT), F.lit(LABEL_REJECTION))
        .when(a, F.lit(LABEL_VOLUME))
        .otherwise(F.lit(LABEL_NORMAL))
    )
    return df.withColumn("anomaly_flag", label)


def anomaly_report(labelled: DataFrame) -> DataFrame:
    """The 20 report columns, most anomalous first."""
    return labelled.select(*REPORT_COLUMNS, "vendorid", "productid").orderBy(
        F.col("anomaly_raw").asc_nulls_last(), "purchaseorderid", "vendorid", "productid",
        "purchaseorderdetailid",
    ).drop("vendorid", "productid")


def anomaly_summary(labelled: DataFrame) -> DataFrame:
    """Per vendor name: lines, flagged lines, spend, flagged spend, z statistics and
    the two rates (rounded like pandas, half to even).

    avg_z_score and max_z_score are raw, as the original emits them: within a group z
    sums to zero, so a mean may be floating-point noise around it.
    """
    flagged = F.col("is_anomaly")
    agg = labelled.groupBy("vendor_name").agg(
        F.count("purchaseorderdetailid").alias("total_line_items"),
        F.sum(flagged.cast("long")).alias("flagged_items"),
        F.sum("line_total").alias("total_spend_dec"),
        F.sum(F.when(flagged, F.col("line_total")).otherwise(F.lit(0))).alias("flagged_spend_dec"),
        F.avg("z_score").alias("avg_z_score"),
        F.max("z_score").alias("max_z_score"),
    )
    total = F.col("total_spend_dec").cast("double")
    fl_spend = F.col("flagged_spend_dec").cast("double")
    return agg.select(
        "vendor_name",
        F.col("total_line_items").cast("long"),
        F.col("flagged_items").cast("long"),
        total.alias("total_spend"),
        fl_spend.alias("flagged_spend"),
        "avg_z_score",
        "max_z_score",
        np_round(
            F.col("flagged_items").cast("double") / F.col("total_line_items").cast("double")
            * F.lit(100.0)
        ).alias("flag_rate_pct"),
        np_round(fl_spend / F.nullif(total, F.lit(0.0)) * F.lit(100.0)).alias("flagged_spend_pct"),
    ).orderBy(F.col("flagged_items").desc(), "vendor_name")


def anomaly_breakdown(labelled: DataFrame) -> DataFrame:
    """Count of flagged lines per label, largest first."""
    return (
        labelled.where(F.col("is_anomaly"))
        .groupBy("anomaly_flag")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "anomaly_flag")
    )


def run_metrics(labelled: DataFrame) -> DataFrame:
    """One row of run statistics: lines, deviation and z ranges, flagged count / share."""
    n = F.count(F.lit(1))
    flagged = F.sum(F.col("is_anomaly").cast("long"))
    return labelled.agg(
        n.alias("n_lines"),
        F.min("price_deviation").alias("min_dev"),
        F.max("price_deviation").alias("max_dev"),
        F.min("z_score").alias("min_z"),
        F.max("z_score").alias("max_z"),
        flagged.alias("n_flagged"),
    ).select(
        F.col("n_lines").cast("long"),
        round_ratio("min_dev", 4).alias("min_price_deviation"),
        round_ratio("max_dev", 4).alias("max_price_deviation"),
        round_ratio("min_z", 4).alias("min_z_score"),
        round_ratio("max_z", 4).alias("max_z_score"),
        F.coalesce(F.col("n_flagged"), F.lit(0)).cast("long").alias("n_flagged"),
        pct(F.coalesce(F.col("n_flagged"), F.lit(0)), "n_lines").alias("flagged_pct"),
    )


def as_report(df: DataFrame, round_features: int | None = None) -> DataFrame:
    """Cast exact decimals to DOUBLE and integers to BIGINT for output; optionally
    round floating features (for comparisons across engines)."""
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType) and round_features is not None:
            c = round_ratio(c, round_features)
        cols.append(c.alias(f.name))
    return df.select(*cols)
