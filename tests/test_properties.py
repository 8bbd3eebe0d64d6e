"""Property tests: distributed global window == single-partition window, exact
quantile == numpy, isolation forest invariants."""

import random
from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions.quantile import quantile_value
from ledgerlark.operators import iforest
from ledgerlark.plans.globalwin import (
    rank_and_running_total,
    single_partition_rank_and_running_total,
)


def _both(spark, rows, schema, key, value, parts, nulls_first=True, descending=True):
    df = spark.createDataFrame(rows, schema)
    kw = dict(descending=descending, nulls_first=nulls_first, rank_col="rk", running_col="run")
    a = rank_and_running_total(df, key, ["id"], value, num_partitions=parts, **kw)
    b = single_partition_rank_and_running_total(df, key, ["id"], value, **kw)
    sa = sorted((r.id, r.rk, r.run) for r in a.collect())
    sb = sorted((r.id, r.rk, r.run) for r in b.collect())
    return sa, sb


@settings(max_examples=8, deadline=None)
@given(
    keys=st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=60),
    parts=st.integers(1, 7),
    desc=st.booleans(),
)
def test_globalwin_matches_builtin_window(spark, keys, parts, desc):
    rows = [(i, None if k is None else D(k), D(i % 5 + 1)) for i, k in enumerate(keys)]
    sa, sb = _both(
        spark, rows, "id long, k decimal(10,0), v decimal(12,2)", "k", "v", parts, descending=desc
    )
    assert sa == sb


def test_globalwin_hot_value_split_across_partitions(spark):
    # a third of all rows share one key: it is spread over several partitions
    rows = [(i, 5.0 if i % 3 == 0 else float(i), 1.0) for i in range(3000)]
    sa, sb = _both(spark, rows, "id long, k double, v double", "k", "v", 16)
    assert sa == sb


def test_quantile_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=5000), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for q in (0.0, 0.03, 0.5, 0.97, 1.0):
        assert quantile_value(df, "x", q) == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-12)


def test_quantile_small_input(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2]], "x double")
    assert quantile_value(df, "x", 0.5) == 2.0
    assert quantile_value(df, "x", 0.25) == 1.5


FEATS = ["a", "b", "c"]


def _gauss_with_outliers(spark, n=1000, n_out=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(n)]
    rows += [(n + j, 50.0, -50.0, 50.0) for j in range(n_out)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_iforest_planted_outliers_and_partition_invariance(spark):
    base = _gauss_with_outliers(spark)
    results = []
    for parts in (1, 4, 16):
        df = base.repartition(parts)
        model = iforest.iforest_fit(df, FEATS, row_key=["id"], n_trees=50, seed=11)
        scored = iforest.iforest_score(df, model).select("id", "anomaly_raw")
        results.append(sorted((r.id, r.anomaly_raw) for r in scored.collect()))
    assert results[0] == results[1] == results[2]
    lowest = sorted(results[0], key=lambda t: t[1])[:5]
    assert {i for i, _ in lowest} == set(range(1000, 1005))


def test_iforest_invariant_to_positive_rescaling(spark):
    df = _gauss_with_outliers(spark, n=300)
    m1 = iforest.iforest_fit(df, FEATS, row_key=["id"], n_trees=20, seed=5)
    scaled = df.select("id", (F.col("a") * 10 + 3).alias("a"), (F.col("b") * 0.5).alias("b"), "c")
    m2 = iforest.iforest_fit(scaled, FEATS, row_key=["id"], n_trees=20, seed=5)
    s1 = dict((r.id, r.anomaly_raw) for r in iforest.iforest_score(df, m1).collect())
    s2 = dict((r.id, r.anomaly_raw) for r in iforest.iforest_score(scaled, m2).collect())
    assert max(abs(s1[k] - s2[k]) for k in s1) < 1e-9


def test_iforest_sample_size_and_structure(spark):
    df = _gauss_with_outliers(spark, n=2000)
    model = iforest.iforest_fit(df, FEATS, row_key=["id"], n_trees=30, max_samples=64, seed=1)
    roots = model.size[:, 0]
    assert model.psi == 64 and (roots == 64).all()
    assert model.max_depth <= 6  # ceil(log2 64)
    internal = model.feature >= 0
    # every internal node's children partition its rows
    for t in range(model.n_trees):
        for i in np.flatnonzero(internal[t]):
            assert model.size[t, model.left[t, i]] + model.size[t, model.right[t, i]] == model.size[t, i]


def test_score_matrix_fixed_forest_closed_form():
    model = iforest.fixed_forest(["f%d" % i for i in range(8)])
    x = np.zeros((1, 8))
    c = iforest.average_path_length([150, 200, 230, 256])
    c[:3] = np.floor(c[:3] * 2**20 + 0.5) / 2**20  # path lengths lie on a grid
    mean = ((2 + c[0]) + (2 + c[1]) + (1 + c[2])) / 3
    expected = -(2.0 ** (-mean / c[3]))
    assert iforest.score_matrix(x, model.arrays())[0] == pytest.approx(expected, rel=1e-15)


def test_globalwin_plan_is_distributed(spark):
    df = spark.range(2000).select(
        "id", (F.col("id") % 7).cast("double").alias("k"), F.lit(1.0).alias("v")
    )
    out = rank_and_running_total(df, "k", ["id"], "v", num_partitions=8, rank_col="r", running_col="c")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert out.rdd.getNumPartitions() == 8
    builtin = single_partition_rank_and_running_total(df, "k", ["id"], "v", rank_col="r", running_col="c")
    assert "SinglePartition" in builtin._jdf.queryExecution().executedPlan().toString()


def test_globalwin_and_quantile_edge_inputs(spark):
    empty = spark.createDataFrame([], "id long, k double, v double")
    out = rank_and_running_total(empty, "k", ["id"], "v", num_partitions=4, rank_col="r", running_col="c")
    assert out.count() == 0
    assert quantile_value(empty, "k", 0.03) is None
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, k double")
    assert quantile_value(nulls, "k", 0.5) is None
    # NULL keys rank first on DESC NULLS FIRST and share a rank; ties straddle partitions
    rows = [(i, None if i < 5 else float(i % 3), 1.0) for i in range(40)]
    sa, sb = _both(spark, rows, "id long, k double, v double", "k", "v", 6)
    assert sa == sb
    assert [r for r in sa if r[0] < 5][0][1] == 1
    one = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert quantile_value(one, "x", 0.03) == 2.0


def test_globalwin_nan_null_and_large_integers(spark):
    """NaN ties with NaN, NULL with NULL, neither with the other; integers stay exact."""
    nan = float("nan")
    rnd = random.Random(2)
    for t in range(2):
        rows = [(i, rnd.choice([None, nan, 1.0, 2.0, float(i)]), rnd.choice([None, 1.5, 2.0])) for i in range(60)]
        df_kw = dict(descending=t == 0, nulls_first=t == 0)
        sa, sb = _both(spark, rows, "id long, k double, v double", "k", "v", 7, **df_kw)
        assert str(sa) == str(sb)
    rows = [(i, rnd.choice([None, 2**53 + 1, 2**53, 2**53 + 2, 7]), rnd.choice([None, 2**53 + 1, 3])) for i in range(50)]
    sa, sb = _both(spark, rows, "id long, k long, v long", "k", "v", 6)
    assert sa == sb
    rows = [(i, D(i % 4) / 8, D("1.2345")) for i in range(50)]
    sa, sb = _both(spark, rows, "id long, k decimal(19,4), v decimal(19,4)", "k", "v", 6)
    assert sa == sb


def test_globalwin_carry_over_many_partitions_of_one_key(spark):
    from ledgerlark.plans.globalwin import _carried

    n = 40_000
    summary = spark.range(n).select(
        F.col("id").cast("int").alias("_gw_part"), F.lit(3).cast("long").alias("n"), F.lit(3).cast("long").alias("n_last"),
        F.lit(1.0).alias("first"), F.lit(1.0).alias("last"), F.lit(2.0).alias("total"),
    )
    got = sorted(_carried(summary).collect())
    assert [tuple(r) for r in got[:2]] == [(0, 0, 0, None), (1, 3, 3, 2.0)]
    assert tuple(got[-1]) == (n - 1, 3 * (n - 1), 3 * (n - 1), 2.0 * (n - 1))


def test_order_key_is_the_numbers_bits(spark):
    import struct

    from ledgerlark.functions.quantile import key_value, order_key

    rng = np.random.default_rng(0)
    vals = [0.0, -0.0, 1.0, 1e-320, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), -float("inf"),
            1.9999999999999998, 2.2250738585072014e-308, 2.225073858507201e-308, -1.5, 0.1, 2.0**52]
    vals += [float(x) for x in rng.normal(size=400) * 10.0 ** rng.integers(-305, 305, 400)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", order_key(F.col("x")).alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits) and key_value(r.k) == r.x


def test_quantile_is_four_reads_whatever_the_values(spark, monkeypatch):
    """Ties, NaN, NULL and values 600 orders of magnitude apart: four aggregates, as numpy."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(size=3000), np.full(300, -0.5), -np.exp(rng.normal(size=300) * 200)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double").repartition(3)
    reads, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: reads.append(1) or collect(self))
    for q in (0.0, 0.03, 0.4, 1.0):
        reads.clear()
        assert quantile_value(df, "x", q) == float(np.quantile(vals, q))
        assert len(reads) == 4


def test_moments_are_exact(spark):
    from ledgerlark.functions.moments import deviation, mean, moments

    rows = [(1, "99999999.99")] * 3 + [(2, "100.10"), (2, "100.20"), (2, "-3.05"), (3, "5"), (4, None), (None, "1"), (None, "2")]
    for kind in ("decimal(12,2)", "decimal(19,4)"):
        df = spark.createDataFrame(rows, "g int, p string").withColumn("p", F.col("p").cast(kind)).repartition(4)
        stats = df.groupBy("g").agg(*moments(df, "p")).select("g", "m_n", mean().alias("mean"), deviation(df, "p").alias("sd"))
        got = {r.g: (r.m_n, r["mean"], r.sd) for r in stats.collect()}
        assert got[1][0] == 3 and got[1][2] == 0.0  # equal prices: exactly none
        assert got[2][1] == pytest.approx(np.mean([100.10, 100.20, -3.05])) and got[2][2] == pytest.approx(np.std([100.10, 100.20, -3.05], ddof=1), rel=1e-15)
        assert got[3] == (1, 5.0, None) and got[4] == (0, None, None) and got[None][2] == pytest.approx(0.5**0.5)
    with pytest.raises(TypeError):
        moments(df.withColumn("p", F.col("p").cast("double")), "p")


def test_no_python_in_ranked_reports(spark):
    from ledgerlark import workload
    from tests.conftest import SF_SMALL

    for name in ("vendor_spend_ranked", "vendor_pareto", "salesperson_attainment"):
        plan = workload.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_iforest_draws_more_when_a_tree_lacks_rows(spark, monkeypatch):
    """Too low a share of hashes shows in the trees' sizes and is mended."""
    df = _gauss_with_outliers(spark, n=900)
    want = iforest.iforest_fit(df, FEATS, row_key=["id"], n_trees=9, max_samples=64, seed=2)
    sample = iforest._sample
    rates = []

    def scarce(x, n, psi, n_trees, seed, pool_rows, rate):
        rates.append(rate)
        return sample(x, n, psi, n_trees, seed, pool_rows, rate / 20 if len(rates) == 1 else rate)

    monkeypatch.setattr(iforest, "_sample", scarce)
    got = iforest.iforest_fit(df, FEATS, row_key=["id"], n_trees=9, max_samples=64, seed=2)
    assert len(rates) == 2 and (got.threshold == want.threshold).all() and (got.size == want.size).all()


def test_exact_ratio_against_fractions(spark):
    """Halves, signs, DECIMAL(19,4) and totals beyond 2**53 cents, as exact fractions say."""
    from fractions import Fraction

    from ledgerlark.functions.exprs import exact_ratio, growth_pct, pct

    rnd = random.Random(5)
    pairs = [("1", "8"), ("-1", "8"), ("1", "-8"), ("0.0005", "0.0100"), ("123456789012345.6789", "9999.9999"), ("1", "0"), (None, "1"), ("1", None),
             ("90071992547409.93", "90071992547409.91"), ("1.005", "100"), ("2.675", "100"), ("-2.675", "100"), ("0", "7")]
    pairs += [(f"{rnd.randint(-10**14, 10**14)}.{rnd.randint(0, 9999):04d}", f"{rnd.randint(1, 10**rnd.randint(1, 14))}.{rnd.randint(0, 9999):04d}") for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.col("a").cast("decimal(19,4)"), F.col("b").cast("decimal(19,4)"))

    def rounded(x, places):
        if x is None:
            return None
        scaled = abs(x) * 10**places
        whole = int(scaled + Fraction(1, 2))
        return float(Fraction(whole if x > 0 else -whole, 10**places))

    got = df.select("a", "b", pct("a", "b").alias("p"), growth_pct("a", "b").alias("g"), exact_ratio("a", "b", 4).alias("r")).collect()
    for r in got:
        x = None if r.a is None or not r.b else Fraction(r.a) / Fraction(r.b)
        assert r.p == (None if x is None else rounded(x * 100, 2))
        assert r.g == (None if x is None else rounded((x - 1) * 100, 2))
        assert r.r == (None if x is None else rounded(x, 4))
    whole = spark.range(1).select(pct(F.lit(1), F.lit(3)).alias("x"), pct(F.lit(2**60), F.lit(2**61)).alias("y")).first()
    assert (whole.x, whole.y) == (33.33, 50.0)
