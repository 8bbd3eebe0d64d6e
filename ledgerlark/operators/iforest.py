"""Isolation forest as Spark jobs (workload operators 15 and 16).

Fit (Liu, Ting & Zhou, ICDM 2008), with all random numbers taken from ``md5`` of (seed,
tree, node or row key), so the forest depends on the data alone, not on partitioning,
retries or the engine:
  * a pool of about ``pool_rows`` rows (all, if the table has no more) is drawn by one
    hash per row; from the pool each tree takes the ``psi = min(max_samples, n)`` rows
    whose hash for the tree is smallest (four trees share a digest, eight digits each);
  * the sample is dealt by tree once, and trees grow level by level: a window aggregate
    over (tree, node) gives each node its rows' count and each feature's least and
    largest value; the node's hash chooses a feature among those that are not constant
    and a place between its ends, and its rows go on to the two children.  The height
    limit is ``ceil(log2 psi)``.  A window holds the rows of one node, ``psi`` at most;
  * the result is the node table, at most ``n_trees * (2 psi - 1)`` rows, spooled.
    Nodes are numbered as in a heap: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``.

Features are read in single precision, so noise in the last binary digits of a derived
feature never makes it look as if it varied.

Score: the node table's arrays are broadcast once (its size is bounded by the parameters
above, not by the data); a pandas UDF walks all trees for an Arrow batch at a time with
numpy (no per-row Python).  Path length is the leaf depth plus ``c(leaf size)``, on a grid
of 2**-20 so that sums over trees are exact in any order; score = -2 ** (-mean path /
c(psi)) (lower = more anomalous).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.plans.spool import spool
from ledgerlark.session import ship_package

EULER_GAMMA = 0.5772156649015329
HASH_RANGE = 2**52  # a node's hashes are 13 hex digits each
PATH_GRID = 2.0**20  # path lengths are multiples of 1 / PATH_GRID

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType(), False),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("feature", T.IntegerType(), False),  # -1 for a leaf
        T.StructField("threshold", T.DoubleType(), False),  # go left when x <= threshold
        T.StructField("left", T.IntegerType(), False),
        T.StructField("right", T.IntegerType(), False),
        T.StructField("size", T.LongType(), False),  # training rows reaching the node
        T.StructField("depth", T.IntegerType(), False),
    ]
)


def average_path_length(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


@dataclass
class IsolationForestModel:
    """Fitted forest as dense per-tree node arrays (shape n_trees x max_nodes)."""

    features: list[str]
    psi: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    depth: np.ndarray
    seed: int = 42
    _bc: object = field(default=None, repr=False, compare=False)

    @property
    def n_trees(self) -> int:
        return int(self.feature.shape[0])

    @property
    def max_depth(self) -> int:
        return int(self.depth.max()) if self.depth.size else 0

    @classmethod
    def from_nodes(cls, rows, features, psi, seed=42) -> "IsolationForestModel":
        """Build from node-table rows (dicts / Rows with NODE_SCHEMA fields)."""
        rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
        n_trees = max(r["tree_id"] for r in rows) + 1
        width = max(r["node_id"] for r in rows) + 1
        arr = {
            "feature": np.full((n_trees, width), -1, np.int32),
            "threshold": np.zeros((n_trees, width), np.float64),
            "left": np.zeros((n_trees, width), np.int32),
            "right": np.zeros((n_trees, width), np.int32),
            "size": np.zeros((n_trees, width), np.int64),
            "depth": np.zeros((n_trees, width), np.int32),
        }
        for r in rows:
            t, i = r["tree_id"], r["node_id"]
            for k in arr:
                arr[k][t, i] = r[k]
        return cls(features=list(features), psi=int(psi), seed=seed, **arr)

    def nodes(self) -> list[tuple]:
        out = []
        for t in range(self.n_trees):
            for i in range(self.feature.shape[1]):
                if self.size[t, i] == 0 and i > 0:
                    continue
                out.append(
                    (t, i, int(self.feature[t, i]), float(self.threshold[t, i]),
                     int(self.left[t, i]), int(self.right[t, i]),
                     int(self.size[t, i]), int(self.depth[t, i]))
                )
        return out

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        pdf = pd.DataFrame(self.nodes(), columns=[f.name for f in NODE_SCHEMA.fields])
        return spark.createDataFrame(pdf, NODE_SCHEMA)

    def leaf_path(self) -> np.ndarray:
        """depth + c(size) for every node (used at leaves), on the grid of path lengths."""
        return self.depth.astype(np.float64) + np.floor(average_path_length(self.size) * PATH_GRID + 0.5) / PATH_GRID

    def arrays(self) -> dict:
        """Trees in heap layout for scoring: node h has children 2h+1 and 2h+2.

        Every tree is padded to a complete tree of depth ``max_depth``: below a
        shallow leaf, virtual nodes always go left (threshold +inf) down to the last
        level, where the leaf's path length (depth + c(size)) is stored.  Scoring is
        then the same short loop for every row, with no leaf tests.
        """
        depth_limit = self.max_depth
        slots = 2 ** (depth_limit + 1) - 1
        feat = np.zeros((self.n_trees, slots), np.int64)
        thr = np.full((self.n_trees, slots), np.inf)
        leaf_value = np.zeros((self.n_trees, slots))
        path = self.leaf_path()
        for t in range(self.n_trees):
            stack = [(0, 0, 0)]
            while stack:
                i, h, d = stack.pop()
                f = int(self.feature[t, i])
                if f >= 0:
                    feat[t, h] = f
                    thr[t, h] = self.threshold[t, i]
                    stack.append((int(self.left[t, i]), 2 * h + 1, d + 1))
                    stack.append((int(self.right[t, i]), 2 * h + 2, d + 1))
                else:
                    while d < depth_limit:
                        h, d = 2 * h + 1, d + 1
                    leaf_value[t, h] = path[t, i]
        return {
            "feature": feat,
            "threshold": thr,
            "leaf_value": leaf_value,
            "depth": depth_limit,
            "c_psi": float(average_path_length([self.psi])[0]),
        }


def score_matrix(x: np.ndarray, m: dict) -> np.ndarray:
    """Anomaly scores for the rows of ``x`` (n x n_features) under ``arrays()`` ``m``.

    x must be NaN-free (features are filled with 0).  Per tree: ``depth`` rounds of
    gather + compare + index arithmetic over the whole batch.  Path lengths lie on a grid,
    so their sums are exact.
    """
    n = x.shape[0]
    n_trees = m["feature"].shape[0]
    xt = np.ascontiguousarray(x.T, dtype=np.float64)
    flat = xt.ravel()
    col = np.arange(n, dtype=np.int64)
    total = np.zeros(n, dtype=np.float64)
    for t in range(n_trees):
        feature, thr = m["feature"][t], m["threshold"][t]
        h, met = np.zeros(n, dtype=np.int64), 0
        if m["depth"] >= 2:  # all rows share the root, then one of two nodes: no gathers
            left, right = (xt[feature[i]] > thr[i] for i in (1, 2))
            h, met = np.where(xt[feature[0]] > thr[0], right + np.int64(5), left + np.int64(3)), 2
        feat_off = feature * n  # offset of each node's feature column in flat
        for _ in range(met, m["depth"]):
            at = feat_off[h]
            at += col
            go_right = flat[at] > thr[h]
            h *= 2
            h += 1
            h += go_right
        total = total + m["leaf_value"][t][h]
    mean = total / n_trees
    return -np.power(2.0, -mean / m["c_psi"])


def feature_matrix(cols) -> list[F.Column]:
    """Feature columns in single precision, as doubles, with NULL and NaN -> 0."""
    return [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float").cast("double") for c in cols]


def score_column(model: IsolationForestModel, spark: SparkSession | None = None) -> F.Column:
    """Column expression: anomaly score of each row from the model's feature columns."""
    spark = spark or SparkSession.getActiveSession()
    ship_package(spark)
    if model._bc is None:
        model._bc = spark.sparkContext.broadcast(model.arrays())
    bc = model._bc

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
        return pd.Series(score_matrix(x, bc.value))

    return _score(*feature_matrix(model.features))


def iforest_score(df: DataFrame, model: IsolationForestModel, out: str = "anomaly_raw") -> DataFrame:
    return df.withColumn(out, score_column(model, df.sparkSession))


#: Trees that share a digest; each has eight of its hex digits.
TREES_OF_DIGEST = 4


def _digest(*parts) -> Column:
    """md5 of the parts, joined by colons, as 32 hex digits."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _cut(rate: float, digits: int) -> str:
    """Hex digits below which a share ``rate`` of all lies; beyond all from 1 on."""
    return f"{math.ceil(rate * 16**digits):0{digits}x}" if rate < 1.0 else "g"


def _sample(x: DataFrame, n: int, psi: int, n_trees: int, seed: int, pool_rows: int, rate: float) -> DataFrame:
    """``(tree_id, f0, f1, ...)``: for each tree the ``psi`` pool rows of smallest hash.

    Only hashes below ``rate`` are looked at; too low a rate shows as trees of fewer rows.
    """
    values = [c for c in x.columns if c != "row"]
    pool = x.where(F.substring(_digest(seed, F.col("row")), 1, 13) < _cut(pool_rows / n, 13))
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool = pool.repartition(parts, "row")  # few rows, much hashing: not by the scan's splits
    some = F.explode(F.sequence(F.lit(0), F.lit((n_trees - 1) // TREES_OF_DIGEST))).alias("some")
    digests = pool.select("*", some).withColumn("digest", _digest(seed, F.col("some"), F.col("row")))
    draws = [F.substring("digest", 1 + 8 * k, 8) for k in range(TREES_OF_DIGEST)]
    trees = F.array(*[F.struct((F.col("some") * TREES_OF_DIGEST + k).alias("tree_id"), d.alias("draw")) for k, d in enumerate(draws)])
    drawn = digests.where(F.least(*draws) < _cut(rate, 8)).select("row", *values, F.inline(trees))
    drawn = drawn.where((F.col("draw") < _cut(rate, 8)) & (F.col("tree_id") < n_trees))
    # one shuffle by tree serves sampling and all levels; a number keeps AQE from merging it
    dealt = drawn.repartition(min(n_trees, parts), "tree_id")
    w = Window.partitionBy("tree_id").orderBy("draw", "row", *values)
    return dealt.withColumn("place", F.row_number().over(w)).where(F.col("place") <= psi).select("tree_id", *values)


def _split(rows: DataFrame, k: int, n_features: int, seed: int) -> DataFrame:
    """Level ``k``: every row's node gets its split (columns ``node_k``, ``feature_k``,
    ``threshold_k``, ``size_k``), and the row its child in ``node``.

    A node without a feature that varies keeps its rows.
    """
    here, every = "OVER (PARTITION BY tree_id, node)", range(n_features)
    kept = rows.columns
    ends = rows.selectExpr(
        "*", f"count(1) {here} AS size",
        *[f"min(f{i}) {here} AS low{i}" for i in every], *[f"max(f{i}) {here} AS high{i}" for i in every],
    )
    digest = _digest(seed, F.col("tree_id"), F.col("node")).alias("digest")
    varied = F.expr(f"array_remove(array({', '.join(f'if(high{i} > low{i}, {i}, -1)' for i in every)}), -1) AS varied")
    chance = "conv(substring(digest, {at}, 13), 16, 10) / " + repr(float(HASH_RANGE))
    chosen = ends.select("*", digest, varied).selectExpr(
        "*", f"get(varied, int(floor({chance.format(at=1)} * size(varied)))) AS feature", f"{chance.format(at=14)} AS place"
    )
    of = {c: f"get(array({', '.join(f'{c}{i}' for i in every)}), feature) AS {c}" for c in ("low", "high", "f")}
    placed = chosen.selectExpr("*", *of.values()).selectExpr("*", "low + place * (high - low) AS inside")
    cut = placed.selectExpr("*", "if(inside < high, inside, low) AS threshold")
    return cut.selectExpr(
        *[c for c in kept if c != "node"],
        f"node AS node_{k}", f"feature AS feature_{k}", f"threshold AS threshold_{k}", f"size AS size_{k}",
        "if(feature IS NULL, node, node * 2 + if(f <= threshold, 1, 2)) AS node",
    )


def _grow(sample: DataFrame, n_features: int, height: int, seed: int) -> DataFrame:
    """Node table of the trees grown on ``sample``."""
    rows = sample.withColumn("node", F.lit(0))
    for k in range(height):
        rows = _split(rows, k, n_features, seed)
    ends = rows.selectExpr("*", "count(1) OVER (PARTITION BY tree_id, node) AS size")
    met = [f"struct(node_{k} AS node, feature_{k} AS feature, threshold_{k} AS threshold, size_{k} AS size)" for k in range(height)]
    leaf = "struct(node, int(null) AS feature, double(null) AS threshold, size)"
    found = (
        ends.selectExpr("tree_id", f"inline(array({', '.join([*met, leaf])}))")
        .groupBy("tree_id", "node")
        .agg(F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.max("size").alias("size"))
    )
    return found.selectExpr(
        "int(tree_id) AS tree_id",
        "node AS node_id",
        "coalesce(feature, -1) AS feature",
        "coalesce(threshold, 0D) AS threshold",
        "if(feature IS NULL, 0, node * 2 + 1) AS left",
        "if(feature IS NULL, 0, node * 2 + 2) AS right",
        "size",
        "int(floor(log2(node + 1.5D))) AS depth",
    )


def fit_nodes(
    df: DataFrame,
    features: list[str],
    row_key: list[str],
    n_trees: int = 200,
    max_samples: int = 256,
    seed: int = 42,
    pool_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """Node table of a forest fitted on ``features`` of ``df``, and its sample size ``psi``.

    ``row_key`` names a row; rows that share one are drawn together.  ``pool_rows``
    (``n_trees * max_samples`` by default) bounds the rows that sampling hashes per tree.
    Reads ``df`` twice (count, pool): pass a spooled / file-backed DataFrame.
    """
    pool_rows = pool_rows or n_trees * max_samples
    row = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_key])
    x = df.select(row.alias("row"), *[c.alias(f"f{i}") for i, c in enumerate(feature_matrix(features))])
    n = df.count()
    if n == 0:
        raise ValueError("cannot fit an isolation forest on an empty input")
    psi = min(max_samples, n)
    height = math.ceil(math.log2(max(psi, 2)))
    # enough for psi rows of every tree but for odds below 1e-16; seen and mended if not
    rate = min(1.0, (psi + 10 * math.sqrt(psi) + 20) / min(n, pool_rows))
    while True:
        nodes = spool(_grow(_sample(x, n, psi, n_trees, seed, pool_rows, rate), len(features), height, seed), "forest")
        if rate >= 1.0 or nodes.where((F.col("node_id") == 0) & (F.col("size") == psi)).count() == n_trees:
            return nodes, psi
        rate = min(1.0, rate * 4)


def iforest_fit(
    df: DataFrame,
    features: list[str],
    row_key: list[str],
    n_trees: int = 200,
    max_samples: int = 256,
    seed: int = 42,
    pool_rows: int | None = None,
) -> IsolationForestModel:
    """A fitted forest for scoring: the node table of ``fit_nodes``, at most
    ``n_trees * (2 * max_samples - 1)`` rows, as arrays."""
    nodes, psi = fit_nodes(df, features, row_key, n_trees, max_samples, seed, pool_rows)
    return IsolationForestModel.from_nodes(nodes.collect(), features, psi, seed)


def fixed_forest(features: list[str]) -> IsolationForestModel:
    """A fixed three-tree forest over the eight anomaly features.

    Used to check scoring, flagging and the anomaly reports against SQL: its score
    is a closed-form CASE expression, unlike that of a randomly grown forest.
    Feature order: unitprice, orderqty, line_total, z_score, price_to_stdcost_ratio,
    rejection_rate, line_pct_of_po, price_deviation_pct.
    """
    # Fixed values: (tree, node, feature, threshold, left, right, size, depth)
    nodes = [
        (0, 0, 0, 60000.0, 1, 2, 256, 0),
        (0, 1, 1, 40.0, 3, 4, 190, 1),
        (0, 2, 3, 1.0, 5, 6, 66, 1),
        (0, 3, -1, 0.0, 0, 0, 150, 2),
        (0, 4, -1, 0.0, 0, 0, 40, 2),
        (0, 5, -1, 0.0, 0, 0, 60, 2),
        (0, 6, -1, 0.0, 0, 0, 6, 2),
        (1, 0, 5, 0.1, 1, 2, 256, 0),
        (1, 1, 6, 2000.0, 3, 4, 244, 1),
        (1, 2, -1, 0.0, 0, 0, 12, 1),
        (1, 3, -1, 0.0, 0, 0, 200, 2),
        (1, 4, -1, 0.0, 0, 0, 44, 2),
        (2, 0, 4, 30.0, 1, 2, 256, 0),
        (2, 1, -1, 0.0, 0, 0, 230, 1),
        (2, 2, 7, -20.0, 3, 4, 26, 1),
        (2, 3, -1, 0.0, 0, 0, 3, 2),
        (2, 4, -1, 0.0, 0, 0, 23, 2),
    ]
    cols = [f.name for f in NODE_SCHEMA.fields]
    return IsolationForestModel.from_nodes(
        [dict(zip(cols, r)) for r in nodes], features, psi=256
    )
