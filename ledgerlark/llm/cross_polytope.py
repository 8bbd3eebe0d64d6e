"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three fast Hadamard transforms, each after random sign
flips, and assigns them to the nearest of the signed axes.  A row is stored in its own
cell of every table; a query probes the ``probes`` cells whose axes are nearest to it
(``width`` hashes make one cell name; probes then are the combinations with the largest
sums).  All rows of a probed cell are candidates and are ranked exactly, by cosine on
the original vectors in double precision; the best of all cells are merged.

Copies of a vector are one row here, stood for by their smallest ids.  A cell with many
rows or queries is cut into blocks, and a task ranks one pair of blocks; it returns the
best rows of each query only.  Queries for which the cells hold too few candidates are
ranked against all rows in such blocks, so a query gets fewer than ``k`` neighbours
only where there are fewer.

Edge cases: vectors that are null, zero or hold null or non-finite numbers take no
part, as query or candidate, nor do rows without an id; vectors meet only vectors of
their own length; rows that repeat id and vector count once; ties go to the smaller id;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool
from .vectors import block_pairs, copies, matrix, usable


@dataclass(frozen=True)
class CrossPolytope:
    """Tables of signed-axis cells; ``(2 * dims) ** width`` cells in each."""

    tables: int = 16
    probes: int = 5
    width: int = 1
    seed: int = 42

    def rotated(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Pseudo-rotation of unit rows, zero-padded to a power of two."""
        dims = 1 << max(0, (x.shape[1] - 1).bit_length())
        rng = np.random.default_rng([self.seed, table, part, dims])
        y = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        for _ in range(3):
            y = y * (rng.integers(0, 2, dims) * 2 - 1)
            half = 1
            while half < dims:
                pair = y.reshape(len(y), -1, 2, half)
                y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(x), dims)
                half *= 2
            y = y / np.sqrt(dims)
        return y

    def cells(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each unit row, nearest first."""
        name, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for part in range(self.width):
            y = self.rotated(x, table, part)
            axes = np.concatenate([y, -y], axis=1)
            top = np.argsort(-axes, axis=1, kind="stable")[:, :probes]
            gain = np.take_along_axis(axes, top, axis=1)
            score = (score[:, :, None] + gain[:, None, :]).reshape(len(x), -1)
            name = (name[:, :, None] * axes.shape[1] + top[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            score, name = np.take_along_axis(score, best, axis=1), np.take_along_axis(name, best, axis=1)
        return name


def _in_cells(rows: DataFrame, hashing: CrossPolytope, probes: int) -> DataFrame:
    """``(dims, tab, cell, rep, vec)``: each row once for every table and probed cell."""

    def run(batches):
        for b in batches:
            size = np.array([len(v) for v in b.column(1)])
            for dims in np.unique(size).tolist():
                at = pa.array(np.flatnonzero(size == dims))
                rep, vec = b.column(0).take(at), b.column(1).take(at)
                x = matrix(pa.chunked_array([vec]))
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                for t in range(hashing.tables):
                    cells = hashing.cells(x, t, probes)
                    for p in range(cells.shape[1]):
                        n = len(rep)
                        yield pa.record_batch(
                            [pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells[:, p]), rep, vec],
                            names=["dims", "tab", "cell", "rep", "vec"],
                        )

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("rep", "vec").mapInArrow(run, f"dims int, tab int, cell long, rep long, vec {kind}")


def _best(keep: int):
    """Task: the ``keep`` nearest left rows of every right row of a block pair."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        rep = table["rep"].to_numpy()
        out = []
        if (side == 0).any() and (side == 1).any():
            x = matrix(table["vec"])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            rows, queries = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            rows = rows[np.argsort(rep[rows])]
            left = x[rows] / norm[rows, None]
            step = max(1, (1 << 22) // len(rows))
            for at in range(0, len(queries), step):
                q = queries[at : at + step]
                got = (x[q] / norm[q, None]) @ left.T
                n = min(len(rows), keep + 3)  # a few more, as the exact sums may order them anew
                top = np.argpartition(-got, n - 1, axis=1)[:, :n] if n < len(rows) else np.tile(np.arange(n), (len(q), 1))
                # every row that ties with the last one stays in reach of the smaller id
                low = np.take_along_axis(got, top, axis=1).min(axis=1) - 1e-12
                qi, ri = np.nonzero(got >= low[:, None])
                a, b = q[qi], rows[ri]
                score = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b])
                o = np.lexsort((rep[b], -score, qi))
                qi, a, b, score = qi[o], a[o], b[o], score[o]
                first = np.searchsorted(qi, qi)
                fit = np.arange(len(qi)) - first < keep
                out.append((rep[a[fit]], rep[b[fit]], score[fit]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": cols[0], "rep": cols[1], "score": cols[2]})

    return run


def _ranked(left: DataFrame, right: DataFrame, keep: int) -> DataFrame:
    keys = ["dims", "tab", "cell"]
    return block_pairs(left, right, keys).groupBy(*keys, "lb", "rb").applyInArrow(_best(keep), "query long, rep long, score double")


def nearest(
    df: DataFrame, queries: Column, k: int = 5, hashing: CrossPolytope | None = None, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` nearest other rows found.

    ``queries`` picks the rows that ask; every other row of ``df`` is a candidate.
    """
    hashing = hashing or CrossPolytope()
    rows = usable(df.select(id_col, vec_col), id_col, vec_col)
    asks = usable(df.where(queries), id_col, vec_col).distinct()
    classes, _ = spool(copies(rows, k + 1), "classes")
    asked, _ = spool(asks.join(classes.select("rep", "vec"), "vec").select("id", "rep"), "asked")
    askers = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")

    def merged(found: DataFrame) -> DataFrame:
        """The k + 1 nearest rows of each asking vector."""
        pairs = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        members = pairs.join(classes.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("id"), "score")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return members.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k + 1).drop("k")

    left = _in_cells(classes, hashing, 1)
    right = _in_cells(askers, hashing, hashing.probes)
    near, _ = spool(merged(_ranked(left, right, k + 1)), "near")
    full = near.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    few, _ = spool(askers.join(full.select(F.col("query").alias("rep")), "rep", "left_anti"), "few")
    if not few.isEmpty():
        cell = [F.size("vec").alias("dims"), F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("cell"), "rep", "vec"]
        rest = merged(_ranked(classes.select(*cell), few.select(*cell), k + 1))
        near = near.join(full.select("query"), "query", "left_semi").unionByName(rest)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(near, "query").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
