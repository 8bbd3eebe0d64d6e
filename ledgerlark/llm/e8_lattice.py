"""Embedding near-duplicates by E8 lattice hashing.

A table projects unit vectors to eight dimensions by a random Gaussian matrix, scales
and shifts them, and decodes each to the nearest point of the E8 lattice: the better of
the nearest points of D8 and of D8 moved by one half.  That point is the vector's home
cell; it also probes the ``probes`` nearest of the 240 cells around it.  Vectors meet
where one's home is the other's home or probe, in any table, and link if their cosine,
in double precision on the original vectors, is at least ``threshold``.

Copies of a vector are one row here.  A cell with many rows is cut into blocks and a
task compares one pair of blocks.  A task returns counts and a spanning forest, never
its pairs: a pair that meets in several places is counted in the first, which both
rows' cells tell.

Edge cases: vectors that are null, zero or hold null or non-finite numbers link with
nothing, and are returned as a component of their own; vectors meet only vectors of
their own length; rows that repeat id and vector count once and are returned as often
as they occur; rows without an id are returned without a component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spool, union_labels
from .vectors import block_pairs, matrix, usable


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, times two."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [s for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(y)
    gap = y - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2)
    worst = np.argmax(np.abs(gap[odd]), axis=1)
    r[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points, times two (integers)."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


@dataclass(frozen=True)
class E8Tables:
    """Projections, and the cells of vectors in them."""

    tables: int = 12
    probes: int = 8
    scale: float = 0.9
    seed: int = 42

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """Names of the home cell and of the probes of unit rows, nearest first."""
        rng = np.random.default_rng([self.seed, table, x.shape[1]])
        g, shift = rng.normal(size=(8, x.shape[1])) * self.scale, rng.random(8)
        out = np.empty((len(x), 1 + self.probes), np.int64)
        weights = rng.integers(1, 1 << 62, 8) | 1
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            # sums row by row, not by BLAS: the same in every batch, to the last bit
            y = np.stack([(part * g[k]).sum(axis=1) for k in range(8)], 1) + shift
            home = decode(y)
            step = (y - home / 2) @ neighbours().T.astype(np.float64)  # larger: nearer
            near = np.argsort(-np.round(step, 9), axis=1, kind="stable")[:, : self.probes]
            points = np.concatenate([home[:, None], home[:, None] + neighbours()[near]], axis=1)
            out[at : at + 2048] = (points * weights).sum(axis=2)
        return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled to a largest entry of one, their norms, unit rows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm, x / norm[:, None]


def _in_cells(rows: DataFrame, tables: E8Tables, homes_only: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            size = np.array([len(v) for v in b.column(2)])
            for dims in np.unique(size).tolist():
                at = pa.array(np.flatnonzero(size == dims))
                rep, n, vec = (b.column(k).take(at) for k in range(3))
                unit = _unit(matrix(pa.chunked_array([vec])))[2]
                for t in range(tables.tables):
                    cells = tables.cells(unit, t)
                    for p in range(1 if homes_only else cells.shape[1]):
                        yield pa.record_batch(
                            [pa.array(np.full(len(at), dims, np.int32)), pa.array(np.full(len(at), t, np.int32)), pa.array(cells[:, p]), rep, n, pa.array(np.full(len(at), p == 0)), vec],
                            names=["dims", "tab", "cell", "rep", "n", "home", "vec"],
                        )

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("rep", "n", "vec").mapInArrow(run, f"dims int, tab int, cell long, rep long, n long, home boolean, vec {kind}")


def _first_meeting(cells_a: np.ndarray, cells_b: np.ndarray) -> np.ndarray:
    """Whether a pair meets: one's home among the other's cells."""
    return (cells_b == cells_a[:, :1]).any(axis=1) | (cells_a == cells_b[:, :1]).any(axis=1)


def _links(tables: E8Tables, threshold: float):
    """Task: left (home) rows against right rows of a cell; counts and a forest."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, rep, n, home = (table[c].to_numpy() for c in ("side", "rep", "n", "home"))
        tab = key[1].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, norm, unit = _unit(matrix(table["vec"]))
        ids, place = np.unique(rep, return_inverse=True)
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        held = {}  # by table: cells of the rows that a pair needed so far, and which those are

        def cells(t, a, b):
            if t not in held:
                held[t] = np.zeros((len(rep), 1 + tables.probes), np.int64), np.zeros(len(rep), bool)
            known, have = held[t]
            need = np.zeros(len(rep), bool)
            need[a], need[b] = True, True
            new = np.flatnonzero(need & ~have)
            if len(new):
                known[new], have[new] = tables.cells(unit[new], t), True
            return known[a], known[b]

        step = max(1, (1 << 20) // max(1, len(left)))
        for at in range(0, len(right), step) if len(left) else ():
            r = right[at : at + step]
            ri, li = np.nonzero(unit[r] @ unit[left].T >= threshold - 1e-9)
            # pairs of a chunk are reduced before the next: a hot group has many
            for k in range(0, len(ri), 1 << 16):
                a, b = left[li[k : k + (1 << 16)]], r[ri[k : k + (1 << 16)]]
                # two homes meet twice here; a probing row meets a home once
                fit = (rep[a] != rep[b]) & (~home[b] | (rep[a] < rep[b]))
                a, b = a[fit], b[fit]
                near = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
                a, b = a[near], b[near]
                # the forest takes all pairs of this cell, the counts those that meet here first
                label = union_labels(len(ids), place[a], place[b], label)
                for t in range(tab):
                    if len(a):
                        other = ~_first_meeting(*cells(t, a, b))
                        a, b = a[other], b[other]
                # in this table: a home pair meets at home; else a probe of b holds a's home,
                # and if a probes b's home too the pair is counted where a is the smaller
                if len(a):
                    of_a, of_b = cells(tab, a, b)
                    back = (of_a[:, 1:] == of_b[:, :1]).any(axis=1)
                    first = home[b] | ~back | (rep[a] < rep[b])
                    a, b = a[first], b[first]
                np.add.at(links, place[a], n[b])
                np.add.at(links, place[b], n[a])
        tied = np.flatnonzero(label != np.arange(len(ids)))
        some = np.flatnonzero(links)
        return pa.table({
            "u": np.concatenate([ids[tied], ids[some]]),
            "v": pa.array(np.concatenate([ids[label[tied]], ids[some]])),
            "links": np.concatenate([np.zeros(len(tied), np.int64), links[some]]),
        })

    return run


def embedding_near_dedup(
    df: DataFrame, threshold: float = 0.9, tables: E8Tables | None = None, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``df``.

    ``n_links``: other vectors linked directly; ``component_id``: the smallest id
    reachable; ``kept``: whether that is the row's own.
    """
    tables = tables or E8Tables()
    rows, _ = spool(usable(df, id_col, vec_col).distinct(), "rows")
    counted = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes, _ = spool(counted.select("rep", "n", "vec"), "classes")
    left, right = _in_cells(classes, tables, True), _in_cells(classes, tables, False)
    keys = ["dims", "tab", "cell"]
    dealt = block_pairs(left, right, keys)
    found, _ = spool(dealt.groupBy(*keys, "lb", "rb").applyInArrow(_links(tables, threshold), "u long, v long, links long"), "links")
    comp = components(found.where("u <> v").select("u", "v"))
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named, _ = spool(
        named.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")),
        "named",
    )
    linked = rows.join(named, "vec").select("id", "n_links", "component_id")
    # an id with several vectors: its links add up, its component is the smallest
    linked = linked.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(id_col)).join(linked, F.col(id_col) == F.col("id"), "left")
    component = F.coalesce("component_id", F.col(id_col).cast("long"))
    return out.select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col(id_col) == component).alias("kept"),
    )
