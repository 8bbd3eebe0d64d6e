"""SimHash near-duplicates by a binary trie self-join.

Every text becomes a 64-bit SimHash fingerprint of its word shingles.  The distinct
fingerprints form a binary trie (most significant bit first).  The trie is joined with
itself: node pairs are walked together from the root, differing bits add up, and a
pair is dropped as soon as they exceed the error budget.

Spark deals out the top of the trie: the first bits of a fingerprint name a block, a
task holds one pair of blocks whose names differ in at most the budget, and a block
with more than ``BLOCK_ROWS`` fingerprints is dealt over several sub-blocks, each pair
of which is a task.  A task returns a spanning forest of the links it found (at most
one row per fingerprint), so a large group of near copies never becomes all its pairs.

Edge cases: null text counts as empty; a text without words has fingerprint zero and
links like any other; fewer words than a shingle make one shingle of all words; rows
with a null id get the component of their fingerprint but never name it; repeated rows
are returned as often as they occur; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, partitions, small_batches, spool, union_labels

#: Fingerprints in one block of a task, at most.
BLOCK_ROWS = 1 << 17
#: Node pairs expanded at once inside a task.
PAIR_CHUNK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text (see the module's notes)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([text_fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


class Trie:
    """Binary trie over sorted distinct fingerprints, one array of nodes per depth.

    ``start[d][j]`` is the first leaf of node ``j`` at depth ``d``; ``child[d][j]`` its
    first child at depth ``d + 1``.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        gap = np.zeros(n, np.int64)  # number of leading bits shared with the leaf before
        if n > 1:
            x = fps[1:] ^ fps[:-1]
            hi = (x >> np.uint64(32)).astype(np.float64)
            lo = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
            gap[1:] = np.where(hi > 0, 32 - np.frexp(hi)[1], 64 - np.frexp(lo)[1])
        first = np.zeros(n, bool)
        first[:1] = True
        self.start = [np.append(np.flatnonzero(first | (gap < d)), n) for d in range(65)]
        self.child = [np.searchsorted(self.start[d + 1], self.start[d]) for d in range(64)]
        self.size = [np.diff(s) for s in self.start]

    def labels(self, leaf: np.ndarray) -> list[np.ndarray]:
        """Per depth: the component all leaves of a node share, or -1."""
        out = []
        for s in self.start:
            lo, hi = np.minimum.reduceat(leaf, s[:-1]), np.maximum.reduceat(leaf, s[:-1])
            out.append(np.where(lo == hi, lo, -1))
        return out


def _join(left: Trie, right: Trie, same: bool, budget: int, comp: np.ndarray):
    """Leaf pairs ``(i, j)`` within ``budget`` bits, walked depth first in chunks.

    ``comp`` labels left leaves, then right leaves (the same array if ``same``); pairs
    of nodes that lie whole in one component are dropped.
    """
    n = len(left.fps)
    lab_l = left.labels(comp[:n])
    lab_r = lab_l if same else right.labels(comp[n:])
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, np.zeros(1, np.int8))]
    while stack:
        d, u, v, err = stack.pop()
        if len(u) > PAIR_CHUNK:
            stack.append((d, u[PAIR_CHUNK:], v[PAIR_CHUNK:], err[PAIR_CHUNK:]))
            u, v, err = u[:PAIR_CHUNK], v[:PAIR_CHUNK], err[:PAIR_CHUNK]
        a, b = lab_l[d][u], lab_r[d][v]
        open_ = (a != b) | (a < 0)
        single = (left.size[d][u] == 1) & (right.size[d][v] == 1)
        done = open_ & single
        if done.any():
            i, j = left.start[d][u[done]], right.start[d][v[done]]
            near = np.bitwise_count(left.fps[i] ^ right.fps[j]) <= budget
            if near.any():
                yield i[near], j[near]
        go = open_ & ~single
        u, v, err = u[go], v[go], err[go]
        if not len(u) or d == 64:
            continue
        bit = np.uint64(63 - d)
        cu, cv = left.child[d][u], right.child[d][v]
        nu, nv = left.child[d][u + 1] - cu, right.child[d][v + 1] - cv
        bu = (left.fps[left.start[d + 1][cu]] >> bit & np.uint64(1)).astype(np.int8)
        bv = (right.fps[right.start[d + 1][cv]] >> bit & np.uint64(1)).astype(np.int8)
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                ok = (nu > x) & (nv > y)
                if same and x > y:
                    ok &= u != v
                e = err + (bu ^ x ^ bv ^ y)
                ok &= e <= budget
                if ok.any():
                    parts.append((cu[ok] + x, cv[ok] + y, e[ok]))
        if parts:
            stack.append((d + 1, *(np.concatenate(z) for z in zip(*parts, strict=True))))


def linked(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest ``(a, b)`` of the links within ``left``, or from left to right.

    The budget rises in steps; what smaller budgets connected prunes the later walks,
    so that a dense cluster costs far less than its pairs.
    """
    lt = Trie(np.unique(left))
    rt = lt if right is None else Trie(np.unique(right))
    n = len(lt.fps)
    both = lt.fps if right is None else np.concatenate([lt.fps, rt.fps])
    comp = np.arange(len(both))
    if right is not None:  # a fingerprint lies in one block only, so no equal pairs here
        off = n
    else:
        off = 0
    for step in sorted({min(1, budget), min(2, budget), budget}):
        for i, j in _join(lt, rt, right is None, step, comp):
            comp = union_labels(len(both), i, j + off, comp)
    tied = np.flatnonzero(comp != np.arange(len(both)))
    return both[tied], both[comp[tied]]


def trie_links(fps: DataFrame, budget: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct fingerprints ``fp`` within ``budget`` bits.

    The result is a union of spanning forests, one per block pair: it has the
    components of all links, in at most one row per fingerprint and task.
    """
    spark = fps.sparkSession
    total = max(1, fps.count())
    bits = min(16, max(4, math.ceil(math.log2(total / block_rows))))
    prefix = F.shiftrightunsigned("fp", 64 - bits).cast("int")
    held = {r["p"]: r["n"] for r in fps.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = np.array(sorted(held), np.int64)  # at most 2 ** 16 block names
    subs = np.array([-(-held[p] // block_rows) for p in names.tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(subs)])

    def deal(batches):
        near = {}
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            at = np.searchsorted(names, (fp >> np.uint64(64 - bits)).astype(np.int64))
            mixed = fp * np.uint64(0x9E3779B97F4A7C15)
            own = base[at] + (mixed >> np.uint64(40)).astype(np.int64) % subs[at]
            for k in np.unique(at).tolist():
                if k not in near:
                    hit = np.flatnonzero(np.bitwise_count((names ^ names[k]).astype(np.uint64)) <= budget)
                    near[k] = np.concatenate([np.arange(base[h], base[h + 1]) for h in hit])
                rows, other = np.flatnonzero(at == k), near[k]
                step = max(1, (1 << 20) // len(other))
                for s in range(0, len(rows), step):
                    r = rows[s : s + step]
                    x, y = np.repeat(own[r], len(other)), np.tile(other, len(r))
                    yield pa.record_batch(
                        [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(x > y), pa.array(np.repeat(fp[r].view(np.int64), len(other)))],
                        names=["a", "b", "right", "fp"],
                    )

    def join(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        right = rows["right"].to_numpy()
        if key[0] == key[1]:
            u, v = linked(fp, None, budget)
        elif right.all() or not right.any():
            u = v = fp[:0]
        else:
            u, v = linked(fp[~right], fp[right], budget)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "a bigint, b bigint, right boolean, fp bigint")
    return dealt.repartition(partitions(spark), "a", "b").groupBy("a", "b").applyInPandas(join, "u bigint, v bigint")


def simhash_near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(id_col, fingerprint, component_id, group_fp)`` for every row of ``docs``.

    ``fingerprint``: 16 hex digits; ``component_id``: the smallest id reachable over
    fingerprints that differ in at most ``max_bits`` bits, the row's own included;
    ``group_fp``: the component's smallest fingerprint, set for null ids too.
    """
    fps, _ = spool(fingerprints(docs, id_col, text_col, shingle), "fps")
    classes, classes_path = spool(fps.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    links, links_path = spool(trie_links(classes.select("fp"), max_bits), "links")
    comp = components(links)
    rooted = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted, _ = spool(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = spool(rooted.join(first, "root").select("fp", "root", "component_id"), "named")
    for p in (classes_path, links_path):
        discard(docs.sparkSession, p)
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("root").alias("group_fp"),
    )
