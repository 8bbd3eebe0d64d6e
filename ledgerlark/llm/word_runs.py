"""Runs of periodically repeated words, found by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), at
least ``max(shortest, repeats * q)`` long, that no neighbouring word extends.

Words are appended one by one to a suffix automaton.  The nodes that end at the new word
are the path from its node to the root of the suffix links; each node's last occurrence
is the colour of its preferred path in a link-cut forest over those links.  Access to the
new node walks the path in segments of one colour and recolours it.  Where a segment's
longest string of ``L`` words ended ``q`` words ago, the last ``L + q`` words have period
``q``: the last occurrence being the nearest, ``q`` is smallest, and ``L`` being the common
suffix of both places, no word on the left extends it.  Each such square is a run's state
at this word; the last word at which it has the same start and period ends the run.

A run of ``max(shortest, repeats * q)`` words holds each of its ``GRAM``-word strings
twice at least, within itself.  So a text is first cut, exactly, into the stretches in
which every such string occurs twice; the automaton reads those that are long enough.
Stretches share no run, and no run leaves its stretch.

Edge cases: null text has no words, like an empty one or one of blanks, and no run; its
collapsed text is empty; null ids and repeated rows are kept as they are; of runs that
overlap each is reported; very long texts are read whole, in memory in proportion to
their longest stretch; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of the strings that must occur twice in a stretch; at most a third of the shortest run.
GRAM = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def squares(words: list[int], shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a sequence, by start, then period."""
    # automaton: node 1 is the root; link is a node's parent in the forest
    size = [0, 0]
    step: list[dict] = [{}, {}]
    link = [0, 0]
    # splay trees of the preferred paths, keyed by depth; the root's colour holds for its tree
    up, left, right, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def splay(x):
        """Makes ``x`` the root of its path's tree."""
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:
            z = up[y]
            on_left = left[y] == x
            # the tree's root has a parent that does not know it: the path's parent
            if not z or (left[z] != y and right[z] != y):
                if on_left:
                    c = left[y] = right[x]
                    right[x] = y
                else:
                    c = right[y] = left[x]
                    left[x] = y
                if c:
                    up[c] = y
                up[y], up[x] = x, z
                colour[x] = colour[y]
                return
            w = up[z]
            z_left = left[z] == y
            outer = not w or (left[w] != z and right[w] != z)
            if z_left == on_left:
                if on_left:
                    c, e = right[y], right[x]
                    left[z], right[y], left[y], right[x] = c, z, e, y
                else:
                    c, e = left[y], left[x]
                    right[z], left[y], right[y], left[x] = c, z, e, y
                if c:
                    up[c] = z
                if e:
                    up[e] = y
                up[z], up[y] = y, x
            else:
                if on_left:
                    c, e = left[x], right[x]
                    right[z], left[y], left[x], right[x] = c, e, z, y
                else:
                    c, e = right[x], left[x]
                    left[z], right[y], right[x], left[x] = c, e, z, y
                if c:
                    up[c] = z
                if e:
                    up[e] = y
                up[z] = up[y] = x
            up[x] = w
            if outer:
                colour[x] = colour[z]
                return
            if left[w] == z:
                left[w] = x
            else:
                right[w] = x
            y = w

    ends: dict = {}
    last = 1
    for i, word in enumerate(words):
        node = len(size)
        size.append(size[last] + 1)
        step.append({})
        p = last
        while p and word not in step[p]:
            step[p][word] = node
            p = link[p]
        parent = 1
        if p:
            q = step[p][word]
            if size[q] == size[p] + 1:
                parent = q
            else:
                parent = node + 1
                size.append(size[p] + 1)
                step.append(step[q].copy())
                while p and step[p].get(word) == q:
                    step[p][word] = parent
                    p = link[p]
        link.append(parent)
        up.append(parent)
        left.append(0)
        right.append(0)
        colour.append(-1)
        if parent > node:  # the copy comes between q and its parent, on q's path and of its colour
            link.append(link[q])
            link[q] = parent
            splay(q)
            above = left[q]
            left[q] = parent
            up.append(q)
            left.append(above)
            right.append(0)
            colour.append(-1)
            if above:
                up[above] = parent
        # access: segments of one colour, from the new node to the root
        x, below = parent, node
        while x:
            splay(x)
            before, longest = colour[x], size[x]
            period = i - before
            if before >= 0 and longest >= (repeats - 1) * period and longest + period >= shortest:
                ends[i - longest - period + 1, period] = i
            cut = right[x]
            if cut:
                colour[cut] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        last = node
    return [(s, e - s + 1, q) for (s, q), e in sorted(ends.items())]


def _twice(ids: np.ndarray, fewest: int) -> list[tuple[int, int]]:
    """Stretches of at least ``fewest`` words in which each string of ``GRAM`` words occurs twice."""
    work, out = [(0, len(ids))], []
    while work:
        low, high = work.pop()
        if high - low < fewest:
            continue
        key = np.zeros(high - low - GRAM + 1, np.uint64)
        for k in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[low + k : high - GRAM + 1 + k]
            key ^= key >> np.uint64(29)
        order = np.argsort(key)
        ranked = key[order]
        same = np.zeros(len(key) + 1, bool)
        np.equal(ranked[1:], ranked[:-1], out=same[1:-1])
        again = np.empty(len(key), bool)
        again[order] = same[1:] | same[:-1]
        if again.all():
            out.append((low, high))
            continue
        turns = np.flatnonzero(np.diff(np.concatenate(([False], again, [False]))))
        work += [(low + int(a), low + int(b) + GRAM - 1) for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return sorted(out)


def runs_of(words: list, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a list of words, by start, then period."""
    if len(words) < shortest:
        return []
    known: dict = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint64, len(words))
    if len(words) - len(known) < shortest - shortest // repeats:  # a run's words but one period are repeats
        return []
    found = []
    for low, high in _twice(ids, shortest):
        found += [(low + s, n, q) for s, n, q in squares(ids[low:high].tolist(), shortest, repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    gone = np.cumsum(drop) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, repeats: int = 3) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` per row.

    ``runs`` is an array of ``(start, length, period)`` in words, by start, then period;
    ``collapsed`` the words outside of runs and in each run's first period, with one
    space between.  Words are what ASCII white space separates.
    """
    if repeats < 3 or shortest < repeats * GRAM:
        raise ValueError(f"runs must have three periods and {GRAM} words for each of {repeats} at least")
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            begin = 0
            while begin < b.num_rows:
                count, found, kept, size = [], [], [], 0
                while begin + len(count) < b.num_rows and size < 1 << 22:
                    words = (texts[begin + len(count)].as_py() or b"").split()
                    runs = runs_of(words, shortest, repeats)
                    text = b" ".join(collapse(words, runs))
                    count.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(text)
                    size += len(text)
                whole = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                cols = [b.column(0).slice(begin, len(count)), pa.array(count, pa.int64()), pa.array(found, whole), pa.array(kept, pa.binary()).view(pa.string())]
                yield pa.record_batch(cols, names=["id", "n_words", "runs", "collapsed"])
                begin += len(count)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
