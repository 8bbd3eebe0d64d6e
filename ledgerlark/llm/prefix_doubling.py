"""Repeated-passage removal by distributed prefix doubling.

Removes every byte covered by a ``length``-byte string that also starts in a document
with a smaller id.  Names of strings grow by doubling: the name of ``2h`` bytes at a
position is the pair of the names of ``h`` bytes there and ``h`` further on.  Spark
sorts positions by such pairs at growing lengths; positions whose name occurs in one
document alone leave, equal names keep their smallest document, and the rest goes on
until the length is past the threshold:

1. *Anchors.*  In every ``length``-byte window the position with the smallest name of
   ``ANCHOR`` bytes is the window's anchor, so equal windows have equal anchors at
   equal offsets.  Only anchors are sorted (about one position in fourteen), by the
   pair (name of the anchor, name of the stretch that its windows cover).  An anchor
   name found in one document ends there.  In a group of equal stretches all windows
   are equal, so the documents after the smallest are covered whole.
2. *Windows.*  Where one anchor name has several stretches, each stretch's smallest
   document goes on window by window: Spark sorts the pairs (name of 32 bytes, name of
   32 bytes at the window's end) and every document but the smallest is covered.

Each task first sorts what it read itself and passes on one document per stretch or
window, so a passage in a third of all documents sends one row per task.  Anchor names
that are very common in a hashed sample of documents are dealt by the pair instead of
by the name; the sample only steers where rows go, never which rows there are.

Edge cases: null text counts as empty; texts shorter than ``length`` keep all bytes;
rows with a null id neither remove nor lose anything; a document is a pair of id and
text, so rows that repeat whole get the same result each, and rows that share an id
but not the text don't remove each other's bytes; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, spool

#: Bytes of an anchor name.
ANCHOR = 24
#: Bytes of text that a task sorts at once before it passes rows on.
CHUNK_BYTES = 16 << 20
#: Longer texts are named piece by piece (anchors depend on their window alone).
PIECE = 4 << 20
#: Rows in one Arrow batch.
BATCH_ROWS = 1 << 17
#: One document in so many, by hash, is looked at for very common anchor names.
HOT_SAMPLE = 64
#: A name with so many stretches in the sample is dealt by (name, stretch).
HOT_STRETCHES = 64

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POS = np.uint64((1 << 28) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair (a, b)."""
    h = (a ^ (b * _MUL2 + (b >> np.uint64(31)))) * _MUL
    h ^= h >> np.uint64(29)
    h *= _MUL2
    return h ^ (h >> np.uint64(32))


def _names(data: bytes) -> np.ndarray:
    """Names of 8 bytes at every position: the bytes themselves."""
    raw = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()


def doubled(data: bytes, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of all positions at the given lengths, grown from 8 bytes by pairing.

    A length between two powers pairs the name at the position with the name that ends
    where the string ends, as the last step of prefix doubling does.
    """
    h, cur, out = 8, _names(data), {}
    for want in sorted(lengths):
        while h * 2 <= want:
            cur, h = _mix(cur[:-h], cur[h:]), h * 2
        out[want] = cur if h == want else _mix(cur[: len(cur) - (want - h)], cur[want - h :])
    return out


def _spans_union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def anchors(data: bytes, length: int, anchor: int = ANCHOR):
    """``(name, stretch, start, windows)`` of a text's anchors in order.

    The windows of an anchor start at ``start .. start + windows - 1``; ``stretch``
    names the text they cover together with the anchor's place in it.
    """
    names = doubled(data, (anchor, 32))
    name, n32 = names[anchor], names[32]
    # the position's last bits make equal names within a window go to the leftmost
    pos = np.arange(len(name), dtype=np.uint64)
    low = (_mix(name, name) & ~_POS) | pos
    width, done = length - anchor + 1, 1
    while done * 2 <= width:
        low, done = np.minimum(low[:-done], low[done:]), done * 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    at = (low & _POS).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, len(at)))
    place, end = at[first], first + count - 1 + length
    # stretch: 32 bytes from its start, 32 at the middle cut, 32 to its end; it has at
    # most 2 * length - anchor bytes, so three names cover it
    mid = np.minimum(first + 32, end - 32)
    stretch = _mix(_mix(n32[first], n32[mid]), _mix(n32[end - 32], ((place - first) * 256 + count).astype(np.uint64)))
    return name[place], stretch, first, count


def text_anchors(data: bytes, length: int):
    """:func:`anchors` of a text of any length.

    A piece's end may cut a stretch in two; such stretches differ from whole ones under
    the same anchor name, so their windows are compared one by one.
    """
    if len(data) <= PIECE + length:
        return anchors(data, length)
    parts = []
    for at in range(0, len(data) - length + 1, PIECE):
        name, stretch, first, count = anchors(data[at : at + PIECE + length - 1], length)
        parts.append((name, stretch, first + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _chunks(batches, length: int):
    """``(ids, keys, texts)`` of documents long enough, in chunks of CHUNK_BYTES."""
    ids, keys, texts, size = [], [], [], 0
    for b in batches:
        for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            if i is None or len(data) < length:
                continue
            ids.append(i), keys.append(k), texts.append(data)
            size += len(data)
            if size >= CHUNK_BYTES:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _first_docs(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the rows whose document is the smallest with their pair (a, b)."""
    o = np.lexsort((doc, b, a))
    a, b = a[o], b[o]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    low = doc[o][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(o), bool)
    out[o] = doc[o] == low
    return out


_ROW = "route long, name long, pair long, id long, tkey long, start int, windows int"
_SPAN = "id long, tkey long, start int, windows int, open boolean"


def _rows(cols: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in cols.values()], names=list(cols))


def _sliced(run):
    """The same task with its batches cut to BATCH_ROWS rows."""

    def cut(batches):
        for b in run(batches):
            for at in range(0, b.num_rows, BATCH_ROWS):
                yield b.slice(at, BATCH_ROWS)

    return cut


def _merged(ids, keys, start, windows, length):
    """Spans of one task as (id, tkey, start, windows) with touching ones merged."""
    if not len(ids):
        return ids, keys, start, windows
    o = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[o], keys[o], start[o], (start + windows)[o]
    apart = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] > end[:-1]))
    first = np.flatnonzero(apart)
    stop = np.maximum.reduceat(end, first)
    return ids[first], keys[first], start[first], stop - start[first]


def _anchor_rows(length: int, hot: np.ndarray):
    """Task: documents to anchor rows; ``windows < 0`` marks spans already decided."""

    def run(batches):
        for ids, keys, texts in _chunks(batches, length):
            parts = [text_anchors(t, length) for t in texts]
            n = [len(p[0]) for p in parts]
            name, pair, start, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
            doc, key = np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(keys, np.int64), n)
            keep = _first_docs(name, pair, doc)
            route = np.where(np.isin(name, hot), _mix(name, pair), name) if len(hot) else name
            yield _rows({
                "route": route[keep].view(np.int64), "name": name[keep].view(np.int64), "pair": pair[keep].view(np.int64),
                "id": doc[keep], "tkey": key[keep], "start": start[keep].astype(np.int32), "windows": count[keep].astype(np.int32),
            })
            i, k, s, w = _merged(doc[~keep], key[~keep], start[~keep], count[~keep], length)
            r = _mix(i.view(np.uint64), s.astype(np.uint64)).view(np.int64)
            yield _rows({"route": r, "name": r, "pair": r, "id": i, "tkey": k, "start": s.astype(np.int32), "windows": (-w).astype(np.int32)})

    return run


#: Rows of one anchor name held back at the end of a batch, at most.
HOLD_ROWS = 1 << 18


def _decide_anchors(hot: np.ndarray):
    """Task: rows sorted by (name, pair, id) to decided spans and open stretches."""

    def decide(name, pair, doc, rest, prev, more):
        """Rows of whole name groups; ``prev``: (name, pair, id) of a group's start
        that went out before; ``more``: the last group goes on, so count it as shared."""
        new_n = np.append(True, name[1:] != name[:-1])
        new_p = new_n | np.append(True, pair[1:] != pair[:-1])
        low = doc[np.flatnonzero(new_p)][np.cumsum(new_p) - 1]
        group = np.cumsum(new_n) - 1
        top = np.flatnonzero(new_n)
        stretches = np.add.reduceat(new_p.astype(np.int64), top)
        shared = (stretches > 1) & (np.minimum.reduceat(doc, top) != np.maximum.reduceat(doc, top))
        if more:
            shared[-1] = True
        if prev is not None and prev[0] == name[0]:
            shared[0] = True
            if prev[1] == pair[0]:
                same = (group == 0) & (pair == pair[0])
                low = np.where(same, np.minimum(low, prev[2]), low)
        shared |= np.isin(name[top].view(np.uint64), hot)
        covered = doc > low
        out = covered | shared[group]
        key, start, windows = (r[out] for r in rest)
        return _rows({"id": doc[out], "tkey": key, "start": start, "windows": windows, "open": ~covered[out]}), (name[-1], pair[-1], low[-1])

    def run(batches):
        held, prev = None, None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(1, 7)]
            done = cols[5] < 0
            if done.any():
                i, k, s, w = _merged(cols[2][done], cols[3][done], cols[4][done], -cols[5][done], 0)
                yield _rows({"id": i, "tkey": k, "start": s.astype(np.int32), "windows": w.astype(np.int32), "open": np.zeros(len(i), bool)})
                cols = [c[~done] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            more = len(cols[0]) - last > HOLD_ROWS
            cut = len(cols[0]) if more else last
            if cut:
                out, prev = decide(*(c[:cut] for c in cols[:3]), [c[:cut] for c in cols[3:]], prev, more)
                yield out
            held = None if more else [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield decide(*held[:3], held[3:], prev, False)[0]

    return run


def _window_rows(length: int):
    """Task: open stretches with their texts to rows of window names."""

    def run(batches):
        def flush(parts):
            n = [len(p[0]) for p in parts]
            doc, key = (np.repeat(np.array([p[k] for p in parts], np.int64), n) for k in (2, 3))
            a, b, pos = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 4))
            parts.clear()  # not held while the rows go out
            keep = _first_docs(a, b, doc)
            yield _rows({
                "name": a[keep].view(np.int64), "pair": b[keep].view(np.int64), "id": doc[keep], "tkey": key[keep],
                "start": pos[keep].astype(np.int32), "windows": np.ones(int(keep.sum()), np.int32),
            })
            i, k, s, w = _merged(doc[~keep], key[~keep], pos[~keep].astype(np.int64), np.ones(int((~keep).sum()), np.int64), length)
            r = _mix(i.view(np.uint64), s.astype(np.uint64)).view(np.int64)
            yield _rows({"name": r, "pair": r, "id": i, "tkey": k, "start": s.astype(np.int32), "windows": (-w).astype(np.int32)})

        parts, size = [], 0
        for batch in batches:
            for i, k, t, starts, counts in zip(*(batch.column(c) for c in range(5)), strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                s, c = np.array(starts.values, np.int64), np.array(counts.values, np.int64)
                every = np.unique(np.repeat(s - np.cumsum(c) + c, c) + np.arange(c.sum()))
                for at in range(0, len(data), PIECE):
                    pos = every[slice(*np.searchsorted(every, (at, at + PIECE)))] - at
                    if not len(pos):
                        continue
                    n32 = doubled(data[at : at + PIECE + length], (32,))[32]
                    parts.append((n32[pos], n32[pos + length - 32], i.as_py(), k.as_py(), (pos + at).astype(np.int32)))
                    size += len(pos)
                    if size >= CHUNK_BYTES // 8:
                        yield from flush(parts)
                        parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _decide_windows():
    """Task: rows sorted by (name, pair, id) to the spans that are covered."""

    def run(batches):
        prev = None
        for b in batches:
            if not b.num_rows:
                continue
            name, pair, doc, key, start, windows = (b.column(k).to_numpy() for k in range(6))
            new = np.append(True, (name[1:] != name[:-1]) | (pair[1:] != pair[:-1]))
            low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if prev is not None and (prev[0], prev[1]) == (name[0], pair[0]):
                low = np.where(np.cumsum(new) == 1, prev[2], low)
            prev = (name[-1], pair[-1], low[-1])
            out = (doc > low) | (windows < 0)
            i, k, s, w = _merged(doc[out], key[out], start[out].astype(np.int64), np.abs(windows[out]).astype(np.int64), 0)
            yield _rows({"id": i, "tkey": k, "start": s.astype(np.int32), "windows": w.astype(np.int32)})

    return run


def _hot_names(docs: DataFrame, length: int) -> np.ndarray:
    """Anchor names with many stretches among one document in HOT_SAMPLE."""

    def run(batches):
        for ids, _, texts in _chunks(batches, length):
            name, pair, *_ = (np.concatenate(x) for x in zip(*(text_anchors(t, length) for t in texts), strict=True))
            both = np.unique(np.stack([name, pair], 1), axis=0)
            names, n = np.unique(both[:, 0], return_counts=True)
            yield _rows({"name": names[n > 1].view(np.int64), "n": n[n > 1]})

    seen = docs.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(run, "name long, n long")
    top = seen.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_STRETCHES)
    return np.array([r["name"] for r in top.orderBy(F.desc("n")).limit(1 << 14).collect()], np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tkey, start, windows)``: windows that a smaller document has too.

    ``tkey`` is ``xxhash64`` of the text; the windows start at ``start`` and the
    ``windows - 1`` positions after it; each covers ``length`` bytes.  Spans of
    one document may touch or overlap.
    """
    if not 40 <= length <= 60:
        raise ValueError("length must be 40 to 60 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    hot = _hot_names(src, length)
    rows = src.mapInArrow(_sliced(_anchor_rows(length, hot)), _ROW)
    dealt = rows.repartition(n, "route").sortWithinPartitions("name", "pair", "id", "start")
    first, first_path = spool(dealt.mapInArrow(_decide_anchors(hot), _SPAN), "anchors")
    open_ = (
        first.where("open")
        .groupBy("id", "tkey")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    )
    texts = src.join(open_, ["id", "tkey"]).select("id", "tkey", "text", "starts", "counts")
    windows = texts.mapInArrow(_sliced(_window_rows(length)), "name long, pair long, id long, tkey long, start int, windows int")
    sorted_ = windows.repartition(n, "name", "pair").sortWithinPartitions("name", "pair", "id", "start")
    second, _ = spool(sorted_.mapInArrow(_decide_windows(), "id long, tkey long, start int, windows int"), "windows")
    return first.where("not open").drop("open").unionByName(second)


def _cut(length: int):
    def run(batches):
        for b in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for t, starts, counts in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                kept, gone, runs = data, 0, 0
                if starts.is_valid and len(starts.values):
                    s = np.array(starts.values, np.int64)
                    s, e = _spans_union(s, s + np.array(counts.values, np.int64) - 1 + length)
                    runs, gone = len(s), int((e - s).sum())
                    cuts = np.append(0, np.stack([s, e], 1).ravel()).tolist() + [len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                out["n_bytes"].append(len(data)), out["n_removed"].append(gone), out["n_spans"].append(runs)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            cols = {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}
            yield pa.record_batch([b.column(0), *cols.values()], names=["id", *cols])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``."""
    spans = repeated_spans(docs, length, id_col, text_col)
    gathered = spans.groupBy("id", "tkey").agg(
        F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    both = src.join(gathered, ["id", "tkey"], "left").select("id", "text", "starts", "counts")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return both.mapInArrow(_cut(length), schema).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the covered bytes cut from the text; other columns stay.

    Bytes of a character that a cut splits go as well; null texts stay null.
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    gathered = spans.groupBy("id", "tkey").agg(
        F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts")
    )

    def run(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, s, c in zip(texts, starts, counts, strict=True):
            if t is not None and s is not None:
                data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                s = np.array(s, np.int64)
                for x, y in zip(*_spans_union(s, s + np.array(c, np.int64) - 1 + length), strict=True):
                    parts.append(data[at:x])
                    at = y
                t = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "counts": pd.Series, "return": pd.Series}
    keyed = docs.select(
        F.struct(*(c for c in docs.columns if c != text_col)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text")
    )
    both = keyed.join(gathered, ["id", "tkey"], "left")
    # a filter on the result would otherwise move below it and cut every text twice
    cut = F.pandas_udf(run, "string").asNondeterministic()("text", "starts", "counts")
    return both.select(*(cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
