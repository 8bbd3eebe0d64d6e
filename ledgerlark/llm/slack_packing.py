"""Packing of tokenized documents by minimum bin slack.

Documents become token ids plus one end id; longer ones are cut into pieces of
``capacity`` tokens.  Packing looks at piece lengths alone: for one sequence at a time,
a subset-sum dynamic programme over the lengths still there (a bitset of reachable
sums, one shift and OR per length) finds the combination with the least slack that
holds the longest piece left; it is removed as often as the counts allow, which is
what removing it sequence by sequence would do.

What the programme sees is the histogram of lengths, at most ``capacity`` rows whatever
the input, and its plan has at most a few rows per length.  Spark tokenizes, counts,
numbers the pieces of every length (salted, so a length that a third of the pieces
share is spread over all tasks) and looks each piece's number up in the plan.

Edge cases: null text counts as empty and is the end id alone; repeated rows are packed
as often as they occur; null ids are kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import threading
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, spool

#: Words whose ids a Python worker remembers, at most.
CACHE_WORDS = 350_000
#: Runs of letters or punctuation that it remembers, about.
CACHE_RUNS = 600_000

#: Characters of text that are split at once.
GROUP_CHARS = 1 << 18
#: Latin letters that stand alone in NFC, and ASCII punctuation without the apostrophe.
_LATIN, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: The letters, the signs after them and the rest of a word, for words that end in a line end.
_PARTS = re.compile(f"([{_LATIN}]*)([{_SIGNS}]*)(.*)\n").findall

#: Seconds for which a Python worker keeps its words after a task, for the next one.
KEEP_SECONDS = 3.0

_TOKENIZERS: dict = {}
_RELEASE: list[threading.Timer] = []


class RunIds(dict):
    """Token ids by run of Latin letters in lower case or of ASCII signs, merged when first asked for."""

    def __init__(self, model):
        from tokenizers import pre_tokenizers

        super().__init__({"": b""})
        self.merge = model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin = {i: as_bytes(chr(i))[0][0] for i in range(0xC0, 0x100)}

    def __missing__(self, run: str) -> bytes:
        found = self.merge(run if run.isascii() else run.translate(self.latin))
        ids = self[run] = array("I", [t.id for t in found]).tobytes()
        return ids


class WordIds:
    """Token ids of texts, remembered by blank-separated word.

    For tokenizers of the kind of ``word_bpe_49k.json``: lower case, white space
    separates words and is dropped, letters and other signs are split and merged apart.
    Blanks and line ends split here.  A word of Latin letters and then ASCII signs is
    its letters in lower case, then its signs; those go to the tokenizer's merges one by
    one, without its normalizer and splitter.  Every other word goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.runs = RunIds(self.whole.model)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {"": b""}
        if len(self.runs) > CACHE_RUNS:
            self.runs = RunIds(self.whole.model)
        known, runs, mixed, odd = self.known, self.runs, [], []
        for w in words:
            if w.isascii() and w.isalpha():
                low = w.lower()  # most words are so already: one string for both memories
                known[w] = runs[w if low == w else low]
            else:
                mixed.append(w)
        for w, (run, signs, rest) in zip(mixed, _PARTS("\n".join([*mixed, ""])), strict=True):
            if rest:
                odd.append(w)
            else:
                known[w] = runs[run.lower()] + runs[signs] if signs else runs[run.lower()]
        for at in range(0, len(odd), 2048):
            got = self.whole.encode_batch_fast(odd[at : at + 2048], add_special_tokens=False)
            known.update(zip(odd[at : at + 2048], (np.array(e.ids, "<u4").tobytes() for e in got), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # lower case first, as the normalizer would, where that can't touch anything else
        lower = (t if "<|" in t or "Σ" in t or "İ" in t else t.lower() for t in texts)
        split = [t.replace("\n", " ").split(" ") for t in lower]
        every = set(chain.from_iterable(split))
        if new := every.difference(self.known):
            self._learn(list(new if len(self.known) + len(new) <= CACHE_WORDS else every - {""}))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]


def _groups(texts: pa.Array):
    """Texts in lists of about GROUP_CHARS characters; null counts as empty."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    yield group


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer for a file; give it back with :func:`release`."""
    while _RELEASE:
        _RELEASE.pop().cancel()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def release() -> None:
    """Forget the words soon, so that a later stage's tasks in this worker have the memory."""
    timer = threading.Timer(KEEP_SECONDS, _TOKENIZERS.clear)
    timer.daemon = True
    _RELEASE.append(timer)
    timer.start()


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` per piece, and ``ids`` if asked for."""

    def run(batches):
        encode = word_ids(tokenizer)
        try:
            for b in batches:
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(chain.from_iterable(map(encode, _groups(b.column(1))))):
                    got = np.append(got, np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(got), capacity)):
                        part = got[s : s + capacity]
                        at.append(i), piece.append(p), start.append(s), length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                cols = {"id": b.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32())}
                cols |= {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc))}
                if with_ids:
                    cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.record_batch(list(cols.values()), names=list(cols))
        finally:
            release()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The combination ``[(length, n)]`` with the largest sum up to ``room``.

    ``order`` lists the lengths that have a count, longest first.  ``reach`` holds bit
    s if a sum of s can be made; a length's copies enter as 1, 2, 4, ... at a time.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        left = min(counts[length], room // length)
        n = 1
        while left > 0:
            take = min(n, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, n = left - take, n * 2
        if reach >> room:
            break
    best, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= take * length
            out[length] = out.get(length, 0) + take
    return list(out.items())


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first, per, times, sequence, offset)`` of the whole packing.

    Pieces ``first .. first + per * times - 1`` of a length go, ``per`` at a time, to
    sequences ``sequence .. sequence + times - 1``, one after the other from ``offset``.
    """
    counts = {k: n for k, n in histogram.items() if n}
    order = sorted(counts, reverse=True)
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while order:
        seed = order[0]
        counts[seed] -= 1
        combo = dict(fullest(counts, [x for x in order if counts[x] and x <= capacity - seed], capacity - seed))
        counts[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in combo.items())
        offset = 0
        for x, n in sorted(combo.items(), reverse=True):
            rows.append((x, used[x], n, times, sequence, offset))
            used[x] += n * times
            counts[x] -= n * times
            offset += n * x
        sequence += times
        order = [x for x in order if counts[x]]
    return rows


def _place(plan: list[tuple[int, int, int, int, int, int]]):
    """Task: adds the sequence and offset of every piece's number in its length."""
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    lengths, begins = np.unique(table[:, 0], return_index=True)
    begins = np.append(begins, len(table))

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                k = np.searchsorted(lengths, x)
                at = np.flatnonzero(length == x)
                lo, hi = begins[k], begins[k + 1]
                row[at] = lo + np.searchsorted(table[lo:hi, 1], rank[at], "right") - 1
            got = table[row]
            nth = rank - got[:, 1]
            sequence, offset = got[:, 4] + nth // got[:, 2], got[:, 5] + nth % got[:, 2] * length
            cols = [b.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces, _ = spool(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    # number the pieces of a length from 0: by salt, then by the salts' counts before
    salts = max(16, partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(7)), F.lit(salts)).cast("int"))
    held = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    held, _ = spool(held, "lengths")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = plan_sequences(histogram, capacity)
    before = held.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"),
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within.cast("long")).join(before, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("base")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan), schema).withColumnRenamed("id", id_col)
