"""SentencePiece encoding and decoding with a unigram model.

Blanks become the marker U+2581 and one stands before the text.  Pieces with their log
scores sit in a double-array trie over UTF-8 bytes; a Viterbi pass over it finds the
segmentation with the largest sum of scores.  Characters that no piece covers score ten
below the lowest piece and are written as byte pieces.  Decoding joins the pieces,
turns byte pieces back into bytes and markers into blanks, and drops the first blank.

Where no piece has a marker after another character, no piece spans such a place, so
the best segmentation of a text is that of its words, each with its markers in front;
tasks segment every distinct word once and remember it.

Edge cases: null text gives no ids and decodes to null; empty text gives none and
decodes to empty; a literal U+2581 in a text comes back as a blank; byte pieces that
aren't UTF-8 decode to U+FFFD; rows are returned as often as they occur; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words whose ids a Python worker remembers, at most.
CACHE_WORDS = 600_000
#: Bytes of words that are segmented together, and from which on a word is taken alone.
TOGETHER, ALONE = 1 << 18, 512
#: Characters of text that are split at once.
GROUP_CHARS = 1 << 20
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


class DoubleArray:
    """Trie of byte strings in two arrays.

    The child of node ``n`` by byte ``c`` is ``base[n] + c`` if ``check`` there is
    ``n``; ``value[n]`` is the string that ends at ``n``, or -1.
    """

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        free, cursor = 257, 1  # no free place before the first; several children go after the second
        work = [(0, 0, len(order), 0)]
        self.check[0] = 0
        while work:
            node, lo, hi, depth = work.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                self.value[node] = order[lo]
                lo += 1
            if lo == hi:
                continue
            labels, cuts = [], []
            for k in range(lo, hi):
                c = keys[order[k]][depth]
                if not labels or labels[-1] != c:
                    labels.append(c)
                    cuts.append(k)
            cuts.append(hi)
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            at = free - labels[0] if len(labels) == 1 else cursor
            while True:
                if at + 256 >= len(self.check):
                    more = len(self.check)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[at + c] < 0 for c in labels):
                    break
                at += 1
            self.base[node] = at
            if len(labels) > 1:
                cursor = at
            for c in labels:
                self.check[at + c] = node
            work += [(at + c, cuts[i], cuts[i + 1], depth + 1) for i, c in enumerate(labels)]
        self.check[0] = -1  # no node leads to the root
        self.base += [0] * 256  # a step past the end finds no child
        self.check += [-1] * (256 + max(0, max(self.base) + 256 - len(self.check)))


class Pieces:
    """A vocabulary of pieces with log scores, from a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.names = [sp.id_to_piece(i) for i in ids]
        self.byte_ids = [0] * 256
        self.bytes_of = [b""] * len(self.names)
        plain = []
        for i in ids:
            if sp.is_byte(i):
                value = int(self.names[i][1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = self.names[i].encode()
                plain.append(i)
        self.plain = plain
        self.scores = [sp.get_score(i) for i in plain]
        self.unknown_score = min(self.scores, default=0.0) - 10.0
        self.trie = DoubleArray([self.names[i].encode() for i in plain])
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        #: Whether a text's words can be segmented one by one.
        self.by_word = not any(MARK in self.names[i].lstrip(MARK) for i in plain)
        self.first_byte, self.is_byte = min(self.byte_ids), np.zeros(len(self.names), bool)
        self.is_byte[self.byte_ids] = True
        self.known: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a marked text."""
        data = text.encode("utf-8", "surrogatepass")
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        plain, scores, unknown = self.plain, self.scores, self.unknown_score
        n = len(data)
        best = [float("-inf")] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, whole = best[at], 0, False
            for end in range(at, n):
                step = base[node] + data[end]
                if check[step] != node or (node == 0 and step == 0):
                    break
                node = step
                k = value[node]
                if k >= 0:
                    stop = end + 1
                    score = here + scores[k]
                    if score > best[stop]:
                        best[stop], back[stop], piece[stop] = score, at, plain[k]
                    if stop == at + width:
                        whole = True
            if not whole:
                stop = at + width
                if here + unknown > best[stop]:
                    best[stop], back[stop], piece[stop] = here + unknown, at, -1
            at += width
        out, at = [], n
        while at:
            if piece[at] < 0:
                out += [self.byte_ids[b] for b in reversed(data[back[at] : at])]
            else:
                out.append(piece[at])
            at = back[at]
        return out[::-1]

    def segment_all(self, words: list[str]) -> list[bytes]:
        """Ids of the best segmentation of each marked word, as little-endian 32-bit numbers.

        The trie is walked from all characters of all words at once; then the words' best
        scores are carried on together, byte by byte.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        first = np.repeat(ends - length, length)  # of each byte's word
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.select([data[starts] < 0x80, data[starts] < 0xE0, data[starts] < 0xF0], [1, 2, 3], 4)
        limit = np.repeat(ends, length)[starts]
        base, check, value = self.arrays
        plain, scores = np.array(self.plain, np.int32), np.array(self.scores)
        # edges: a piece from a character's first byte to the byte after its last
        begin, stop, piece = [], [], []
        at, node, whole = np.arange(len(starts)), np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
        depth = 0
        while len(at):
            at, node = (x[starts[at] + depth < limit[at]] for x in (at, node))
            step = base[node] + data[starts[at] + depth]
            here = check[step] == node
            at, node = at[here], step[here]
            depth += 1
            found = value[node] >= 0
            begin.append(starts[at[found]])
            stop.append(begin[-1] + depth)
            piece.append(value[node[found]])
            whole[at[found & (width[at] == depth)]] = True
        bare = np.flatnonzero(~whole)
        begin, stop = (np.concatenate([*x, y]) for x, y in ((begin, starts[bare]), (stop, starts[bare] + width[bare])))
        piece = np.concatenate([*piece, np.full(len(bare), -1)]).astype(np.int64)
        gain = np.where(piece < 0, self.unknown_score, scores[piece])
        # best[k]: of the bytes before k in k's word, with k = 0 for all words' starts
        offset = stop - first[begin]
        order = np.lexsort((begin, stop, offset))
        begin, stop, piece, gain, offset = (x[order] for x in (begin, stop, piece, gain, offset))
        best, back, chosen = np.zeros(len(data) + 1), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        fresh = begin == first[begin]
        cuts = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            total = np.where(fresh[lo:hi], 0.0, best[begin[lo:hi]]) + gain[lo:hi]
            heads = np.flatnonzero(np.append(True, stop[lo + 1 : hi] != stop[lo : hi - 1]))
            most = np.maximum.reduceat(total, heads)
            sizes = np.diff(np.append(heads, hi - lo))
            wins = np.flatnonzero(total == np.repeat(most, sizes))
            wins = lo + wins[np.append(True, stop[lo + wins[1:]] != stop[lo + wins[:-1]])]  # the longest of equals
            best[stop[wins]], back[stop[wins]], chosen[stop[wins]] = most, begin[wins], piece[wins]
        on_path = np.zeros(len(data) + 1, bool)
        at = ends[length > 0]
        while len(at):
            on_path[at] = True
            at = back[at]
            at = at[at != first[at]]
        stops = np.flatnonzero(on_path)
        known = chosen[stops] >= 0
        count = np.where(known, 1, stops - back[stops])
        place = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), "<i4")
        ids[place[known]] = plain[chosen[stops[known]]]
        odd = np.flatnonzero(~known)
        if len(odd):
            inner = np.arange(int(count[odd].sum())) - np.repeat(np.cumsum(count[odd]) - count[odd], count[odd])
            ids[np.repeat(place[odd], count[odd]) + inner] = np.array(self.byte_ids)[data[np.repeat(back[stops[odd]], count[odd]) + inner]]
        flat = ids.tobytes()
        upto = np.append(0, np.cumsum(count))[np.searchsorted(stops, ends, "right")] * 4
        return [flat[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def _learn(self, words) -> None:
        """Segments words and remembers them: short ones many at a time."""
        group, size = [], 0
        for w in words:
            if len(w) >= ALONE:
                self.known[w] = np.array(self.segment(w), "<i4").tobytes()
                continue
            group.append(w)
            size += len(w)
            if size >= TOGETHER:
                self.known.update(zip(group, self.segment_all(group), strict=True))
                group, size = [], 0
        if group:
            self.known.update(zip(group, self.segment_all(group), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = []
        for t in texts:
            marked = MARK + t.replace(" ", MARK) if t else ""
            split.append(_WORD(marked) if self.by_word else [marked] if t else [])
        every = set(chain.from_iterable(split))
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, every
        self._learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        """Text of a sequence of ids."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        text = data.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """This worker's vocabulary for a file."""
    return Pieces(path)


def _groups(texts: pa.Array):
    group, size = [], 0
    for t in texts:
        group.append(t.as_py())
        size += len(group[-1] or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` per row; ``ids`` is null where the text is."""

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            begin = 0
            for group in _groups(b.column(1)):
                ids = [None if t is None else x for t, x in zip(group, vocabulary.encode([t or "" for t in group]), strict=True)]
                yield pa.record_batch([b.column(0).slice(begin, len(group)), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                begin += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` per row of ids; null ids decode to null."""

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            texts = [None if not x.is_valid else vocabulary.decode(x.values.to_pylist()) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_ids, n_byte_ids, ids_crc32, same_text)``: encoded and decoded again."""

    def run(batches):
        vocabulary = pieces(model)
        for b in batches:
            begin = 0
            for group in _groups(b.column(1)):
                coded = vocabulary.encode([t or "" for t in group])
                same = [t is None or vocabulary.decode(x.tolist()) == t for t, x in zip(group, coded, strict=True)]
                cols = [[len(x) for x in coded], [int(vocabulary.is_byte[x].sum()) for x in coded], [zlib.crc32(x.tobytes()) for x in coded]]
                yield pa.record_batch(
                    [b.column(0).slice(begin, len(group)), *(pa.array(c, pa.int64()) for c in cols), pa.array(same)],
                    names=["id", "n_ids", "n_byte_ids", "ids_crc32", "same_text"],
                )
                begin += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, same_text boolean").withColumnRenamed("id", id_col)
