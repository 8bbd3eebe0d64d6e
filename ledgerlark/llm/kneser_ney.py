"""Perplexity under an interpolated modified Kneser-Ney bigram model.

Spark counts words and word pairs; the model is kept as sorted arrays of word hashes
and pair keys in the shared folder, and the workers that score map them into memory.

* *words*: sorted 63-bit hashes of the training words, their counts, and their
  continuation counts (in how many distinct contexts a word occurs).  A word's id is its
  place in the array.
* *pairs*: sorted keys ``context id << 32 | word id`` with counts, and for each context
  its total and how many of its words occur once, twice, more often.

Three discounts for counts 1, 2, 3 and more come from the counts of counts, for pairs
and for continuation counts; what they take away goes to the lower order, in the end to
all words and one unknown word alike.  A text is its words, then one end; the first
word's context is a begin mark, which itself is never scored.

Arrays are cut into shards by hash of the context.  A context that makes up more than
an eighth of a shard's share of all tokens is dealt by hash of the pair, and its totals
go into one small array (at most eight contexts a shard).

Edge cases: null text counts as empty (one end); texts of any length are read in whole;
without training texts all words are unknown and equally likely; repeated rows count
and are returned as often as they occur; rows with a null id are given to
``taught`` like any other; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from functools import cached_property, lru_cache
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, register, shared_path, spool

#: Bytes of text that a task counts or scores at once.
CHUNK_BYTES = 4 << 20
#: Shards of a model, at most: a worker that scores maps seven arrays of each, and Linux
#: allows a process 65 530 maps by default.
MAX_SHARDS = 8192
#: Names no word can have, as they hold a blank.
END, BEGIN = b" end", b" begin"
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- arrays on shared storage


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def store(uri: str, values: np.ndarray) -> None:
    """Write an array whole: a task that runs twice leaves one good file."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid4().hex}"
        with open(draft, "wb") as out:
            np.save(out, values)
        os.replace(draft, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid4().hex}"
    with system.open_output_stream(draft) as out:
        np.save(out, values)
    system.move(draft, path)


def mapped(uri: str) -> np.ndarray:
    """An array mapped into memory; from a remote store by way of an unlinked file."""
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy, system.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


# ---------------------------------------------------------------- texts to word hashes


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _chunks(batches):
    """``(rows, lengths, hashes)``: batches of texts as word hashes with an end each.

    ``rows`` are the record batches' slices the texts come from.
    """
    digest = xxhash.xxh64_intdigest
    for b in batches:
        begin, words, lengths, size = 0, [], [], 0
        for i, t in enumerate(b.column(0)):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            split = data.lower().split()
            split.append(END)
            words += [digest(w) for w in split]
            lengths.append(len(split))
            size += len(data)
            if size >= CHUNK_BYTES or i == b.num_rows - 1:
                yield b.slice(begin, len(lengths)), np.array(lengths), np.array(words, np.uint64) >> np.uint64(1)
                begin, words, lengths, size = i + 1, [], [], 0


def _spread(keys: np.ndarray, shards: int) -> np.ndarray:
    h = keys.astype(np.uint64) * _MUL
    return ((h ^ (h >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that are not arrays."""

    path: str
    shards: int
    offsets: tuple[int, ...]  # a word shard's first id; the number of words at the end
    tokens: int
    hot: tuple[tuple[int, int, int, int, int], ...]  # context, total, ones, twos, more
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    continuations: int = 0
    word_gamma: float = 1.0
    pair_shards: tuple[int, ...] = ()  # those whose pair arrays were written; a word shard's size tells

    @property
    def distinct(self) -> int:
        return self.offsets[-1]

    @property
    def unknown(self) -> int:
        return self.distinct

    @property
    def begin(self) -> int:
        return self.distinct + 1

    @cached_property
    def hot_contexts(self) -> np.ndarray:
        return np.array(sorted(h[0] for h in self.hot), np.int64)

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        """Shards hold ranges of hashes, so ids follow the hashes' order."""
        return ((hashes >> np.uint64(31)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes; ``unknown`` for others."""
        each, where = np.unique(hashes, return_inverse=True)
        ids = np.full(len(each), self.unknown, np.int64)
        cuts = np.searchsorted(self.word_shard(each), np.arange(self.shards + 1))
        for s in range(self.shards):
            if cuts[s] < cuts[s + 1] and self.offsets[s] < self.offsets[s + 1]:
                part, known = each[cuts[s] : cuts[s + 1]], _array(self.path, "words", s)
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                ids[cuts[s] : cuts[s + 1]] = np.where(known[at] == part, self.offsets[s] + at, self.unknown)
        return ids[where]

    def of_words(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array that goes along with the words; 0 for the unknown."""
        out = np.zeros(len(ids), np.int64)
        for s, at in _groups(np.searchsorted(self.offsets, ids, "right") - 1):
            if s < self.shards:
                out[at] = _array(self.path, kind, s)[ids[at] - self.offsets[s]]
        return out

    def pair_shard(self, context: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot_contexts):
            return _spread(context, self.shards)
        return np.where(np.isin(context, self.hot_contexts), _spread(keys, self.shards), _spread(context, self.shards))

    def word_prob(self, ids: np.ndarray) -> np.ndarray:
        """Lower order: continuation counts, then all words and one unknown alike."""
        even = self.word_gamma / (self.distinct + 1)
        if not self.continuations:
            return np.full(len(ids), even)
        return discounted(self.of_words("continuations", ids), self.word_discounts) / self.continuations + even

    def of_pairs(self, kind: str, shard: int) -> np.ndarray:
        """An array of a pair shard; empty if nothing went there."""
        if shard in self.pair_shards:
            return _array(self.path, kind, shard)
        return np.zeros((0, 4) if kind == "context_counts" else 0, np.int64)

    def pair_prob(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of each word after its context."""
        low = self.word_prob(word)
        out = low.copy()  # contexts never seen have the lower order's
        keys = context << 32 | word
        shard = self.pair_shard(context, keys)
        hot = np.array(sorted(self.hot), np.int64).reshape(-1, 5)
        discounts = np.array(self.pair_discounts)
        for s, at in _groups(shard):
            count, stats = np.zeros(len(at), np.int64), np.zeros((len(at), 4), np.int64)
            known = self.of_pairs("pairs", s)
            if len(known):
                k = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                count = np.where(known[k] == keys[at], self.of_pairs("pair_counts", s)[k], 0)
            for contexts, of in ((self.of_pairs("contexts", s), self.of_pairs("context_counts", s)), (hot[:, 0], hot[:, 1:])):
                if len(contexts):
                    k = np.minimum(np.searchsorted(contexts, context[at]), len(contexts) - 1)
                    stats = np.where((contexts[k] == context[at])[:, None], of[k], stats)
            seen = stats[:, 0] > 0
            total = np.maximum(stats[:, 0], 1)
            gamma = stats[:, 1:] @ discounts / total
            out[at] = np.where(seen, discounted(count, self.pair_discounts) / total + gamma * low[at], low[at])
        return out


def _groups(names: np.ndarray):
    """``(name, places)`` of equal names."""
    order = np.argsort(names, kind="stable")
    cuts = np.flatnonzero(np.diff(names[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(names[at[0]]), at


def discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3)], 0)


def modified_discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts 1, 2, 3 and more from how many counts are 1, 2, 3, 4.

    Half the count where the estimate is missing or out of its range (tiny inputs), as
    a discount of nothing would leave unknown words without probability.
    """
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d <= k else k / 2 for k, d in enumerate(found, 1))


@lru_cache(maxsize=1 << 16)
def _array(path: str, kind: str, shard: int) -> np.ndarray:
    """A shard's array, mapped once in a worker; a file that is missing is an error."""
    return mapped(f"{path}/{kind}-{shard:05d}.npy")


# ---------------------------------------------------------------- training


def _count_words(batches):
    for _, _, hashes in _chunks(batches):
        word, n = np.unique(hashes, return_counts=True)
        for at in range(0, len(word), 1 << 17):
            yield pa.record_batch([pa.array(word[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["h", "n"])


def _summed(batches) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows of (key, n) with equal keys added up."""
    parts = [(b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
    key, n = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(2))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _store_words(path: str):
    def run(key, batches):
        shard = key[0].as_py()
        word, n = _summed(batches)
        store(f"{path}/words-{shard:05d}.npy", word.view(np.uint64))
        store(f"{path}/counts-{shard:05d}.npy", n)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(word)]), pa.array([int(n.sum())])], names=["shard", "words", "tokens"])

    return run


def _pairs_of(model: Model, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and word ids of a chunk's tokens."""
    word = model.word_ids(hashes)
    context = np.append(model.begin, word[:-1])
    context[np.cumsum(lengths)[:-1]] = model.begin
    return context, word


def _count_pairs(model: Model):
    def run(batches):
        for _, lengths, hashes in _chunks(batches):
            context, word = _pairs_of(model, lengths, hashes)
            keys, n = np.unique(context << 32 | word, return_counts=True)
            shard = model.pair_shard(keys >> 32, keys).astype(np.int32)
            for at in range(0, len(keys), 1 << 17):
                s = slice(at, at + (1 << 17))
                yield pa.record_batch([pa.array(shard[s]), pa.array(keys[s]), pa.array(n[s])], names=["shard", "key", "n"])

    return run


def _store_pairs(model: Model):
    """Task: one shard's arrays; returns what has to be added up over shards."""

    def run(key, batches):
        shard = key[0].as_py()
        keys, n = _summed(batches)
        store(f"{model.path}/pairs-{shard:05d}.npy", keys)
        store(f"{model.path}/pair_counts-{shard:05d}.npy", n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n)
        context = keys >> 32
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        each = context[first]
        stats = np.stack([np.add.reduceat(x, first) for x in (n, n == 1, n == 2, n > 2)], 1).astype(np.int64)
        hot = np.isin(each, model.hot_contexts)
        store(f"{model.path}/contexts-{shard:05d}.npy", each[~hot])
        store(f"{model.path}/context_counts-{shard:05d}.npy", stats[~hot])
        word, k = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        of = np.bincount(np.minimum(n, 5), minlength=5)[1:5]
        for at in range(0, len(word), 1 << 17):
            s = slice(at, at + (1 << 17))
            place, zero = np.searchsorted(model.offsets, word[s], "right") - 1, np.zeros(len(word[s]), np.int64)
            yield _stat(np.zeros(len(word[s]), np.int32), word[s], k[s], place, zero, zero)
        yield _stat(np.ones(int(hot.sum()), np.int32), each[hot], *(stats[hot][:, c] for c in range(4)))
        yield _stat(np.full(1, 2, np.int32), np.full(1, shard, np.int64), *(of[c : c + 1] for c in range(4)))

    return run


def _stat(*cols) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in cols], names=["kind", "id", "a", "b", "c", "d"])


def _store_continuations(model: Model):
    def run(key, batches):
        shard = key[0].as_py()
        word, n = _summed(batches)
        out = np.zeros(model.offsets[shard + 1] - model.offsets[shard], np.int64)
        out[word - model.offsets[shard]] = n
        store(f"{model.path}/continuations-{shard:05d}.npy", out)
        of = np.bincount(np.minimum(n, 5), minlength=6)
        yield pa.record_batch([pa.array([int(x)]) for x in (n.sum(), *of[1:5], (n > 2).sum())], names=["total", "n1", "n2", "n3", "n4", "more"])

    return run


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the texts of ``docs`` and store the model in the shared folder."""
    spark = docs.sparkSession
    shards = min(partitions(spark), MAX_SHARDS)
    path = shared_path(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("text"))

    # words: counted, dealt by ranges of hashes, stored sorted
    words = texts.mapInArrow(_count_words, "h long, n long")
    place = F.shiftrightunsigned(F.shiftright("h", 31) * F.lit(shards).cast("long"), 32).cast("int")
    dealt = words.select(place.alias("shard"), "h", "n").repartitionById(shards, "shard").sortWithinPartitions("shard", "h")
    held, _ = spool(_by_shard(dealt, _store_words(path), "shard int, words long, tokens long"), "words")
    sizes = {r["shard"]: r for r in held.collect()}  # one row per shard
    if sizes:
        register(spark, path)  # the arrays go with the scope or the session
    offsets = np.append(0, np.cumsum([sizes[s]["words"] if s in sizes else 0 for s in range(shards)]))
    if offsets[-1] + 2 >= 1 << 31:
        raise ValueError(f"{offsets[-1]} distinct words: a pair's key has 31 bits for each of its two words")
    tokens = sum(r["tokens"] for r in sizes.values())
    model = Model(path, shards, tuple(offsets.tolist()), tokens, ())

    # contexts with more than an eighth of a shard's share of the tokens: 8 * shards at most
    def often(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                n = _array(path, "counts", s)
                big = np.flatnonzero(n * 8 * shards > tokens)
                yield pa.record_batch([pa.array(big + model.offsets[s])], names=["id"])

    hot = [r["id"] for r in held.select("shard").mapInArrow(often, "id long").collect()]
    begins = texts.count()
    hot += [model.begin] if begins * 8 * shards > tokens else []
    model = Model(path, shards, model.offsets, tokens, tuple((h, 0, 0, 0, 0) for h in hot))

    # pairs: counted, dealt by context (hot ones by pair), stored sorted
    pairs = texts.mapInArrow(_count_pairs(model), "shard int, key long, n long")
    dealt = pairs.repartitionById(shards, "shard").sortWithinPartitions("shard", "key")
    stats, stats_path = spool(_by_shard(dealt, _store_pairs(model), "kind int, id long, a long, b long, c long, d long"), "pairs")
    sums = [F.sum(c).alias(c) for c in "abcd"]
    hot_rows = stats.where("kind = 1").groupBy("id").agg(*sums).collect()
    of = stats.where("kind = 2").agg(*sums).first()
    pair_shards = tuple(sorted(r["id"] for r in stats.where("kind = 2").select("id").collect()))  # one row per shard

    # continuation counts, along with the words
    follow = stats.where("kind = 0").groupBy(F.col("b").cast("int").alias("shard"), F.col("id").alias("h")).agg(F.sum("a").alias("n"))
    dealt = follow.repartitionById(shards, "shard").sortWithinPartitions("shard", "h")
    schema = "total long, n1 long, n2 long, n3 long, n4 long, more long"
    told, _ = spool(_by_shard(dealt, _store_continuations(model), schema), "continuations")
    got = told.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "n1", "n2", "n3", "n4", "more"))).first()
    discard(spark, stats_path)
    word_discounts = modified_discounts(got["n1"], got["n2"], got["n3"], got["n4"])
    gamma = (word_discounts[0] * got["n1"] + word_discounts[1] * got["n2"] + word_discounts[2] * got["more"]) / max(1, got["total"])
    return Model(
        path, shards, model.offsets, tokens, tuple(tuple(r) for r in hot_rows),
        modified_discounts(*(of[c] or 0 for c in "abcd")), word_discounts, got["total"], gamma if got["total"] else 1.0, pair_shards,
    )


def _by_shard(dealt: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task((shard,), batches)`` for each shard of sorted rows.

    Rows come sorted by shard, so the batches of one shard follow each other.
    """

    def run(batches):
        shard, held = None, []
        for b in batches:
            each = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, each[1:] != each[:-1])), len(each)) if len(each) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and each[lo] != shard:
                    yield from task((pa.scalar(int(shard)),), held)
                    held = []
                shard = each[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from task((pa.scalar(int(shard)),), held)

    return dealt.mapInArrow(run, schema)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model, taught: Column, id_col: str = "doc_id", text_col: str = "text", base: float = 0.1) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    ``score``: log10 probability of the text; ``base_score``: that of single words with
    ``base`` added to every count; ``held_out``: not ``taught``.
    """

    def run(batches):
        for rows, lengths, hashes in _chunks(batches):
            context, word = _pairs_of(model, lengths, hashes)
            starts = np.append(0, np.cumsum(lengths)[:-1])
            keys, where = np.unique(context << 32 | word, return_inverse=True)
            pair = np.log10(model.pair_prob(keys >> 32, keys & 0xFFFFFFFF))[where]
            count = model.of_words("counts", keys & 0xFFFFFFFF)
            single = np.log10((count + base) / (model.tokens + base * (model.distinct + 1)))[where]
            cols = [rows.column(1), rows.column(2), lengths, np.add.reduceat((count > 0)[where].astype(np.int64), starts)]
            cols += [np.full(len(lengths), model.tokens), np.add.reduceat(single, starts), np.add.reduceat(pair, starts)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), (~taught).alias("held_out"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
