"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(adds) the vectors of all its n-grams, and a language's prototype bundles the texts
that carry its label, each scaled to the same weight.  A text gets the language whose
prototype has the largest cosine with the text's vector.

Letters are lower-cased; every run of other characters is one gap, and a gap stands
before and after the text.  A letter's vector comes from its code point and ``seed``
alone, so all tasks agree without sharing a table.  Prototypes are sums of integers,
the same in every order of the rows.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and teach
nothing; rows without a label teach nothing; without any labelled text everything is
``und``; ties go to the label that sorts first; repeated rows count and are returned
as often as they occur; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNKNOWN = "und"
#: Characters and texts that are read at once; counts held, and n-gram vectors made, at once.
GROUP_CHARS, GROUP_TEXTS, GROUP_CELLS, GROUP_GRAMS = 1 << 18, 512, 1 << 22, 1 << 12
#: A text's bundle enters a prototype as integers of about this scale.
SCALE = 1 << 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 14)
def _letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    """The vector of a letter, of the gap for code 0."""
    return np.random.default_rng([seed, code]).integers(0, 2, dims).astype(np.float32) * 2 - 1


@dataclass(frozen=True)
class Profile:
    """How texts become vectors."""

    dims: int = 1024
    order: int = 3
    seed: int = 42

    def codes(self, text: str) -> np.ndarray:
        """Letters' code points, 0 for a gap; empty for a text without a letter."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.where(_letters()[raw], raw, 0)
        if not raw.any():
            return raw[:0]
        raw = np.concatenate([[0], raw, [0]]).astype(np.uint32)
        return raw[(raw != 0) | np.append(True, raw[:-1] != 0)]

    def counts(self, texts: list[str]):
        """``(begin, counts, grams)``: n-gram counts of a run of texts, and their vectors."""
        coded = [self.codes(t) for t in texts]
        flat = np.concatenate([np.zeros(0, np.uint32), *coded])
        seen = np.zeros(0x110000, bool)
        seen[flat] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        base, names = max(1, len(alphabet)), []
        for c in coded:
            n = max(0, len(c) - self.order + 1)
            name = np.zeros(n, np.int64)
            for k in range(self.order):
                name = name * base + place[c[k : k + n]]
            names.append(name)
        ends = np.cumsum([0, *(len(x) for x in names)])
        name = np.concatenate([np.zeros(0, np.int64), *names])
        if base**self.order > 1 << 22:  # many letters: name the n-grams that occur
            known, at = np.unique(name, return_inverse=True)
        else:
            held = np.zeros(base**self.order, bool)
            held[name] = True
            known = np.flatnonzero(held)
            at = (np.cumsum(held) - 1)[name]
        width, grams = max(1, len(known)), Grams(self, alphabet, known)
        step = max(1, GROUP_CELLS // width)
        for begin in range(0, len(texts), step):
            end = min(len(texts), begin + step)
            here = slice(ends[begin], ends[end])
            row = np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1]))
            found = np.bincount(row * width + at[here], minlength=(end - begin) * width)
            yield begin, found.reshape(-1, width)[:, : len(known)].astype(np.float32), grams


@dataclass(frozen=True)
class Grams:
    """The n-grams that occur in some texts, and their vectors, a block at a time."""

    profile: Profile
    alphabet: np.ndarray
    known: np.ndarray

    def bundle(self, weights: np.ndarray) -> np.ndarray:
        """Rows of n-gram weights, each as the weighted sum of the n-grams' vectors."""
        p, base = self.profile, max(1, len(self.alphabet))
        out = np.zeros((len(weights), p.dims))
        if not len(self.known):
            return out
        letters = np.stack([_letter_vector(int(a), p.dims, p.seed) for a in self.alphabet])
        rolled = [np.roll(letters, k, axis=1) for k in range(p.order)]  # the last letter is not rotated
        for s in range(0, len(self.known), GROUP_GRAMS):
            left = self.known[s : s + GROUP_GRAMS]
            vectors = np.ones((len(left), p.dims), np.float32)
            for turned in rolled:
                vectors *= turned[left % base]
                left = left // base
            out += weights[:, s : s + GROUP_GRAMS] @ vectors.astype(weights.dtype, copy=False)
        return out


def _groups(batch: pa.RecordBatch):
    """Row ranges of about GROUP_CHARS characters, or GROUP_TEXTS rows, with their texts."""
    begin, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(0)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= GROUP_CHARS or len(texts) >= GROUP_TEXTS:
            yield begin, texts
            begin, texts, size = i + 1, [], 0
    if texts:
        yield begin, texts


def prototypes(docs: DataFrame, profile: Profile, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """One unit vector per label; the result has ``dims`` numbers per label."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b.column(1).to_pylist()
            for begin, texts in _groups(b):
                label = np.array(lang[begin : begin + len(texts)])
                for at, counts, grams in profile.counts(texts):
                    mine = label[at : at + len(counts)]
                    norm = np.sqrt(np.einsum("ij,ij->i", counts, counts, dtype=np.float64))
                    scale = np.divide(SCALE, norm, out=np.zeros_like(norm), where=norm > 0)
                    # every text is rounded by itself: sums don't depend on who shares a batch
                    labels = sorted(set(mine.tolist()))
                    shares = [np.rint(counts[mine == x] * scale[mine == x, None]).sum(axis=0) for x in labels]
                    for x, got in zip(labels, grams.bundle(np.array(shares)), strict=True):
                        sums[x] = sums.get(x, 0) + got.astype(np.int64)  # whole numbers below 2 ** 53
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "v"])

    taught = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = taught.mapInArrow(run, "lang string, v array<bigint>")
    total = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["lang"], np.zeros(profile.dims))[r["k"]] = r["x"]
    return {k: out[k] / np.linalg.norm(out[k]) for k in sorted(out) if np.linalg.norm(out[k]) > 0}


def detect(text: Column, protos: dict[str, np.ndarray], profile: Profile) -> Column:
    """``struct(lang_pred, score)`` of a text; ``score`` is the cosine, 0 at least."""
    names = list(protos)
    table = np.stack([protos[k] for k in names]) if names else np.zeros((0, profile.dims))

    def run(col: pd.Series) -> pd.DataFrame:
        best, score = [], []
        for _, texts in _groups(pa.record_batch([pa.array(col, pa.string())], names=["t"])):
            for _, counts, grams in profile.counts(texts):
                bundle = grams.bundle(counts)
                norm = np.sqrt((bundle * bundle).sum(axis=1))
                known = (counts.sum(axis=1) > 0) & bool(names)
                cos = np.round(bundle @ table.T / np.maximum(norm, 1e-30)[:, None], 12) if names else np.zeros((len(counts), 1))
                at = np.argmax(cos, axis=1)
                best += [names[k] if ok else UNKNOWN for k, ok in zip(at, known, strict=True)]
                score += [float(min(1.0, max(0.0, c[k]))) if ok else 0.0 for c, k, ok in zip(cos, at, known, strict=True)]
        return pd.DataFrame({"lang_pred": best, "score": score}, columns=["lang_pred", "score"])

    run.__annotations__ = {"col": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, taught: Column, profile: Profile | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with a struct column ``language`` (``lang_pred``, ``score``).

    Learns from the rows where ``taught`` holds.
    """
    small_batches(docs.sparkSession)
    profile = profile or Profile()
    protos = prototypes(docs.where(taught), profile, text_col, lang_col)
    return docs.withColumn("language", detect(F.col(text_col), protos, profile))
