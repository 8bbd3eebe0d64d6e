"""The text operators against brute force, and their edge cases."""

import hashlib
import math
import os
import random
import tempfile
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm import hyper_lang, kneser_ney, license_digest, prefix_doubling, simhash_trie, slack_packing, unigram_pieces
from ledgerlark.llm import queries as Q

WORD_BPE, PIECES = Q.tokenizer_file("word_bpe_49k.json"), Q.tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, id string, tkey int, fp string, start int"


def corpus(seed=5, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 40))) for _ in range(10)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            r = rnd.random()
            if r < 0.5:
                parts.append(rnd.choice(passages)[rnd.randint(0, 20) :])
            elif r < 0.6:
                parts.append("a" * rnd.randint(40, 130))
            else:
                parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))))
        docs.append((i, "\n".join(parts)))
    long = " ".join(rnd.choice(words) for _ in range(20000))
    # null text, null id, empty, a row twice, one id with two texts, copies, a very long text
    docs += [(200, None), (None, passages[0]), (201, ""), (3, docs[3][1]), (202, docs[5][1]), (202, docs[6][1]), (203, long), (204, "X" + long)]
    docs += [(300 + k, passages[1]) for k in range(60)]
    return docs


def frame(spark, docs):
    """Columns whose names clash with the operators' own come along."""
    rows = [(i, t, "xx", "id", 1, "fp", 2) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_repeats(docs, length=50):
    first = {}
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - length + 1 if i is not None else 0):
            w = data[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1 if i is not None else 0):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, y in zip(data, gone) if not y)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_remove_repeats(spark):
    docs = corpus()
    assert rows(prefix_doubling.remove_repeats(frame(spark, docs))) == brute_repeats(docs)


def test_remove_repeats_small_chunks_and_hot_names(spark, monkeypatch):
    """The same with tiny chunks and pieces and every shared anchor name dealt as hot."""
    from pyspark import cloudpickle

    docs = corpus(6, 60)
    for name, value in (("CHUNK_BYTES", 3000), ("PIECE", 200), ("HOLD_ROWS", 20), ("HOT_SAMPLE", 1), ("HOT_STRETCHES", 2)):
        monkeypatch.setattr(prefix_doubling, name, value)
    cloudpickle.register_pickle_by_value(prefix_doubling)
    try:
        assert rows(prefix_doubling.remove_repeats(frame(spark, docs))) == brute_repeats(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(prefix_doubling)


def test_cut_repeats_keeps_columns(spark):
    docs = [(1, "é" * 40 + "tail one"), (2, "é" * 40 + "tail two"), (3, None)]
    out = {r["doc_id"]: r for r in prefix_doubling.cut_repeats(frame(spark, docs)).collect()}
    assert out[1]["text"] == docs[0][1] and out[3]["text"] is None and out[2]["tkey"] == 1
    assert "two" in out[2]["text"] and "é" * 30 not in out[2]["text"]


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    docs = corpus(7) + [(400, None), (401, " \n"), (402, "A b"), (403, "a B"), (404, "one two three four five six")]
    fps = [brute_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)].append(i)
    want = sorted(((i, f"{fps[k]:016x}", min(low[find(k)], default=None)) for k, (i, _) in enumerate(docs)), key=str)
    got = simhash_trie.simhash_near_dedup(frame(spark, docs)).select("doc_id", "fingerprint", "component_id")
    assert rows(got) == want


@pytest.mark.parametrize("block", [8, 64])
def test_trie_join_in_blocks(spark, block):
    """Blocks and sub-blocks lose no link; a dense cluster stays one component."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    fps = list(base)
    for b in np.append(base[:20], [base[0]] * 60):
        for bit in rng.choice(64, rng.integers(1, 7), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        fps.append(b)
    fps = np.unique(np.array(fps, np.uint64))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = simhash_trie.union_labels(len(fps), i, j)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash_trie.trie_links(df, 4, block_rows=block).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got = simhash_trie.union_labels(len(fps), np.array([at[r["u"]] for r in links]), np.array([at[r["v"]] for r in links]))
    assert (got == want).all()


def test_packing(spark):
    docs = corpus(8) + [(500, "x\tY é! <|endoftext|> don't İ"), (501, "hi " * 9000)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    got = [r.asDict() for r in slack_packing.pack(frame(spark, docs), WORD_BPE).collect()]
    want = []
    for i, t in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want.append((i, p, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)


def test_words_with_signs_need_the_merges_alone():
    """Letters and then ASCII signs have the ids of the whole tokenizer, without being given to it."""
    from tokenizers import Tokenizer

    whole, rnd = Tokenizer.from_file(WORD_BPE), random.Random(4)
    signs = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    plain = ["".join(rnd.choice("abtheXÉßøÿ") for _ in range(rnd.randint(0, 9))) + "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 4))) for _ in range(2000)]
    plain += [*signs, *("x" + s * 3 for s in signs), "herely$$$", "ungß***", "<|", "|>"]
    odd = ["a<|endoftext|>", "<|startoftext|>b", "don't", "it's.", "'", ".'s", "(835)", "a.b", "x²", "e\u0301..", "=\u0338", "a\x00", "İ!", "ΑΣ.", "x\t,,", "\u00d7\u00f7"]
    seen = []

    class Whole:
        model = whole.model

        def encode_batch_fast(self, words, **kw):
            seen.extend(words)
            return whole.encode_batch_fast(words, **kw)

    encode = slack_packing.WordIds(WORD_BPE)
    encode.whole = Whole()
    texts = [*plain, *odd, " ".join(plain), " ".join(rnd.sample(plain + odd, 300))]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert {w.lower() for w in seen} <= {w.lower() for w in odd}


def test_fullest_is_the_best_subset():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(1, 9)))
        room = rnd.randint(1, 90)
        sums = {0}
        for x, n in lengths.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        order = sorted((x for x in lengths if x <= room), reverse=True)
        combo = slack_packing.fullest(dict(lengths), order, room)
        assert sum(x * n for x, n in combo) == max(sums) and all(n <= lengths[x] for x, n in combo)


def test_language_id(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 .. !", "fr"), (9004, "the and of", None), (None, "the", "en")], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionByName(extra)
    got = hyper_lang.identify(df, Q._remainder(3) != 1).select("doc_id", "lang", Q._remainder(3).alias("r"), "language.*").collect()
    assert len(got) == docs.count() + 5
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (9001, 9002, 9003))
    held = [r for r in got if r["r"] == 1 and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    # a text's vector is the sum of its bound n-grams
    profile = hyper_lang.Profile(dims=64)
    ((_, counts, made),) = profile.counts(["Ab-c!"])
    v = {c: hyper_lang._letter_vector(c and ord(c), 64, 42) for c in (0, "a", "b", "c")}
    grams = [(0, "a", "b"), ("a", "b", 0), ("b", 0, "c"), (0, "c", 0)]
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in grams)
    assert np.allclose(made.bundle(counts)[0], want)
    # blocks change nothing
    texts = ["Ab-c!", "", "zażółć gęślą jaźń " * 9, "the quick brown fox", "12", "漢字かな交じり文 " * 5]
    whole = [g.bundle(c) for _, c, g in profile.counts(texts)]
    monkeypatch.setattr(hyper_lang, "GROUP_CELLS", 40), monkeypatch.setattr(hyper_lang, "GROUP_GRAMS", 7)
    cut = [g.bundle(c) for _, c, g in profile.counts(texts)]
    assert len(cut) > len(whole) == 1 and np.array_equal(np.concatenate(cut), whole[0])
    assert hyper_lang.identify(df.limit(0), F.lit(True)).count() == 0


def brute_kneser_ney(texts, train):
    """Dictionaries, one formula after the other."""
    toks = [[*(t or "").encode().lower().split(), b" end"] for t in texts]
    word, pair, before = Counter(), Counter(), defaultdict(set)
    for k, ts in enumerate(toks):
        if train[k]:
            word.update(ts)
            for a, b in zip([None, *ts], ts):
                pair[a, b] += 1
                before[b].add(a)
    cont = {w: len(s) for w, s in before.items()}
    ctx = defaultdict(list)
    for (a, _), n in pair.items():
        ctx[a].append(n)
    total, v, n_all = sum(cont.values()), len(word), sum(word.values())
    of = lambda c: kneser_ney.modified_discounts(*(sum(x == k for x in c) for k in (1, 2, 3, 4)))
    dp, dw = of(pair.values()), of(cont.values())
    cut = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)
    gw = sum(n - cut(n, dw) for n in cont.values()) / total
    out = []
    for ts in toks:
        score = base = 0.0
        for a, b in zip([None, *ts], ts):
            p = cut(cont.get(b, 0), dw) / total + gw / (v + 1)
            if a in ctx:
                t = sum(ctx[a])
                p = cut(pair[a, b], dp) / t + sum((0, *dp)[min(n, 3)] for n in ctx[a]) / t * p
            score += math.log10(p)
            base += math.log10((word[b] + 0.1) / (n_all + 0.1 * (v + 1)))
        out.append((len(ts), sum(word[b] > 0 for b in ts), n_all, base, score))
    return out


def test_kneser_ney(spark):
    docs = [(i, t) for i, t in corpus(9) if i is not None and (i, t) != (202, None)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    want = brute_kneser_ney([t for _, t in docs], [not h for h in held])
    df = frame(spark, docs)
    taught = Q._remainder(10) != 0
    got = kneser_ney.score(df, kneser_ney.train(df.where(taught)), taught).collect()
    want = sorted(((i, h, *w) for (i, _), h, w in zip(docs, held, want)), key=str)
    got = sorted((tuple(r) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_kneser_ney_nothing_taught(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kneser_ney.train(df.limit(0))
    got = {r["doc_id"]: r for r in kneser_ney.score(df, model, F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[2]["n_tokens"] == 1 and got[1]["score"] == 0


@pytest.mark.parametrize("kind", ["words", "counts", "continuations", "pairs", "pair_counts", "contexts", "context_counts"])
def test_kneser_ney_lost_file(kind):
    """A file that was written and is not there is an error, a shard never written is empty."""
    with tempfile.TemporaryDirectory() as path:
        model = kneser_ney.Model(path, 1, (0, 2), 3, (), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 2, 0.5, (0,))
        arrays = {
            "words": np.array([5, 9], np.uint64), "counts": np.array([2, 1]), "continuations": np.array([1, 1]), "pairs": np.array([1, 3 << 32]),
            "pair_counts": np.array([1, 1]), "contexts": np.array([0, 3]), "context_counts": np.array([[1, 1, 0, 0]] * 2),
        }
        for name, values in arrays.items():
            if name != kind:
                kneser_ney.store(f"{path}/{name}-00000.npy", values)
        with pytest.raises(FileNotFoundError):
            model.word_ids(np.array([5], np.uint64)), model.of_words("counts", np.array([0])), model.pair_prob(np.array([0]), np.array([1]))
    assert len(kneser_ney.Model("/none", 1, (0, 0), 0, ()).of_pairs("pairs", 0)) == 0


def test_licences(spark):
    mit = license_digest.KNOWN[9][1]
    docs = [
        (1, mit), (2, mit.upper().replace(",", " ,\n")), (3, mit.replace("<year> <holders>", "2019-2021 Jane Doe\nCopyright 2020 by X")),
        (4, mit.replace("free of charge", "at a charge")), (5, "prose\nReleased  under the MIT Licence\nmore"), (6, None), (7, ""), (8, "...\n!"),
        (9, "licensed under the apache licence version 2.0"),
    ]
    got = {r["doc_id"]: r["licence"] for r in license_digest.scan(frame(spark, docs)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "Apache-2.0"}
    lines = license_digest.scan(frame(spark, docs[4:]), unit="line").select("doc_id", "place", "licence")
    assert rows(lines) == [(5, 1, "MIT"), (9, 0, "Apache-2.0")]


def wrapped(text, width):
    """Paragraphs wrapped; copyright lines stay whole."""
    parts = (p if "<year>" in p else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
    return "\n\n".join(parts)


def test_licences_at_every_width(spark):
    whole = [(name, text) for name, text in license_digest.KNOWN if len(text) > 500]
    # upper case after wrapping, as "<year>" marks the line that stays whole
    docs = [f(wrapped(text, w)) for _, text in whole for f in (str, str.upper) for w in range(12, 130)]
    got = Counter(r["licence"] for r in license_digest.scan(frame(spark, list(enumerate(docs)))).collect())
    assert got == {name: 236 for name, _ in whole}


def test_copyright_lines(spark):
    gone = ["Copyright (c) 2019 X", "(c) 2019 X", "© 2019, X", "Copyright 2019-2021 X", "COPYRIGHT (C) 2020 X", "copyright by X", "Copyright (c) <year> <holders>",
            "Copyright [yyyy] [name of copyright owner]", " * Copyright npm, Inc.", "Copyright: Jane Doe", "Copyright © Jane Doe", "Copyright The Authors", "© Jane Doe"]
    kept = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "(c) You must retain",
            "Copyright License. Subject to", "\"Copyright\" also means copyright-like laws", "Copyright Treaty adopted on", "copyright owner that is granting", "(c) Copyright and Similar Rights"]
    df = spark.createDataFrame([(t,) for t in gone + kept], "text string").select("text", license_digest.canonical(F.col("text")).alias("form"))
    form = {r["text"]: r["form"] for r in df.collect()}
    assert [t for t in gone if form[t]] == [] and [t for t in kept if not form[t]] == []


BSD_2 = """Copyright (c) 2012, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
CLAUSE_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
"""
SHIPPED = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_full_licence_texts(spark):
    mit = license_digest.TEXTS[0][1].removeprefix("MIT License\n\n")
    texts = [
        ("BSD-2-Clause", BSD_2 % ""), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_2 % CLAUSE_3), ("Unlicense", UNLICENSE), ("MIT", mit),
        ("MIT", "The MIT License (MIT)\n\n" + mit.replace("<year> <holders>", "2015 Jane Doe")), (None, UNLICENSE.replace("is free to", "may")),
    ]
    folder = "/usr/share/common-licenses"
    if os.path.isdir(folder):  # as Debian ships them
        for name, licence in SHIPPED.items():
            with open(f"{folder}/{name}") as f:
                texts.append((licence, f.read()))
    got = {r["doc_id"]: r["licence"] for r in license_digest.scan(frame(spark, [(k, t) for k, (_, t) in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == [licence for licence, _ in texts]


def test_pieces(spark):
    docs = corpus(10, 40) + [(600, "日本 𝕏  two\tx "), (601, " lead"), (602, "\x00")]
    coded = unigram_pieces.encode(frame(spark, docs), PIECES)
    back = unigram_pieces.decode(coded, PIECES)
    assert rows(back) == sorted(docs, key=str)
    # no segmentation scores better: dynamic programme over all substrings of short texts
    p = unigram_pieces.pieces(PIECES)
    score = {p.names[i]: s for i, s in zip(p.plain, p.scores)}
    for text in ("abc de", "hello world", "é日x", "the  cat"):
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(marked)
        for e in range(1, len(marked) + 1):
            for b in range(e):
                piece = marked[b:e]
                s = score.get(piece, p.unknown_score if e - b == 1 else -math.inf)
                best[e] = max(best[e], best[b] + s)
        ids = p.encode([text])[0].tolist()
        by_id = dict(zip(p.plain, p.scores))
        data, got = b"", 0.0
        for i in ids:
            if p.is_byte[i]:
                data += p.bytes_of[i]
            else:
                got += by_id[i]
        assert got + p.unknown_score * len(data.decode()) == pytest.approx(best[-1])


def test_empty_tables(spark):
    df = frame(spark, corpus(1, 9)).limit(0)
    for out in (
        prefix_doubling.remove_repeats(df), simhash_trie.simhash_near_dedup(df), slack_packing.pack(df, WORD_BPE),
        license_digest.scan(df), unigram_pieces.encode(df, PIECES),
    ):
        assert out.count() == 0


def test_language_stage(spark):
    import corpus_pipeline

    texts = ["the and of", "日本語", "12 .. !", "", None, "é"]
    df = spark.createDataFrame([(i, t, "en" if i == 0 else None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs, lang in ((df, "en"), (df.withColumn("lang", F.lit(None).cast("string")), None)):
        got = corpus_pipeline.language_id(spark, docs, "")
        # the prediction fills what is not given
        assert sorted((r["doc_id"], r["lang"]) for r in got.collect()) == [(0, lang), (1, lang), (5, lang)]


def test_simhash_stage_null_and_shared_ids(spark):
    import corpus_pipeline

    rnd = random.Random(12)
    a, b, c, d = (" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(300)) for _ in range(4))
    docs = [(None, a), (None, a.upper()), (7, a), (None, b), (None, b.upper()), (5, c), (5, d), (5, d), (9, d)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(7, a), (None, b), (5, c), (5, d)], key=str)


def test_segment_many_words_at_once():
    """Words segmented together equal those segmented alone: unknown characters, bytes, ties."""
    vocabulary = unigram_pieces.pieces(PIECES)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("aé▁漢😀\x00z\ud800 ́bcdeing") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    words += ["a", "a" * 300, "▁", "▁▁▁the", "😀"]
    assert vocabulary.segment_all(words) == [np.array(vocabulary.segment(w), "<i4").tobytes() for w in words]


def test_round_trips(spark):
    """The registered form: counts, checksum and sameness against encode and decode, a long unbroken text too."""
    long = "".join(random.Random(2).choice("abcdefgh漢") for _ in range(30_000))
    docs = [*corpus()[:60], (900, long), (901, "a  b"), (902, None), (903, "x▁y"), (904, "")]
    got = {(r[0], r[3]): tuple(r) for r in unigram_pieces.round_trips(frame(spark, docs), PIECES).collect()}
    vocabulary = unigram_pieces.pieces(PIECES)
    for i, t in docs:
        ids = np.concatenate([np.zeros(0, "<i4"), *vocabulary.encode([t or ""])])
        crc = zlib.crc32(ids.astype("<i4").tobytes())
        same = t is None or vocabulary.decode(ids.tolist()) == t
        assert got[i, crc] == (i, len(ids), int(vocabulary.is_byte[ids].sum()), crc, same)
        assert same == ("▁" not in (t or ""))


def test_operators_leave_nothing_in_the_shared_folder(spark):
    from ledgerlark.plans.spool import scope
    from ledgerlark.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = frame(spark, corpus()[:40])
    with scope(spark):
        kneser_ney.score(docs, kneser_ney.train(docs), F.lit(True)).collect()
        simhash_trie.simhash_near_dedup(docs, shingle=4, max_bits=4).collect()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_pipeline_run(spark, tmp_path):
    """All stages against brute force: letters, near copies, shared passages, pieces."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from ledgerlark.plans.spool import scope
    from ledgerlark.session import ensure_checkpoint_dir

    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(12, 40))) for _ in range(6)]
    docs = []
    for i in range(90):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 200))) for _ in range(rnd.randint(1, 3))]
        docs.append((i, " ".join([*parts, *rnd.sample(passages, rnd.randint(0, 2))])))
    docs += [(100, docs[3][1]), (101, docs[4][1].upper()), (102, None), (103, "12 .. !"), (104, ""), (105, passages[0]), (106, "a " * 9000)]
    frame_ = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame_.write.parquet(f"{tmp_path}/documents.parquet")

    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    fps = {i: brute_fingerprint(t) for i, t in kept}
    group = {i: i for i, _ in kept}
    for i, _ in kept:
        for j, _ in kept:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    kept = [(i, t) for i, t in kept if group[i] == i]
    seen, want = {}, []
    for i, t in kept:
        for p in range(len(t) - 49):
            seen[t[p : p + 50]] = min(seen.get(t[p : p + 50], i), i)
    whole = Tokenizer.from_file(WORD_BPE)
    for i, t in kept:
        gone = set()
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        left = "".join(c for k, c in enumerate(t) if k not in gone)
        if left:
            ids = np.array([*whole.encode(left, add_special_tokens=False).ids, 1], "<u4")
            want += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scope(spark):
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert set(os.listdir(folder)) == before and len({i for i, *_ in want}) < len(kept) + 1 < len(docs)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.simhash_near_dedup, corpus_pipeline.passage_removal, corpus_pipeline.packing):
        assert stage(spark, frame_.limit(0), "").count() == 0
