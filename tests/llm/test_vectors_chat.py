"""The vector operators and chat formatting against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import cross_polytope, e8_lattice, preference_chat

SCHEMA = "vec_id long, embedding array<float>, rep long, vec int"
ODD = [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (905, [])]


def table(seed, n=400, dims=16, hot=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[5 : 5 + hot] = x[5]  # copies
    near = x[100] + rng.normal(size=(60, dims)).astype(np.float32) * 0.12
    x[100:160] = near
    x[200] = 3 * x[201]  # the same direction
    return x


def frame(spark, x):
    rows = [(k, [float(f) for f in v], 1, 2) for k, v in enumerate(x)] + [(i, v, 1, 2) for i, v in ODD]
    rows.append(rows[7])  # a row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def cosines(x):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return u @ u.T


def test_nearest(spark):
    x = table(1)
    c = cosines(x)
    got = {}
    for r in cross_polytope.nearest(frame(spark, x), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = range(0, len(x), 50)
    hits = 0
    for q in asked:
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        for _, v, s in mine:
            assert v != q and s == pytest.approx(c[q, v], abs=1e-12)
        # nearest first, ties to the smaller id; the copies tie
        assert [(-round(s, 9), v) for _, v, s in mine] == sorted((-round(s, 9), v) for _, v, s in mine)
        want = sorted((v for v in range(len(x)) if v != q), key=lambda v: (-round(c[q, v], 9), v))[:5]
        hits += len(set(want) & {m[1] for m in mine})
    assert hits >= 0.9 * 5 * len(asked) and sorted(got) == list(asked)


def test_nearest_few_rows(spark):
    """With fewer candidates than asked for, all come; a query in an empty cell is served."""
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.1, 0.0]), (2, [0.0, -1.0, 0.5])], "vec_id long, embedding array<float>")
    got = cross_polytope.nearest(df, F.col("vec_id") == 0, hashing=cross_polytope.CrossPolytope(1, 1)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 2), (0, 2, 1)]
    assert cross_polytope.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_wide_cells():
    x = np.random.default_rng(0).normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = cross_polytope.CrossPolytope(width=2).cells(x, 0, 9)
    assert cells.shape == (50, 9) and cells.max() < 256 and all(len(set(c)) == 9 for c in cells.tolist())


def test_decode_is_nearest():
    y = np.random.default_rng(2).normal(size=(300, 8)) * 2
    p = e8_lattice.decode(y)
    assert ((p % 2 == p[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    near = p[:, None] + e8_lattice.neighbours()[None]
    assert (((near / 2 - y[:, None]) ** 2).sum(axis=2).min(axis=1) >= ((p / 2 - y) ** 2).sum(axis=1) - 1e-9).all()


@pytest.mark.parametrize("block", [16384, 16])
def test_near_dedup(spark, block, monkeypatch):
    from ledgerlark.llm import vectors

    monkeypatch.setattr(vectors.block_pairs, "__defaults__", (block,))
    x = table(3)
    c = cosines(x) >= 0.9
    links = c.sum(axis=1) - 1
    comp = np.arange(len(x))
    while True:
        low = np.array([comp[c[k]].min() for k in range(len(x))])
        if (low == comp).all():
            break
        comp = low
    got = e8_lattice.embedding_near_dedup(frame(spark, x)).collect()
    assert len(got) == len(x) + len(ODD) + 1
    found = {r["vec_id"]: r for r in got}
    for i, _ in ODD:
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i
    assert sum(found[k]["n_links"] for k in range(len(x))) >= 0.99 * links.sum()
    assert all(found[k]["n_links"] <= links[k] for k in range(len(x)))
    assert [found[k]["component_id"] for k in range(len(x))] == comp.tolist()
    assert all(found[k]["kept"] == (comp[k] == k) for k in range(len(x)))
    # copies and the whole near group count every link
    assert found[5]["n_links"] == links[5]


@pytest.mark.parametrize("cosine, most", [(0.9, 0.004), (0.93, 0.0004)])
def test_few_pairs_at_the_threshold_missed(cosine, most):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1)[:, None]
    tables, met = e8_lattice.E8Tables(), np.zeros(4000, bool)
    for t in range(tables.tables):
        met |= e8_lattice._first_meeting(tables.cells(a, t), tables.cells(b, t))
    assert (~met).mean() <= most, (~met).sum()


def test_links_of_a_hot_cell_in_small_memory():
    """A task's memory does not grow with the pairs of its cell; its counts are exact."""
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(4), 5000
    x = rng.normal(size=16) + rng.normal(size=(n, 16)) * 0.1
    c = cosines(x) >= 0.9
    side, rep = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    cell = pa.table({"side": side, "rep": rep, "n": np.ones(2 * n, np.int64), "home": np.ones(2 * n, bool), "vec": pa.array(list(np.tile(x, (2, 1))))})
    task = e8_lattice._links(e8_lattice.E8Tables(), 0.9)
    tracemalloc.start()
    got = task((pa.scalar(16), pa.scalar(0), pa.scalar(1)), cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    links = np.zeros(n, np.int64)
    np.add.at(links, got["u"].to_numpy(), got["links"].to_numpy())
    assert c.sum() > 20_000_000 and (links == c.sum(axis=1) - 1).all()
    assert peak < 250 << 20, peak >> 20


def brute_pair(chosen, rejected):
    key = lambda t: (t[0] is None, t[0] or 0, t[1] or "", t[2] or "")
    c, r = ([(x[1], x[2]) for x in sorted(s, key=key)] for s in (chosen, rejected))
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    show = lambda t: f"<|im_start|>{t[0] or ''}\n{t[1] or ''}<|im_end|>\n"

    def rest(turns):
        text, mask = "", []
        for t in turns:
            if t[0] == "assistant":
                head = len(f"<|im_start|>{t[0]}\n")
                mask.append((len(text) + head, len(show(t)) - head))
            text += show(t)
        return text, mask

    return (n, "".join(map(show, c[:n])), *rest(c[n:]), *rest(r[n:]))


def test_preference_pairs(spark):
    chosen = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "fine"),
        (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 5, None, None), (3, 7, "assistant", None), (4, 0, "user", "same"),
        (None, 0, "user", "lost"), (6, 0, "user", "only chosen"),
    ]
    rejected = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "else"), (1, 3, "assistant", "fine"), (1, 4, "assistant", "é"),
        (2, 0, "user", "x"), (3, 0, None, None), (3, 1, "assistant", "t"), (4, 0, "user", "same"), (7, 0, "assistant", "only rejected"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    got = preference_chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    assert sorted(r["conv_id"] for r in got) == [1, 2, 3, 4, 6, 7]
    for r in got:
        sides = ([x[1:] for x in s if x[0] == r["conv_id"]] for s in (chosen, rejected))
        mask = lambda m: [(x["start"], x["length"]) for x in m]
        assert (r["prompt_turns"], r["prompt"], r["chosen"], mask(r["chosen_mask"]), r["rejected"], mask(r["rejected_mask"])) == brute_pair(*sides)
    none = spark.createDataFrame([], schema)
    assert preference_chat.preference_pairs(none, none).count() == 0


def test_echo_rejections(spark):
    conv = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, "user", "q"), (3, 0, "assistant", "first")]
    got = preference_chat.echo_rejections(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "r"), (2, 0, "user", "q"), (3, 0, "assistant", ""),
    ]


def test_chat_clashing_names_null_ids_and_long_texts(spark):
    """Columns with the operator's own names come along; turns without a conversation don't."""
    long = "é" * 200_000
    conv = [(1, 0, "user", long), (1, 1, "assistant", "b"), (None, 0, "user", "lost"), (None, 1, "assistant", "lost"), (2, 0, "user", "q")]
    schema = "conv_id long, turn long, role string, text string, pair int, at string, c int, r int, rest boolean"
    chosen = spark.createDataFrame([(*t, 1, "x", 2, 3, True) for t in conv], schema)
    rejected = preference_chat.echo_rejections(chosen)
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in rejected.collect()) == [(1, 0, long), (1, 1, long), (2, 0, "q")]
    extra = rejected.withColumns({k: F.lit(1) for k in ("pair", "at", "c", "r", "rest")})
    got = {r["conv_id"]: r for r in preference_chat.preference_pairs(chosen, extra).collect()}
    assert sorted(got) == [1, 2] and got[1]["prompt_turns"] == 1 and got[1]["prompt"] == f"<|im_start|>user\n{long}<|im_end|>\n"
    assert got[1]["chosen"] == "<|im_start|>assistant\nb<|im_end|>\n" and long in got[1]["rejected"] and got[2]["chosen"] == ""
