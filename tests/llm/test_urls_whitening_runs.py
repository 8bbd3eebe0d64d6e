"""URL rules, whitening and runs against brute force; their queries on made tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ledgerlark.llm import exact_whitening, url_rules, word_runs
from ledgerlark.llm import queries as Q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- url rules -----------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]


def judge(url, rules, default="allow"):
    host, path = split_url(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def urls(seed, n=1500):
    rnd = random.Random(seed)
    label = ["a", "b", "net", "é", "", "x"]
    hosts = lambda k: ".".join(rnd.choice(label) for _ in range(rnd.randint(1, k)))
    paths = lambda k: "".join(rnd.choice(["/", "a", "b", "/a/", "é", "\uffff", "\U0010ffff"]) for _ in range(rnd.randint(0, k)))
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in {(hosts(3), paths(4)) for _ in range(150)}]
    found = [(i, rnd.choice(["http://", "x://", "", "://"]) + hosts(6).upper() + rnd.choice(["", "/"]) + paths(9) + rnd.choice(["", "?q#", "#"])) for i in range(n)]
    found += [(None, None), (7, None), (8, "http://a.net/a/"), (9, "no url"), (10, ""), (11, "http://" + "a." * 3000 + "net/a/" + "b" * 50_000)] * 2
    return found + [(5, "http://a.net/a/")] * 900, rules


@pytest.mark.parametrize("parts", [1, 8, 31])
def test_url_rules(spark, parts):
    """Nested rules, empty labels, characters at the end of the code space, a hot url, rows twice."""
    found, rules = urls(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # columns with the operator's own names come along
        pages = spark.createDataFrame([(i, u, "key", 1, "host") for i, u in found], "page_id long, url string, key string, row int, rule string").repartition(5)
        got = rows(url_rules.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(((i, *judge(u, rules)) for i, u in found), key=str)


def test_url_rules_odd_tables(spark):
    found, rules = urls(1, 50)
    schema, parts = "page_id long, url string", "host string, path string, verdict string"
    pages = spark.createDataFrame(found, schema)
    odd = spark.createDataFrame([(None, "/", "block"), ("a", None, "block"), ("", "/", "block"), ("a", "/", None), ("a", "x", "block")], parts)
    for few in (odd, odd.limit(0), url_rules.rule_table(spark, [])):
        assert rows(url_rules.filter_urls(pages, few, default="block")) == sorted(((i, *split_url(u), None, "block") for i, u in found), key=str)
    # of equal rules a block wins, upper case in a rule's host counts as lower
    both = spark.createDataFrame([("A.net", "/", "allow"), ("a.net", "/", "block"), ("net", "/", "allow")], parts)
    one = spark.createDataFrame([(1, "http://x.a.net/b"), (2, "http://net/")], schema)
    assert rows(url_rules.filter_urls(one, both)) == [(1, "x.a.net", "/b", "a.net/", "block"), (2, "net", "/", "net/", "allow")]
    assert url_rules.filter_urls(pages.limit(0), both).count() == 0


def test_url_query(spark, tmp_path):
    rnd = random.Random(4)
    hosts = ["a.example.net", "example.net", "net", "xnet", "example.com", "b.example.com", "A.ORG", "org", "example.net:80", "u@org", ""]
    found = [(i, "http://" + rnd.choice(hosts) + rnd.choice(["", "/", "/en/", "/en", "/de/x", "/fr/y?z", "?/en/", "#"])) for i in range(400)] + [(None, None), (3, None)]
    spark.createDataFrame([(i, u, "<p>") for i, u in found], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.op11_url_filters(spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert rows(got) == sorted(((i, *judge(u, Q.URL_RULES)) for i, u in found), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.sql(Q.ORACLE["op11_url_filters"]).fetchall(), key=str) == rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- whitening -----------------------------------------------------------------------


def characteristic(m):
    """Faddeev and LeVerrier's recursion in whole numbers, constant first."""
    d, c = len(m), [1]
    a = [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) + c[-1] * (i == j) for j in range(d)] for i in range(d)]
        c.append(-sum(m[i][t] * a[t][i] for i in range(d) for t in range(d)) // k)
    return c[::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-2000, 2000, size=(d + 3, d))
    if d == 5:
        x[:, 1], x[:, 2] = x[:, 0], 0  # dependent and empty dimensions: zero pivots
    m = (x.T @ x).tolist()
    assert exact_whitening.characteristic(spark, m) == characteristic(m)
    for p in (2**31 - 1, 10007, 101):
        assert exact_whitening.characteristic_mod(np.array([[v % p for v in r] for r in m], np.int64), p) == [c % p for c in characteristic(m)]


def test_roots():
    near = 10**30
    for diagonal in ([5, 5, 3, 2], [7, 7, 7, 1], [near, near - 1, near - 2, 1], [9, 0, 0, 0], [0, 0, 0, 0]):
        m = [[v if i == j else 0 for j in range(4)] for i, v in enumerate(diagonal)]
        got = exact_whitening.largest_roots(characteristic(m), 3)
        spread = [r for r, k in got for _ in range(k)]
        want = sorted((v for v in diagonal if v), reverse=True)[: len(spread)]
        assert len(spread) >= min(3, sum(v > 0 for v in diagonal))
        assert all(abs(r - w) <= Fraction(max(diagonal), 2**300) for r, w in zip(spread, want, strict=True))
    # neighbours 1e-30 apart still have their own null vectors
    m = [[near, 1, 0], [1, near, 0], [0, 0, 5]]
    (a, k), (b, _) = exact_whitening.largest_roots(characteristic(m), 2)
    assert k == 1 and a - b == 2
    assert np.allclose(exact_whitening.null_vectors(m, a, 1)[0], [0.5**0.5, 0.5**0.5, 0], atol=1e-15)
    assert np.allclose(np.abs(exact_whitening.null_vectors(m, b, 1)[0]), [0.5**0.5, 0.5**0.5, 0], atol=1e-15)
    two = np.array(exact_whitening.null_vectors([[3, 0, 0], [0, 3, 0], [0, 0, 1]], Fraction(3), 2))
    assert np.allclose(two @ two.T, np.eye(2), atol=1e-15) and np.allclose(two[:, 2], 0, atol=1e-15)


VECTORS = "vec_id long, embedding array<float>, n int, x string, whitened double"
ODD = [(900, None), (901, [None] + [1.0] * 7), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 8)]


def vectors(seed, n=300, d=8):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(1, 0.05, d)).astype(np.float32)
    x[10:80] = x[10]  # copies
    x[81] = 0
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(None, [0.25] * d), (5, [float(v) for v in x[5]])]


def expected(found):
    """Ids, whole vectors, sums, and whitening by numpy."""
    ids = [i for i, _ in found]
    x = np.array([[math.floor(256 * v) for v in row] for _, row in found], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    order = np.argsort(e)[::-1]
    return ids, x, n, s, e[order], u[:, order], np.trace(v)


def test_whiten(spark, tmp_path):
    found = vectors(1)
    spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in found + ODD], VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = Q.op12_embedding_whitening(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    ids, x, n, s, e, u, trace = expected(found)
    got = {}
    for r in out.collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert sum(map(len, got.values())) == 4 * len(found)
    signs = None
    for i, row in zip(ids, x, strict=True):
        away = ((n * row.astype(object) - s) ** 2).sum()
        mine = sorted(got[i, away], key=lambda r: r["component"])
        assert {r["n"] for r in mine} == {n} and [r["component"] for r in mine] == sorted([1, 2, 3, 4] * (len(mine) // 4))
        want = ((row - s / n) @ u / np.sqrt(np.maximum(e, 1e-9)))[:4]
        y = np.array([r["whitened"] for r in mine[:: len(mine) // 4]])
        signs = np.sign(y * want) if signs is None else signs
        assert np.allclose(y, want * signs, atol=1e-8)
        assert np.allclose([r["explained"] for r in mine[:: len(mine) // 4]], (e / trace)[:4], rtol=1e-9)
        assert all(0 <= r["identity_error"] < 1e-9 for r in mine)


def test_whiten_few(spark):
    """No variance, no rows; ranks below four give as many components; equal variances."""
    frame = lambda vs: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    for few in ([], [[1, 2]], [[1, 2]] * 5):
        assert exact_whitening.whiten(frame(few)).count() == 0
    assert exact_whitening.whiten(frame([[1, 2]])).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    line = exact_whitening.whiten(frame([[0, 0, 0], [1, 1, 0], [2, 2, 0]])).collect()
    assert all(len(r["whitened"]) == 1 and r["explained"] == [1.0] for r in line)
    assert sorted(round(abs(r["whitened"][0]), 9) for r in line) == [0, round(1.5**0.5, 9), round(1.5**0.5, 9)]
    cross = exact_whitening.whiten(frame([[1, 0], [-1, 0], [0, 1], [0, -1]])).collect()
    assert all(r["explained"] == [0.5, 0.5] and sum(v * v for v in r["whitened"]) == pytest.approx(2, abs=1e-12) for r in cross)
    assert cross[0]["identity_error"] < 1e-12


def test_whiten_large_entries(spark):
    """Entries whose squares leave the exact range of floating point are summed as they are."""
    big = [[2.0**35, 1.0], [-(2.0**35), 2.0], [2.0**35 + 0.25, -1.0], [1.0, 0.5]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    x = [[math.floor(256 * v) for v in row] for row in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    got = {r["vec_id"]: r for r in exact_whitening.whiten(df).collect()}
    assert {i: int(r["deviation"]) for i, r in got.items()} == {i: sum((4 * v - t) ** 2 for v, t in zip(row, s, strict=True)) for i, row in enumerate(x)}
    assert len(got[0]["whitened"]) == 2 and got[0]["identity_error"] < 1e-9


# ---- runs ----------------------------------------------------------------------------


def brute_runs(w, shortest, repeats):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, s = j - i + q, w[i : j + q]
            if length >= max(shortest, repeats * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs():
    rnd = random.Random(3)
    for t in range(1500):
        n, k = rnd.randint(0, 120), rnd.choice([1, 2, 3, 5, 50])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 10 else 0):
            a, p = rnd.randrange(n), rnd.randint(1, 20)
            for i in range(a + p, min(n, a + p * rnd.randint(2, 6) + rnd.randint(0, p))):
                w[i] = w[i - p]
        shortest, repeats = rnd.choice([(24, 3), (30, 3), (40, 4)])
        assert word_runs.runs_of(w, shortest, repeats) == brute_runs(w, shortest, repeats)
        assert [r for r in word_runs.squares(w, 6, 3) if r[1] >= max(6, 3 * r[2])] == brute_runs(w, 6, 3)


def brute_row(doc_id, text):
    w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w, 24, 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(most or (None, None, None)), most and 1000 * most[1] // most[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_query(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abé\u00a0\u2003z") for _ in range(rnd.randint(1, 3)))
    docs = []
    for i in range(260):
        w = [word() for _ in range(rnd.randint(0, 150))]
        if i % 3 == 0 and w:
            w = (w[:30] + w[: rnd.randint(1, 20)] * rnd.randint(3, 9) + w[30:]) * rnd.randint(1, 3)
        docs.append((i, "".join(x + rnd.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for x in w)))
    long = [word() for _ in range(3000)]
    docs += [(300, None), (None, "a " * 50), (301, ""), (302, " \n\t "), (303, "a " * 20_000), (304, " ".join(long)), (305, " ".join(long[:900] * 4)), docs[3], docs[3], (3, docs[6][1])]
    spark.createDataFrame([(i, t, "runs", 1) for i, t in docs], "doc_id long, text string, runs string, id int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((brute_row(i, t) for i, t in docs), key=str)
    assert rows(got) == want and sum(r[1] > 1 for r in want) > 20
    assert word_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        word_runs.periodic_runs(got.withColumn("text", got["runs_sha256"]), shortest=20)
