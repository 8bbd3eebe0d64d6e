"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers ``x = floor(256 * c)``.  The fit list is each distinct vector
once: ``n`` vectors, sums ``S``.  ``M = n * sum(x x') - S S'`` is ``n**2`` times their
covariance, in integers: tasks sum it in blocks, Spark adds the blocks as decimals.

The characteristic polynomial of ``M`` is worked out modulo as many 31-bit primes as its
coefficients' bound asks for, each by reduction to Hessenberg form in a Spark task, and
put together by Chinese remainders.  ``M`` is symmetric, so all roots are real, and the
sign changes of the polynomial shifted to ``a`` count the roots above ``a`` exactly:
bisection isolates the largest roots and takes them to far more digits than a double
has.  Components are null vectors of ``M - root`` by inverse iteration in decimals of
that precision; roots that agree in all of it share a space, whose basis is made
orthogonal.

What leaves the tasks depends on the number of dimensions alone: sums, ``M``, residues.

Edge cases: a vector that is null, empty, or holds null, non-finite or too large entries
(``LARGEST`` and up, for which the sums would leave 38 digits) is left out, and one whose
length isn't the commonest (of ties the longer); zero vectors stay; a null id is an id
like any other; rows are returned as often as they occur, copies and ties alike; a
deviation of more than 38 digits is null; components whose variance is zero can't be whitened
and are left out, so fewer than two distinct vectors give no row, as an empty table does;
extra columns are left out.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, spool

#: Integer steps per unit.
SCALE = 256
#: Size of an entry from which on its row is left out.
LARGEST = 2.0**38
#: Bits to which roots are taken, and from which on two count as one.
ROOT_BITS = 420
#: Digits of the decimals of the inverse iteration.
DIGITS = 160
#: Rows of a block of the scatter, at most.
CHUNK = 1 << 16
#: Primes of a task.
PRIMES = 8
EXACT = 2**53


@dataclass
class Whitening:
    """Fitted sums, unit components by falling variance, variances and the scatter's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, x)`` of the usable rows."""
    vec = F.col(vec_col).cast("array<double>")
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    x = F.transform(vec, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    rows = df.where(vec.isNotNull() & ~odd & (F.size(vec) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))
    kept, _ = spool(rows, "integers")
    lengths = kept.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return kept if lengths is None else kept.where(F.size("x") == lengths["k"])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """``x' x`` in whole numbers: by floating point where no sum can leave its exact range."""
    peak = int(np.abs(x).max(initial=0))
    if not peak or peak * peak <= EXACT // 64:
        step = EXACT // max(peak * peak, 1)
        return sum(((c := x[k : k + step].astype(np.float64)).T @ c).astype(np.int64).astype(object) for k in range(0, len(x), step))
    o = x.astype(object)
    return o.T @ o


def _scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """``n``, sums and scatter ``M`` of the distinct vectors."""
    whole = pa.decimal128(38, 0)

    def run(batches):
        n, sums, square = 0, 0, 0
        for x in (_matrix(b.column(0).slice(k, CHUNK)) for b in batches for k in range(0, b.num_rows, CHUNK)):
            if len(x):
                # 46 bits an entry and 2**16 rows at most: sums fit 64 bits
                n, sums, square = n + len(x), sums + x.sum(axis=0).astype(object), square + _products(x)
        if n:
            cells = [n, *sums.tolist(), *square.ravel().tolist()]
            yield pa.record_batch([pa.array(range(len(cells)), pa.int64()), pa.array(map(Decimal, cells), whole)], names=["at", "value"])

    added = fit.mapInArrow(run, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value"))
    cells = [int(r["value"]) for r in sorted(added.collect())]  # 1 + dims + dims * dims rows
    if not cells:
        return 0, [], []
    d = (math.isqrt(4 * len(cells) - 3) - 1) // 2
    n, sums, square = cells[0], cells[1 : d + 1], cells[d + 1 :]
    return n, sums, [[n * square[i * d + j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test; these bases decide every 32-bit number."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, product: int) -> list[int]:
    """Primes from ``top`` down whose product passes ``product``."""
    out, got, p = [], 1, top - 1 + top % 2
    while got <= product:
        if _is_prime(p):
            out.append(p)
            got *= p
        p -= 2
    return out


def characteristic_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of ``det(t - m)`` modulo the prime ``p`` below 2**31."""
    h, d = m.copy(), len(m)
    for k in range(1, d - 1):
        rows = np.flatnonzero(h[k:, k - 1])
        if not len(rows):
            continue
        if rows[0]:
            i = k + int(rows[0])
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            polys[k] = (polys[k] - int(h[k - i - 1, k - 1]) * below % p * polys[k - i - 1]) % p
    return polys[d].tolist()


def characteristic(spark, m: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of ``det(t - m)`` for a symmetric whole ``m`` >= 0."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # roots are at least 0 and add up to the trace, so coefficient k is within C(d, k) * (trace / k)**k
    bound = max(math.comb(d, k) * -(-(trace**k) // k**k) for k in range(1, d + 1))
    moduli = primes_below(2**31 - 1, 2 * bound)

    def run(batches):
        for b in batches:
            taken = b.column("p").to_pylist()
            found = [characteristic_mod(np.array([[v % p for v in row] for row in m], np.int64), p) for p in taken]
            yield pa.record_batch([b.column("p"), pa.array(found, pa.list_(pa.int64()))], names=["p", "coefficients"])

    dealt = spark.createDataFrame([(p, k // PRIMES) for k, p in enumerate(moduli)], "p long, part long")
    dealt = dealt.repartition(min(partitions(spark), -(-len(moduli) // PRIMES)), "part").select("p")
    residues = {r["p"]: r["coefficients"] for r in dealt.mapInArrow(run, "p long, coefficients array<long>").collect()}
    whole = reduce(lambda a, b: a * b, moduli)
    parts = [(whole // p) * pow(whole // p, -1, p) for p in moduli]
    out = []
    for k in range(d + 1):
        c = sum(part * residues[p][k] for p, part in zip(moduli, parts, strict=True)) % whole
        out.append(c - whole if c > whole // 2 else c)
    return out


def _roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """Number of roots above ``at / 2**bits``, with multiplicity; all roots must be real."""
    d = len(coefficients) - 1
    # q(t) = 2**(bits * d) * p(t / 2**bits) has whole coefficients and roots 2**bits times as large
    q = [c << (bits * (d - k)) for k, c in enumerate(coefficients)][::-1]
    signs = []
    for low in range(d + 1):
        for k in range(1, d + 1 - low):
            q[k] += q[k - 1] * at
        signs.append(q[d - low])
    signs = [s > 0 for s in signs if s]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(coefficients: list[int], at: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(coefficients):
        value = value * at + (c << scale)
        scale += bits
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], k: int) -> list[tuple[Fraction, int]]:
    """The ``k`` largest positive roots by falling size as ``(root, multiplicity)``.

    A multiplicity may lead past ``k``.  Roots are right to ``ROOT_BITS`` bits below the
    largest possible one; equal so far counts as one.
    """
    while coefficients and coefficients[0] == 0:  # roots at zero
        coefficients = coefficients[1:]
    d = len(coefficients) - 1
    if d < 1:
        return []
    k = min(k, d)
    top = -coefficients[-2]  # sum of all roots
    bits = max(0, ROOT_BITS - top.bit_length())
    # (low, high], roots above low less roots above high
    work, found, got = [(0, top << bits, d, 0)], [], 0
    while work and got < k:
        low, high, above_low, above_high = work.pop()
        while True:
            inside = above_low - above_high
            if inside == 1:  # signs of the polynomial alone lead on
                side = _sign(coefficients, high, bits)
                if side:
                    while high - low > 1:
                        mid = (low + high) // 2
                        s = _sign(coefficients, mid, bits)
                        low, high = (low, mid) if s in (side, 0) else (mid, high)
                else:
                    low = high - 1
            if high - low <= 1:
                found.append((Fraction(high, 1 << bits), inside))
                got += inside
                break
            mid = (low + high) // 2
            above = _roots_above(coefficients, mid, bits)
            if above > above_high:
                if above_low > above:
                    work.append((low, mid, above_low, above))
                low, above_low = mid, above
            else:
                high = mid
    return found


def _solve(lu, order, b):
    """Solution of the factored system for a list of right sides."""
    d = len(lu)
    out = []
    for side in b:
        y = [side[i] for i in order]
        for i in range(d):
            y[i] -= sum((lu[i][j] * y[j] for j in range(i)), Decimal(0))
        for i in reversed(range(d)):
            y[i] = (y[i] - sum((lu[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
        out.append(y)
    return out


def _factor(a, tiny):
    """LU factors with row exchanges; a pivot of zero becomes ``tiny``."""
    a, d = [row[:] for row in a], len(a)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        if not a[k][k]:
            a[k][k] = tiny
        pivot, top = a[k][k], a[k]
        for i in range(k + 1, d):
            if a[i][k]:
                f = a[i][k] = a[i][k] / pivot
                row = a[i]
                for j in range(k + 1, d):
                    row[j] -= f * top[j]
    return a, order


def _orthonormal(vectors):
    out = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot = sum(a * b for a, b in zip(u, v, strict=True))
                v = [a - dot * b for a, b in zip(v, u, strict=True)]
        size = sum(a * a for a in v).sqrt()
        out.append([a / size for a in v])
    return out


def null_vectors(m: list[list[int]], root: Fraction, multiplicity: int) -> list[list[float]]:
    """Orthonormal null vectors of ``m - root``, first large entry positive."""
    d = len(m)
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = [[Decimal(m[i][j]) - (shift if i == j else 0) for j in range(d)] for i in range(d)]
        lu, order = _factor(a, shift.scaleb(-DIGITS))
        start = np.random.default_rng(d).integers(1, 1000, size=(multiplicity, d)).tolist()
        vectors = _orthonormal([[Decimal(v) for v in row] for row in start])
        for _ in range(3):
            vectors = _orthonormal(_solve(lu, order, vectors))
        found = [[float(v) for v in row] for row in vectors]
    return [[s * x for x in v] for v in found for s in [1.0 if max(v, key=abs) > 0 else -1.0]]


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Whitening learned from distinct whole vectors ``x``; None without any variance."""
    spark = vectors.sparkSession
    n, sums, m = _scatter(vectors)
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return None
    rows, roots = [], []
    for root, count in largest_roots(characteristic(spark, m), components):
        rows += null_vectors(m, root, count)
        roots += [root] * count
    rows, roots = rows[:components], roots[:components]
    return Whitening(n, sums, np.array(rows), np.array([float(r / n**2) for r in roots]), np.array([float(r / trace) for r in roots]))


def _project(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int]]:
    """Whitened rows, and the sums of squares of ``n x - S``, exact."""
    peak = max(int(np.abs(x).max(initial=0)) * w.n + max(map(abs, w.sums)), 1)
    if peak * peak * x.shape[1] < 2**63:
        away = x * w.n - np.array(w.sums, np.int64)
        squares = (away * away).sum(axis=1).tolist()
    else:
        away = x.astype(object) * w.n - np.array(w.sums, object)
        squares = (away * away).sum(axis=1).tolist()
    return (away / w.n).astype(np.float64) @ w.components.T / np.sqrt(w.variances), squares


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """``(id_col, n, deviation, whitened, explained, identity_error)`` per usable row.

    ``whitened`` and ``explained`` are arrays over the components by falling variance;
    ``deviation`` is the sum of squares of ``n x - S``, a whole decimal.
    """
    rows = integers(df, id_col, vec_col)
    distinct, _ = spool(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"
    if model is None:
        empty = df.sparkSession.createDataFrame([], schema + ", identity_error double")
        return empty.withColumnRenamed("id", id_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                y, squares = _project(_matrix(b.column(1)), model)
                squares = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                fixed = [pa.array([v] * b.num_rows) for v in (model.n, model.explained.tolist())]
                yield pa.record_batch([b.column(0), fixed[0], squares, pa.array(y.tolist(), pa.list_(pa.float64())), fixed[1]], names=["id", "n", "deviation", "whitened", "explained"])

    def projected(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(_project(_matrix(b.column(0)), model)[0].tolist(), pa.list_(pa.float64()))], names=["whitened"])

    k = len(model.variances)
    again = distinct.mapInArrow(projected, "whitened array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    off = again.agg(*(F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(max(off))).withColumnRenamed("id", id_col)
