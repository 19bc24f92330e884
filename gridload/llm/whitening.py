"""Whitening of integer vectors by the exact characteristic polynomial of their scatter matrix.

Components become integers x = floor(scale * c). With n vectors x and sums S the scatter n * sum(x x') - S S' is an
integer matrix, n^2 times the covariance; tasks add up its parts exactly and Spark sums them. Its characteristic
polynomial is found modulo many primes (Hessenberg reduction, the primes are rows that Spark deals to tasks) and put
together by Chinese remainders. All its roots are real and not negative, so the sign changes of a shifted
polynomial count the roots above a point exactly, with multiplicity: bisection isolates the largest roots, further
bisection refines them far beyond double precision. Components are null vectors of (scatter - root), found by inverse
iteration in long decimals, each orthogonal to the ones before, so repeated roots get a basis of their space.

A constant added to every x changes none of the results, so none is added here. The driver holds only the matrix (the
square of the vector length), the polynomial and one residue row per prime, whatever the number of vectors; the exact
steps grow with the fourth power of the length, which suits lengths of a few hundred.

Vectors that are null, hold null or non-finite components, or have another length than most take no part; a null id
is kept, repeated rows count and come back once each. Entries beyond 2^62 in size become 2^62. Only components with a
positive root exist: fewer than asked where vectors are short or dependent, none (and so no rows) for equal vectors or
an empty table. Equal roots have no order: their components are some basis, the same for all rows. Signs: the
largest coordinate is positive. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm.common import stage
from gridload.llm.vectors import doubles, finite, matrix, scaled_floor, usual_width

MOST = 1 << 62
#: Bits of a sum's part, bits of a factor's part (products of two over ROWS rows are exact in doubles).
LIMB, HALF, ROWS = 32, 20, 4096
#: Bits to which roots are refined, relative to the smallest one asked for; digits of the null vectors' arithmetic.
ROOT_BITS, DIGITS = 160, 110


@dataclass
class Fit:
    n: int
    sums: list[int]
    #: Components by falling root: unit vectors, roots over n^2 (eigenvalues of the covariance), shares of the trace.
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts p with x = sum p_k 2^(HALF k), all but the last below 2^HALF, as doubles."""
    out, rest = [], x
    while True:
        if not len(rest) or np.abs(rest).max() < 1 << HALF:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << HALF) - 1)).astype(np.float64))
        rest = rest >> HALF


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of a matrix of longs, exact, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for lo in range(0, len(x), ROWS):
        parts = _limbs(x[lo: lo + ROWS])
        for a, p in enumerate(parts):
            for b, q in enumerate(parts):
                total = total + (p.T @ q).astype(np.int64).astype(object) * (1 << HALF * (a + b))
    return total


def _exact_sums(rows: DataFrame, width: int, scale: float) -> tuple[int, list[int], list[list[int]]]:
    """Row count, sums and x' x of the vectors (column vec), all exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for b in batches:
            x = scaled_floor(matrix(b.column(0), width), scale, MOST)
            n, square = n + len(x), square + gram(x)
            for lo in range(0, len(x), ROWS):
                sums = sums + sum((p.sum(axis=0).astype(np.int64).astype(object) << HALF * k) for k, p in enumerate(_limbs(x[lo: lo + ROWS])))
        if not n:
            return
        cells = [(-1, -1, n), *((-1, j, int(v)) for j, v in enumerate(sums)),
                 *((i, j, int(square[i, j])) for i in range(width) for j in range(i, width))]
        out = []
        for i, j, v in cells:  # a cell as parts of LIMB bits with its sign, so that longs can add up any number of tasks
            sign, v, k = (-1 if v < 0 else 1), abs(v), 0
            while v or not k:
                out.append((i, j, k, sign * (v & ((1 << LIMB) - 1))))
                v, k = v >> LIMB, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["i", "j", "k", "v"])

    added = rows.select("vec").mapInArrow(run, "i int, j int, k int, v bigint").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    cell: dict[tuple[int, int], int] = {}
    for r in added:
        cell[r.i, r.j] = cell.get((r.i, r.j), 0) + (r.v << LIMB * r.k)
    if not cell:
        return 0, [0] * width, [[0] * width for _ in range(width)]
    return (cell[-1, -1], [cell.get((-1, j), 0) for j in range(width)],
            [[cell.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)])


def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2^32."""
    if p % 2 == 0:
        return p == 2
    s = ((p - 1) & -(p - 1)).bit_length() - 1
    for a in (2, 7, 61):
        y = pow(a, (p - 1) >> s, p)
        if a % p and y not in (1, p - 1) and all((y := y * y % p) != p - 1 for _ in range(s - 1)):
            return False
    return True


def _primes(bound: int) -> list[int]:
    """Primes below 2^31, falling, whose product is over ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of the characteristic polynomial modulo a prime below 2^31."""
    h, d = a % p, len(a)
    for k in range(d - 2):  # similar matrix with nothing below the first subdiagonal
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        h[[k + 1, pivot]] = h[[pivot, k + 1]]
        h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, dtype=np.int64)
        new[1:] = polys[k, :-1]
        new = (new - h[k, k] * polys[k]) % p
        run = 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            new = (new - int(h[i, k]) * run % p * polys[i]) % p
        polys[k + 1] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact coefficients (constant first) for a matrix whose roots are all real and not negative."""
    d = len(a)
    mean = -(-sum(a[i][i] for i in range(d)) // d)
    # the k-th coefficient sums the products of k roots: at most comb(d, k) times the mean root to the k-th
    primes = _primes(2 * max(math.comb(d, k) * mean ** k for k in range(d + 1)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            rest = [polynomial_mod(np.array([[v % p for v in row] for row in a], dtype=np.int64), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rest, pa.list_(pa.int64()))], names=["p", "rest"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    value, modulus = [0] * (d + 1), 1
    for r in dealt.mapInArrow(run, "p bigint, rest array<bigint>").collect():  # one row per prime: follows the matrix, not the rows
        inverse = pow(modulus, -1, r.p)
        value = [v + modulus * ((c - v) * inverse % r.p) for v, c in zip(value, r.rest)]
        modulus *= r.p
    return [v - modulus if v > modulus // 2 else v for v in value]


def _shifted_changes(poly: list[int], at: int) -> int:
    """Sign changes of poly(x + at): the number of roots above ``at`` when all are real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value_sign(poly: list[int], at: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * at + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], most: int) -> list[Fraction]:
    """Up to ``most`` largest positive roots, falling, repeated by multiplicity, of a monic polynomial of real roots >= 0."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    degree = len(poly) - 1
    most = min(most, degree)
    if not most:
        return []
    top = -poly[-2]  # the sum of the roots
    bits = ROOT_BITS
    while True:
        fine = [c << bits * (degree - k) for k, c in enumerate(poly)]  # roots times 2^bits
        changes: dict[int, int] = {}

        def above(t: int) -> int:
            if t not in changes:
                changes[t] = _shifted_changes(fine, t)
            return changes[t]

        found = []
        for j in range(1, most + 1):
            lo = max((t for t, c in changes.items() if c >= j), default=0)
            hi = min((t for t, c in changes.items() if c < j), default=top << bits)
            while hi - lo > 1 and above(lo) - above(hi) > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if above(mid) >= j else (lo, mid)
            if above(lo) - above(hi) == 1:  # one simple root in (lo, hi]: its side is read from the sign
                sign_above = 1 if above(hi) % 2 == 0 else -1
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    s = _value_sign(fine, mid)
                    lo, hi = (lo, mid) if s in (0, sign_above) else (mid, hi)
            found.append(hi)
        if found[-1] >> ROOT_BITS // 2:  # the least one is known to enough bits of its own
            return [Fraction(v, 1 << bits) for v in found]
        bits *= 2


def _null_vectors(a: list[list[int]], roots: list[Fraction]) -> np.ndarray:
    """Unit vectors, one per root, by inverse iteration; each orthogonal to the ones before."""
    d, out = len(a), []
    with localcontext(Context(prec=DIGITS)):
        size = Decimal(max(abs(v) for row in a for v in row))
        tiny = size.scaleb(10 - DIGITS)

        def unit(v):
            for u in out:
                dot = sum(x * y for x, y in zip(u, v))
                v = [y - dot * x for x, y in zip(u, v)]
            length = sum(x * x for x in v).sqrt()
            return [x / length for x in v]

        for j, root in enumerate(roots):
            shift = Decimal(root.numerator) / Decimal(root.denominator)
            m = [[Decimal(v) for v in row] for row in a]
            for i in range(d):
                m[i][i] -= shift
            order, factors = list(range(d)), []
            for k in range(d):  # triangular factors with row exchanges
                p = max(range(k, d), key=lambda i: abs(m[i][k]))
                m[k], m[p], order[k], order[p] = m[p], m[k], order[p], order[k]
                if abs(m[k][k]) < tiny:
                    m[k][k] = tiny
                head = m[k]
                for i in range(k + 1, d):
                    if m[i][k]:
                        f = m[i][k] / head[k]
                        m[i] = [*m[i][:k], f, *[x - f * y for x, y in zip(m[i][k + 1:], head[k + 1:])]]
            v = unit([Decimal(1 + (i * 7919 + j * 104729 + 17) % 1009) for i in range(d)])
            for _ in range(4):
                y = [v[order[i]] for i in range(d)]
                for i in range(d):
                    y[i] -= sum(m[i][k] * y[k] for k in range(i))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum(m[i][k] * y[k] for k in range(i + 1, d))) / m[i][i]
                v = unit(y)
            big = max(range(d), key=lambda i: (abs(v[i]).quantize(Decimal("1e-20")), -i))
            out.append(v if v[big] > 0 else [-x for x in v])
        return np.array([[float(x) for x in v] for v in out]).reshape(len(out), d)


def fit(vectors: DataFrame, width: int, scale: float, components: int) -> Fit:
    """The components of the rows (column vec: doubles, all of length ``width``)."""
    n, sums, square = _exact_sums(vectors, width, scale)
    scatter = [[n * square[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    trace = sum(scatter[i][i] for i in range(width))
    if not trace:
        return Fit(n, sums, np.zeros((0, width)), np.zeros(0), np.zeros(0))
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, scatter), components)
    return Fit(n, sums, _null_vectors(scatter, roots), np.array([float(r / (n * n)) for r in roots]), np.array([float(r / trace) for r in roots]))


def _apply(rows: DataFrame, width: int, scale: float, model: Fit, id_type: str) -> DataFrame:
    """id, deviation, whitened for the rows (id, vec)."""
    n, d = model.n, width
    mean = np.array([float(Fraction(s, n)) for s in model.sums])
    basis = model.vectors.T / np.sqrt(model.values)
    sums = np.array(model.sums, dtype=object)
    square = sum(s * s for s in model.sums)
    most_sum = max(abs(s) for s in model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled_floor(matrix(b.column(1), d), scale, MOST)
            high = int(np.abs(x).max(initial=0))
            kind = np.int64 if max(high, most_sum) * max(high, 1) * d < 1 << 63 else object  # longs while they can't overflow
            y = x.astype(kind)
            norms, along = (y * y).sum(axis=1).tolist(), (y @ sums.astype(kind)).tolist()
            far = [n * n * int(a) - 2 * n * int(s) + square for a, s in zip(norms, along)]
            far = [Decimal(v) if v < 10 ** 38 else None for v in far]
            white = (x.astype(np.float64) - mean) @ basis
            off = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(far, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(off), pa.array(white.reshape(-1)))],
                names=["id", "deviation", "whitened"])

    return rows.select("id", "vec").mapInArrow(run, f"id {id_type}, deviation decimal(38,0), whitened array<double>")


def _identity_error(rows: DataFrame, m: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    at: list[Column] = [F.col("whitened")[i] for i in range(m)]
    mean = list(rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]).first())
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    cov = rows.agg(*[F.avg((at[i] - F.lit(mean[i])) * (at[j] - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024,
           components: int = 8) -> tuple[DataFrame, Fit, float | None]:
    """Rows (id, deviation: sum of (n x - S)^2, null beyond 38 digits; whitened: one double per component), the fit,
    and the identity error (None without components)."""
    rows = vectors.where(finite(vec_col)).select(F.col(id_col).alias("id"), doubles(vec_col).alias("vec"))
    id_type = rows.schema["id"].dataType.simpleString()
    width, _ = usual_width(rows, "vec")
    rows = rows.where(F.size("vec") == width)
    model = fit(rows, width, scale, components) if width else Fit(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    if not len(model.values):
        empty = vectors.sparkSession.createDataFrame([], f"id {id_type}, deviation decimal(38,0), whitened array<double>")
        return empty, model, None
    out = stage(_apply(rows, width, scale, model, id_type), "white-rows")
    return out, model, _identity_error(out, len(model.values))
