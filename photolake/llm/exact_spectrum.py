"""Eigenvalues and eigenvectors of a symmetric matrix of whole numbers without negative eigenvalues, without rounding
until the end.

The characteristic polynomial is computed modulo many primes (each a row of a Spark table: Hessenberg form, then the
recurrence over its leading blocks) and put together by Chinese remaindering. As all its roots are real, the number of
those above a point is exactly the number of sign changes after a shift to it, which isolates the largest ones by
bisection. Components are null vectors of the matrix less a root, by inverse iteration with many digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bits of a root's place, relative to the trace: roots that lie closer count as one of several multiplicities.
ROOT_BITS = 240
#: Digits of the inverse iteration; they exceed what the bits of a root ask for.
DIGITS = 160


def is_prime(n: int) -> bool:
    """For odd n below 2**32, by strong probable primes to the bases 2, 7 and 61."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, from the largest, whose product exceeds ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo a prime below 2**31, the leading 1 first."""
    h = (matrix % p).astype("int64")
    n = len(h)
    for k in range(n - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        r = k + 1 + int(pivots[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        for i in np.flatnonzero(u):
            h[:, k + 1] = (h[:, k + 1] + h[:, k + 2 + i] * u[i]) % p
    blocks = np.zeros((n + 1, n + 1), "int64")  # blocks[k]: polynomial of the leading k rows, constant first
    blocks[0, 0] = 1
    for k in range(1, n + 1):
        now = np.roll(blocks[k - 1], 1)
        now = (now - h[k - 1, k - 1] * blocks[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            now = (now - int(h[k - i - 1, k - 1]) * below % p * blocks[k - i - 1]) % p
        blocks[k] = now
    return blocks[n][::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), the leading 1 first, exactly.

    The matrix must have no negative eigenvalues: then a coefficient is at most comb(d, k) * (trace / d) ** k, and
    twice that bounds the primes that are needed. One prime is one row of work; only its d + 1 residues come back.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1)) + 1
    primes = primes_beyond(bound)
    text = [[str(x) for x in row] for row in matrix]

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(x) for x in row] for row in text], object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([polynomial_mod(whole, p) for p in ps], pa.list_(pa.int64()))], ["p", "residues"])

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(max(1, min(len(primes), spark.sparkContext.defaultParallelism)))
    got = {r.p: r.residues for r in table.mapInArrow(residues, "p long, residues array<long>").collect()}
    product = 1
    for p in primes:
        product *= p
    lifts = [(p, product // p * pow(product // p, -1, p)) for p in primes]
    sums = [sum(got[p][k] * lift for p, lift in lifts) % product for k in range(d + 1)]
    return [x - product if x > product // 2 else x for x in sums]


def changes_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only lie above num / 2**bits, each with its multiplicity."""
    d = len(poly) - 1
    c = [a << bits * i for i, a in enumerate(poly)]  # the roots times 2**bits
    for i in range(d):  # shift by num
        for j in range(1, d + 1 - i):
            c[j] += c[j - 1] * num
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], num: int, bits: int) -> int:
    value = 0
    for i, a in enumerate(poly):
        value = value * num + (a << bits * i)
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], trace: int, count: int) -> list[tuple[int, int]]:
    """The ``count`` largest positive roots by falling size, as (num, bits): the root lies within 2**-bits above num / 2**bits.

    Sign changes isolate a root; then the sign of the polynomial alone tells its side. Roots of several multiplicities
    keep being counted, and come as often.
    """
    high = max(1, trace).bit_length()
    bits = max(0, ROOT_BITS - high)
    d = len(poly) - 1
    zeros = 0
    while zeros < d and poly[d - zeros] == 0:
        zeros += 1
    found: list[tuple[int, int]] = []
    for k in range(1, min(count, d - zeros) + 1):
        if found and found[-1][2] >= k:
            found.append(found[-1])
            continue
        lo, hi, at, above_lo, above_hi = 0, 1 << high, 0, d - zeros, 0  # (lo, hi] / 2**at holds the k-th largest root
        while at < bits or hi - lo > 1:
            if hi - lo == 1:
                lo, hi, at = 2 * lo, 2 * hi, at + 1
            mid = (lo + hi) // 2
            if above_lo - above_hi == 1:
                # one simple root inside: the sign beyond it is that of the roots above
                side = sign_at(poly, mid, at)
                more = side != 0 and (side < 0) == (above_hi % 2 == 0)
                n = above_lo if more else above_hi
            else:
                n = changes_above(poly, mid, at)
                more = n >= k
            if more:
                lo, above_lo = mid, n
            else:
                hi, above_hi = mid, n
        found.append((lo, at, above_lo))
    return [(lo, at) for lo, at, _ in found]


def eigenvectors(matrix: list[list[int]], roots: list[tuple[int, int]]) -> np.ndarray:
    """Unit null vectors of the matrix less each root, as rows; those of one root are orthogonal to each other.

    Inverse iteration: an elimination with pivots of the whole matrix less the root, then solutions for vectors that
    are made orthogonal to the earlier ones, until they settle.
    """
    d = len(matrix)
    vectors: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS
        context.Emax, context.Emin = 10**9, -(10**9)
        scale = Decimal(max(1, sum(matrix[i][i] for i in range(d))))
        tiny = Decimal(10) ** (-DIGITS // 2)
        for num, bits in roots:
            root = Decimal(num) / Decimal(2) ** bits
            a = np.array([[Decimal(matrix[i][j]) - (root if i == j else 0) for j in range(d)] for i in range(d)], object) / scale
            order, factors = np.arange(d), []
            for k in range(d):
                r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
                a[[k, r]], order[[k, r]] = a[[r, k]], order[[r, k]]
                for f in factors:
                    f[[k, r]] = f[[r, k]]
                if abs(a[k, k]) < tiny:
                    a[k, k] = tiny
                f = np.array([Decimal(0)] * d, object)
                f[k + 1 :] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k:] = a[k + 1 :, k:] - np.outer(f[k + 1 :], a[k, k:])
                factors.append(f)
            x = np.array([Decimal(1) / (i + 1 + len(vectors)) + Decimal((i * 7919 + 13 * len(vectors)) % 31) / 31 for i in range(d)], object)
            before = None
            for _ in range(12):
                for v in vectors:
                    x = x - v * (v @ x)
                x = x / (x @ x).sqrt()
                if before is not None and min(max(abs(x - before)), max(abs(x + before))) < Decimal(10) ** -40:
                    break
                before, y = x, x[order].copy()
                for k in range(d):
                    y = y - factors[k] * y[k]
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1 :] @ y[k + 1 :] if k + 1 < d else 0)) / a[k, k]
                x = y
            for v in vectors:
                x = x - v * (v @ x)
            vectors.append(x / (x @ x).sqrt())
        return np.array([[float(e) for e in v] for v in vectors], float).reshape(len(vectors), d)
