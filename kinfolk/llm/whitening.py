"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Every entry c becomes the integer x = floor(scale * c) + offset. Sums and products of the x are exact, so n times the scatter, A = n * sum(x x') - S S' (n squared times
the covariance V, centred), is a matrix of integers. Its characteristic polynomial is taken modulo as many 31-bit primes as its coefficients need, by reduction to
Hessenberg form, a few primes to a task; Chinese remaindering puts the coefficients together. A has real eigenvalues only, so the sign changes in the
coefficients of p(x + a) count those above a exactly (Descartes): bisection isolates them, with their multiplicities, and goes on until they are known to
PRECISION bits. The components are null vectors of A - e: inverse iteration in DIGITS decimal digits, one task for each set of equal eigenvalues.

Tasks send sums of d(d+1)/2 products, primes' d+1 coefficients and components of d entries to the driver (d: the vectors' length), never rows; A and the
components are broadcast. All grow with d only.

Cases: a vector that is null or empty, holds null or non-finite entries, or entries whose |scale * c| reaches 2^40 (beyond exact sums) takes no part; nor do vectors of
another length than most have (ties: the longer). Repeated rows and null ids are rows like others. Components of eigenvalue 0 (constant dimensions, fewer vectors than
dimensions, equal vectors) cannot be whitened and are left out, so a table of equal vectors, or an empty one, gives no rows. Equal eigenvalues have orthonormal
components of their common space. A `deviation` beyond a long is null. Columns but the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, shuffle_partitions

#: Entries (times scale) from here on would not leave room for exact sums of products over 2^46 rows in 38 decimal digits.
LARGEST = 1 << 40
#: Bits to which eigenvalues are found, relative to themselves; digits in which null vectors are solved for.
PRECISION, DIGITS = 200, 70
#: Primes that one task takes at a time.
PRIMES_AT_ONCE = 16


@dataclass(frozen=True)
class Moments:
    """Of the fit list: vectors, entries, sums of x - offset, and A."""

    n: int
    d: int
    sums: tuple[int, ...]
    scatter: tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Component:
    number: int
    eigenvalue: float  # of V
    explained: float
    vector: tuple[float, ...]


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """id, embedding of the rows that take part."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LARGEST))
    some = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine)).select("vec_id", "embedding")
    sizes = some.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return some.where(F.size("embedding") == (most.d if most else 0))


def _integers(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """floor(scale * c), a row for each vector."""
    column = batch.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y, exact, as Python integers: in floating point where every sum stays below 2^53, in 64 bits below 2^63, else by halves of the entries."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    high, low = y >> 20, y & ((1 << 20) - 1)
    cross = (high.T @ low).astype(object)
    return ((high.T @ high).astype(object) << 40) + ((cross + cross.T) << 20) + (low.T @ low).astype(object)


def moments(vectors: DataFrame, scale: int) -> Moments | None:
    """Sums of the vectors and their products, added up in each task, then over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                y = _integers(batch.slice(first, 4096), scale)
                n += len(y)
                s = y.sum(axis=0).astype(object) + (0 if s is None else s)
                p = _products(y) + (0 if p is None else p)
        if n:
            rows = [n, *s, *p[np.triu_indices(len(s))]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([Decimal(int(v)) for v in rows], pa.decimal128(38, 0))], ["k", "v"])

    parts = vectors.select("embedding").mapInArrow(partial, "k int, v decimal(38, 0)").groupBy("k").agg(F.sum("v").alias("v"))
    found = {r.k: int(r.v) for r in parts.collect()}
    if not found:
        return None
    n = found[0]
    d = (math.isqrt(9 + 8 * (len(found) - 1)) - 3) // 2  # len = 1 + d + d(d+1)/2
    s = [found[1 + i] for i in range(d)]
    a = [[0] * d for _ in range(d)]
    k = 1 + d
    for i in range(d):
        for j in range(i, d):
            a[i][j] = a[j][i] = n * found[k] - s[i] * s[j]
            k += 1
    return Moments(n, d, tuple(s), tuple(map(tuple, a)))


def primes_below(top: int, product: int) -> list[int]:
    """The largest primes below `top` (at most 2^31) whose product passes `product`."""

    def prime(p: int) -> bool:  # these four bases decide below 3,215,031,751
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        return all(pow(b, odd, p) == 1 or any(pow(b, odd << i, p) == p - 1 for i in range(twos)) for b in (2, 3, 5, 7))

    found, reached, p = [], 1, top - 1 - top % 2
    while reached <= product:
        if prime(p):
            found.append(p)
            reached *= p
        p -= 2
    return found


def polynomial_modulo(a: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Coefficients, constant first, of det(x - A) modulo each prime; a: A modulo each."""
    h = np.stack(a)
    p = np.array(primes, np.int64)
    d = h.shape[1]
    by_row, by_matrix = p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        pivots = np.zeros(len(primes), np.int64)
        for i in np.flatnonzero(h[:, m, m - 1] == 0):  # another row (and column) with an entry to divide by
            rows = np.flatnonzero(h[i, m + 1 :, m - 1])
            if len(rows):
                other = m + 1 + rows[0]
                h[i, [m, other]] = h[i, [other, m]]
                h[i][:, [m, other]] = h[i][:, [other, m]]
        for i, (x, q) in enumerate(zip(h[:, m, m - 1].tolist(), primes, strict=True)):
            pivots[i] = pow(x, -1, q) if x else 0  # all zero below as well: nothing to clear
        u = h[:, m + 1 :, m - 1] * pivots[:, None] % by_row
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m : m + 1] % by_matrix) % by_matrix
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % by_matrix).sum(axis=2)) % by_row
    # determinants of x - H for the leading 0, 1, 2, ... rows and columns
    polys = np.zeros((d + 1, len(primes), d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        last = polys[k - 1]
        new = np.roll(last, 1, axis=1)
        new = (new - h[:, k - 1, k - 1][:, None] * last) % by_row
        below = np.ones(len(primes), np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            new = (new - (h[:, k - 1 - i, k - 1] * below % p)[:, None] * polys[k - 1 - i]) % by_row
        polys[k] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: tuple[tuple[int, ...], ...]) -> list[int]:
    """Coefficients, constant first, of det(x - A) for a positive semidefinite A of integers. The k-th sum of products of its eigenvalues is at most binomial(d, k) (trace / d)^k, below (1 + trace)^d."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    primes = primes_below(1 << 31, 2 * (1 + trace) ** d)
    shared = spark.sparkContext.broadcast(a)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.array(shared.value, dtype=object)
        for batch in batches:
            mine = batch.column("p").to_pylist()
            for first in range(0, len(mine), PRIMES_AT_ONCE):
                some = mine[first : first + PRIMES_AT_ONCE]
                rows = polynomial_modulo([(matrix % q).astype(np.int64) for q in some], some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(len(primes) // PRIMES_AT_ONCE, shuffle_partitions(spark)))
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(reduced, "p long, c array<long>").collect()
    product, values = 1, [0] * (d + 1)
    for row in sorted(found):
        inverse = pow(product, -1, row.p)
        values = [v + product * ((c - v) * inverse % row.p) for v, c in zip(values, row.c, strict=True)]
        product *= row.p
    return [v if 2 * v < product else v - product for v in values]


def _above(coefficients: list[int], m: int, t: int) -> int:
    """How many roots of the polynomial, all real, lie above m / 2^t: the sign changes in its coefficients once it is moved there."""
    d = len(coefficients) - 1
    c = [v << (t * (d - k)) for k, v in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += m * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _positive(coefficients: list[int], m: int, t: int) -> int:
    """The sign of the polynomial at m / 2^t."""
    value, d = 0, len(coefficients) - 1
    for k in range(d, -1, -1):
        value = value * m + (coefficients[k] << (t * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], most: int, precision: int = PRECISION) -> list[tuple[int, int, int]]:
    """(m, t, multiplicity) of the `most` largest positive roots m / 2^t, falling; coefficients of a polynomial with real roots, none negative. Equal ones (to `precision` bits) are one entry."""
    zeros = next(i for i, v in enumerate(coefficients) if v)
    c = coefficients[zeros:]
    d = len(c) - 1
    top = -c[-2] + 1 if d else 1  # the roots' sum and one
    out, waiting, found = [], [(0, top, 0, d, 0)], 0  # low, high, t, roots above low, roots above high
    while waiting and found < min(most, d):
        low, high, t, above_low, above_high = waiting.pop()
        k = above_low - above_high
        if not k:
            continue
        left_sign = _positive(c, low, t) if k == 1 else 0
        while low == 0 or (high - low) << precision > low:
            low, high, t = 2 * low, 2 * high, t + 1
            mid = (low + high) // 2
            if k == 1 and left_sign:  # its sign alone tells on which side the one root is
                sign = _positive(c, mid, t)
                if not sign:
                    low = high = mid
                    break
                low, high = (mid, high) if sign == left_sign else (low, mid)
                continue
            above = _above(c, mid, t)
            if above_high < above < above_low:
                waiting.append((low, mid, t, above_low, above))
                low, above_low = mid, above
                waiting.append((low, high, t, above_low, above_high))
                break
            low, high = (mid, high) if above == above_low else (low, mid)
        else:
            out.append(((low + high) // 2 if (low + high) % 2 == 0 else high, t, k))
            found += k
            continue
        if low == high:
            out.append((low, t, k))
            found += k
    return out


def null_vectors(a: tuple[tuple[int, ...], ...], m: int, t: int, k: int) -> list[list[float]]:
    """k orthonormal eigenvectors of A for its eigenvalue m / 2^t, found by inverse iteration; the largest entry is positive."""
    d = len(a)
    with localcontext(Context(prec=DIGITS)):
        root = Decimal(m) / (Decimal(2) ** t)
        rows = [[Decimal(v) for v in row] for row in a]
        tiny = (max(abs(v) for row in rows for v in row) or Decimal(1)) * Decimal(10) ** (-DIGITS)
        for i in range(d):
            rows[i][i] -= root
        order = list(range(d))
        for j in range(d):  # upper triangle and factors in place
            best = max(range(j, d), key=lambda i: abs(rows[i][j]))
            rows[j], rows[best], order[j], order[best] = rows[best], rows[j], order[best], order[j]
            if abs(rows[j][j]) < tiny:
                rows[j][j] = tiny
            head, pivot = rows[j][j + 1 :], rows[j][j]
            for i in range(j + 1, d):
                f = rows[i][j] / pivot
                rows[i][j] = f
                if f:
                    rows[i][j + 1 :] = [x - f * y for x, y in zip(rows[i][j + 1 :], head, strict=True)]
        found: list[list[Decimal]] = []
        for number in range(k):
            v = [Decimal((7919 * (i + 1) * (number + 1) + number * i * i) % 1009 + 1) for i in range(d)]
            for _ in range(4):
                for w in found:
                    along = sum(x * y for x, y in zip(v, w, strict=True))
                    v = [x - along * y for x, y in zip(v, w, strict=True)]
                v = [v[i] for i in order]
                for i in range(d):
                    v[i] -= sum(x * y for x, y in zip(rows[i][:i], v[:i], strict=True))
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - sum(x * y for x, y in zip(rows[i][i + 1 :], v[i + 1 :], strict=True))) / rows[i][i]
                long = max(abs(x) for x in v)
                v = [x / long for x in v]
            for _ in range(2):
                for w in found:
                    along = sum(x * y for x, y in zip(v, w, strict=True))
                    v = [x - along * y for x, y in zip(v, w, strict=True)]
                norm = sum(x * x for x in v).sqrt()
                v = [x / norm for x in v]
            found.append(v)
        signed = [[-x for x in v] if max(v, key=abs) < 0 else v for v in found]
        return [[float(x) for x in v] for v in signed]


def components(spark: SparkSession, fit: Moments, most: int) -> list[Component]:
    """Of the `most` largest eigenvalues above 0, falling."""
    trace = sum(fit.scatter[i][i] for i in range(fit.d))
    if not trace:
        return []
    roots = largest_roots(characteristic_polynomial(spark, fit.scatter), most)
    shared = spark.sparkContext.broadcast(fit.scatter)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = null_vectors(shared.value, int(row["m"]), row["t"], row["k"])
                yield pa.RecordBatch.from_arrays([pa.array([row["i"]], pa.int32()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["i", "vectors"])

    asked = spark.createDataFrame([(i, str(m), t, min(k, most)) for i, (m, t, k) in enumerate(roots)], "i int, m string, t int, k int").repartition(len(roots))
    vectors = {r.i: r.vectors for r in asked.mapInArrow(solved, "i int, vectors array<array<double>>").collect()}
    out = []
    for i, (m, t, _) in enumerate(roots):
        value = Decimal(m) / (Decimal(2) ** t)
        for v in vectors[i]:
            out.append(Component(len(out) + 1, float(value / fit.n / fit.n), float(value / trace), tuple(v)))
    return out[:most]


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row (vec_id, embedding) that takes part and each of at most `most` components.

    deviation: sum over the entries of (n x - S)^2; whitened: x - S/n along the component, over the root of its eigenvalue; explained: the eigenvalue's share of the trace;
    identity_error: how far the covariance of `whitened` is from the identity in its worst entry. `offset` moves x and S alike and cancels out of all of them.
    """
    spark = vectors.sparkSession
    shape = "vec_id " + vectors.schema["vec_id"].dataType.simpleString() + ", deviation bigint, whitened array<double>"
    used = usable(vectors, scale)
    fit = moments(used, scale)
    found = components(spark, fit, most) if fit else []
    if not found:
        none = spark.createDataFrame([], shape)
        return none.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    axes = np.array([c.vector for c in found])
    shared = spark.sparkContext.broadcast((fit.n, np.array(fit.sums, dtype=object), axes / np.sqrt([c.eigenvalue for c in found])[:, None]))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, axes = shared.value
        for batch in batches:
            y = _integers(batch, scale)
            if not len(y):
                continue
            most = int(np.abs(y).max(initial=0)) * n + max(map(abs, sums.tolist()))
            if most * most * len(sums) < 1 << 63:
                far = n * y - sums.astype(np.int64)
                deviation = (far * far).sum(axis=1).tolist()
            else:
                far = n * y.astype(object) - sums
                deviation = [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]
            w = (far.astype(np.float64) / n) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    rows = save(used.mapInArrow(projected, shape))
    k = range(len(found))
    means = rows.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in k)).first()
    centred = [F.col("whitened")[i] - F.lit(means[i]) for i in k]
    spread = rows.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in k for j in k if i <= j)).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(spread, [(i, j) for i in k for j in k if i <= j], strict=True))
    shares = F.array(*(F.lit(c.explained) for c in found))
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
