"""Whitening of embeddings from an exact characteristic polynomial.

Vectors become whole numbers, ``floor(64 * c) + 1000000``. Spark sums them and their products exactly
(each task adds limbs of 20 bits by matrix products that a double holds exactly, and sends its sums
once). With ``n`` vectors, sums ``S`` and products ``P`` the scatter ``M = n * P - S * S'`` is a whole
matrix and the covariance is ``M / n**2``.

1. The characteristic polynomial of ``M`` is found modulo many primes, each by reduction to Hessenberg
   form, as a Spark job over the primes, and put together by Chinese remainders. Its coefficients
   are sums of products of eigenvalues, so the trace bounds them and the number of primes.
2. All its roots are real. For such a polynomial the sign changes among the coefficients of
   ``p(x + a)`` count the roots above ``a`` exactly, so bisection over whole numbers isolates the
   largest roots, with their multiplicity, and narrows them to about 2**-100 of the trace.
3. Each root gives its component by inverse iteration into the null space of ``M - e * I``; the
   result is corrected by residuals taken in whole numbers until it is right to double precision.
   A multiple root gets an orthonormal basis of its null space.

The driver holds what depends on the dimension only: ``M``, the polynomial and the components. The
identity error is measured on the whitened rows themselves, in a pass of its own.

Defined cases: a row is left out if its vector is null, holds a null or non-finite entry, or has
another length than most vectors have (the longer one if as many have it); entries count as at most
2**62 / 64 in size. Components with eigenvalue 0 cannot be whitened and are left out, so a single
vector, equal vectors and an empty table give an empty result. Repeated rows and equal keys count
as often as they occur; a null key is kept; a ``deviation`` beyond 64 bits is null in ``whitened`` and
whole in ``deviations``; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 32
SCALE = 64
LARGEST = float(1 << 62)
LIMB, ROWS = 20, 1 << 12  # limbs below 2**19 in size: sums of 2**12 products stay below 2**50
DIGIT = 40  # sums travel as digits of 40 bits, so that 2**23 tasks can be added in a long
BITS = 100  # roots are known to 2**-100 of the trace


@dataclass
class Whitener:
    """What the vectors of a table are centred and projected with."""

    n: int
    sums: list[int]  # of the whole numbers without the 1000000, which centring takes out again
    values: list[float]  # eigenvalues of the covariance, falling
    components: np.ndarray  # one per column
    trace: float


# Sums over the table -------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Key and vector of the rows that count, and the dimension."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    # NaN compares as larger than all numbers.
    finite = F.forall(v, lambda c: c.isNotNull() & (c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & finite)
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual.d if usual else 0
    return rows.where(F.size(v) == d), d


def whole(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as whole numbers, without the shift."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """Exact ``x' x`` as Python integers."""
    limbs, rest = [], x
    while rest.any():
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low.astype(float))
        rest = (rest - low) >> LIMB
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for first in range(0, len(x), ROWS):
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                part = a[first : first + ROWS].T @ b[first : first + ROWS]
                total += part.astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _digits(value: int) -> list[int]:
    """Four digits of DIGIT bits; the highest has the sign."""
    out = []
    for _ in range(3):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _summed(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and products of the vectors."""
    names = ["i", "j", "d0", "d1", "d2", "d3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = whole(batch.column("vector"), d)
            n += len(x)
            sums = sums + (x & ((1 << 32) - 1)).sum(0).astype(object) + ((x >> 32).sum(0).astype(object) << 32)
            total = total + products(x)
        if n:
            cells = [(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums))]
            cells += [(i, j, total[i, j]) for i in range(d) for j in range(i, d)]
            out = [(i, j, *_digits(int(v))) for i, j, v in cells]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    schema = ", ".join(f"{c} long" for c in names)
    parts = rows.select("vector").mapInArrow(run, schema).groupBy("i", "j")
    cells = parts.agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()  # half of d * d, whatever the rows
    n, sums, total = 0, [0] * d, np.zeros((d, d), object)
    for i, j, *digits in cells:
        value = sum(x << DIGIT * k for k, x in enumerate(digits))
        if j < 0:
            n = value
        elif i < 0:
            sums[j] = value
        else:
            total[i, j] = total[j, i] = value
    return n, sums, total


# Characteristic polynomial -------------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3,215,031,751."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes(product: int) -> list[int]:
    """The largest primes below 2**31 whose product is larger than ``product``."""
    found, p, reached = [], (1 << 31) - 1, 1
    while reached <= product:
        if _is_prime(p):
            found.append(p)
            reached *= p
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, highest first, of the characteristic polynomial modulo a prime below 2**31."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        pivot = np.flatnonzero(h[k + 1 :, k])
        if not len(pivot):
            continue
        r = k + 1 + pivot[0]
        h[[k + 1, r]] = h[[r, k + 1]]
        h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # lowest coefficient first
    minors[0, 0] = 1
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - h[k, k] * minors[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            minors[k + 1] = (minors[k + 1] - (int(h[i, k]) * chain % p) * minors[i]) % p
    return minors[d][::-1].tolist()


def characteristic(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients, highest first, of the characteristic polynomial of a whole matrix without
    negative eigenvalues; the work is a job over the primes."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    # The k-th one is a sum of products of k eigenvalues: largest if all are the same.
    bound = max(comb(d, k) * (trace // k + 1) ** k for k in range(1, d + 1))
    needed = primes(bound)
    entries = [[int(x) for x in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                rest = np.array([[x % p for x in row] for row in entries], np.int64)
                found = polynomial_modulo(rest, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([found], pa.list_(pa.int64()))], names=["p", "found"]
                )

    tasks = min(len(needed), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in needed], "p long").repartition(tasks)
    coefficients, modulus = [0] * (d + 1), 1
    for p, found in sorted(map(tuple, table.mapInArrow(run, "p long, found array<long>").collect())):
        inverse = pow(modulus, -1, p)
        for k, rest in enumerate(found):
            rest = rest if k % 2 == 0 else -rest  # signs alternate
            coefficients[k] += modulus * ((rest - coefficients[k]) * inverse % p)
        modulus *= p
    return [c if k % 2 == 0 else -c for k, c in enumerate(coefficients)]


# Roots ---------------------------------------------------------------------------------------------


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots of a polynomial that has only real ones are larger than ``a``."""
    shifted = list(polynomial)
    for end in range(len(shifted), 1, -1):
        for k in range(1, end):
            shifted[k] += a * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(polynomial: list[int], x: int) -> int:
    total = 0
    for c in polynomial:
        total = total * x + c
    return total


def largest_roots(polynomial: list[int], trace: int, most: int = MOST) -> tuple[list[tuple[int, int]], int]:
    """(root, multiplicity) of the largest positive roots, falling, and the bits behind the point.

    Isolation counts roots on either side of whole numbers; an isolated simple root is narrowed by
    the sign of the polynomial, several ones by counting, until they part or are one to the last bit.
    """
    bits = max(BITS - trace.bit_length(), 0)
    scaled = [c << bits * k for k, c in enumerate(polynomial)]
    rank = len(scaled) - 1
    while rank and not scaled[rank]:
        rank -= 1  # roots that are 0
    scaled = scaled[: rank + 1]
    most = min(most, rank)
    top = (trace << bits) + 1
    found: list[tuple[int, int]] = []
    open_ = [(0, top, rank, 0)]  # roots above the lower and above the upper end
    while open_ and sum(m for _, m in found) < most:
        low, high, above_low, above_high = open_.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1:
            below = _value(scaled, high) > 0
            while high - low > 1:
                middle = (low + high) // 2
                if (_value(scaled, middle) > 0) == below:
                    high = middle
                else:
                    low = middle
            found.append((high, 1))
        elif high - low <= 1:
            found.append((high, count))
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            open_ += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found, bits


# Components ----------------------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: int, bits: int, size: int, rounds: int = 4) -> np.ndarray:
    """Orthonormal columns that ``matrix - root / 2**bits`` takes to nothing, in double precision."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    unit = max(trace, 1) << bits  # quotients of whole numbers are rounded once
    scaled = [[int(x) << bits for x in row] for row in matrix]
    shifted = np.array(
        [[(x - (root if i == j else 0)) / unit for j, x in enumerate(row)] for i, row in enumerate(scaled)]
    )
    # Inverse iteration; a little off the root, so that the matrix can be solved.
    near = shifted - np.eye(d) * max(abs(shifted).max(), 1e-300) * 2.0**-48
    v = np.linalg.qr(np.random.default_rng(17).standard_normal((d, size)))[0]
    for _ in range(3):
        v = np.linalg.qr(np.linalg.solve(near, v))[0]
    # Corrections at right angles to what is there, from residuals in whole numbers.
    for _ in range(rounds):
        places = [[int(x * 2.0**60) for x in column] for column in v.T]
        rest = np.empty((d, size))
        for k, column in enumerate(places):
            for i, row in enumerate(scaled):
                total = sum(a * b for a, b in zip(row, column)) - root * column[i]
                rest[i, k] = total / (unit << 60)
        bordered = np.block([[shifted, v], [v.T, np.zeros((size, size))]])
        change = np.linalg.solve(bordered, np.vstack([-rest, np.zeros((size, size))]))[:d]
        v = v + change
        lengths = np.sqrt((v * v).sum(0))
        v = v / lengths if size == 1 else np.linalg.qr(v)[0]
        if abs(change).max() < 2.0**-52:
            break
    return v


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> Whitener | None:
    """Learn from all usable rows; none if no component has an eigenvalue above 0."""
    rows, d = usable(vectors, key, vector)
    return _fitted(rows, d, most)


def _fitted(rows: DataFrame, d: int, most: int) -> Whitener | None:
    n, sums, total = _summed(rows, d) if d else (0, [], None)
    if not n:
        return None
    s = np.array(sums, object)
    scatter = total * n - np.outer(s, s)
    trace = int(sum(scatter[i, i] for i in range(d)))
    if not trace:
        return None
    roots, bits = largest_roots(characteristic(rows.sparkSession, scatter), trace, most)
    spaces = [null_space(scatter, root, bits, size) for root, size in roots]
    # A quotient of whole numbers is rounded once; the covariance has n * n below the scatter.
    values = [root / (n * n << bits) for root, size in roots for _ in range(size)]
    return Whitener(n, sums, values[:most], np.hstack(spaces)[:, :most], trace / (n * n))


# Rows ----------------------------------------------------------------------------------------------


def centred(x: np.ndarray, model: Whitener) -> np.ndarray:
    """``n * x - S``, exact: long, or Python integers where a long might not hold it."""
    largest = max(int(abs(x).max()) if x.size else 0, 1)
    if model.n * largest + max(map(abs, model.sums)) < 1 << 62:
        return x * model.n - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def project(dev: np.ndarray, model: Whitener) -> np.ndarray:
    """Whitened coordinates of centred vectors."""
    return (dev / model.n).astype(float) @ (model.components / np.sqrt(np.array(model.values)))


def squares(dev: np.ndarray) -> list[int]:
    """Exact sums of squares."""
    largest = int(abs(dev).max()) if dev.size else 0
    if largest * largest * dev.shape[1] < 1 << 63:
        return (dev * dev).sum(1).tolist()
    return (dev.astype(object) ** 2).sum(1).tolist()


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = model.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = project(centred(whole(batch.column("vector"), d), model), model)
            total[:k] += z.T @ z
            total[k] += z.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    cells = rows.select("vector").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v"))
    total = np.zeros((k + 1, k))
    for i, j, v in cells.collect():  # at most 33 * 32
        total[i, j] = v / model.n
    return float(abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and the exact squared distance from the mean times n squared, as decimal text."""
    rows, d = usable(vectors, key, vector)
    n, sums, _ = _summed(rows, d) if d else (0, [], None)
    model = Whitener(n, sums, [], np.empty((d, 0)), 0.0)
    schema = T.StructType([T.StructField(key, rows.schema["id"].dataType), T.StructField("deviation", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = squares(centred(whole(batch.column("vector"), d), model))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(str, found), pa.string())], names=[key, "deviation"])

    return rows.mapInArrow(run, schema)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """Per usable row and component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    rows, d = usable(vectors, key, vector)
    model = _fitted(rows, d, most)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [rows.schema["id"].dataType, *map(T._parse_datatype_string, "int long long double double double".split())]
    schema = T.StructType([T.StructField(c, kind) for c, kind in zip(names, kinds)])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dev = centred(whole(batch.column("vector"), d), model)
            n = len(dev)
            if not n:
                continue
            deviation = [x if x < 1 << 63 else None for x in squares(dev)]
            each = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(project(dev, model).ravel()),
                    pa.array(np.tile(np.array(model.values) / model.trace, n)),
                    pa.array(np.full(n * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)
