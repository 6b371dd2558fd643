"""Whitening of vectors along the principal components of their exact integer scatter.

Entries become integers, so the scatter matrix is exact, and so is its characteristic polynomial: modulo
many primes by Hessenberg form, one prime a row, put together by the Chinese remainder theorem. All its
roots are real, so the sign changes of the polynomial shifted to a point count the roots beyond it, which
isolates each root; signs then refine it far below a double's precision. Components are null vectors at
the roots, by inverse iteration in integers with a fixed binary point. Primes, roots and vectors are rows
that Spark spreads over tasks; the driver holds matrices of the dimension only, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, COMPONENTS = 64, 32
LARGEST = 2**62  # beyond it, an entry is this number
LIMB = 20  # bits of the parts whose products are summed exactly in doubles
ROWS = 4096  # whose products are summed at once
PART = 40  # bits of the parts in which sums travel
RELATIVE = 110  # bits to which a root is known
FRACTION = 256  # bits after the point in inverse iteration, beyond those that a small root takes
STEPS = 4  # of inverse iteration


# -- exact sums ------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & (F.size(vector) > 0)


def _entries(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of vectors of one length, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def _limbs(x: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Parts of -2**(bits - 1) to 2**(bits - 1) - 1; part k counts 2**(bits * k)."""
    parts, half = [], 1 << (bits - 1)
    while x.any():
        low = ((x + half) & ((1 << bits) - 1)) - half
        parts.append(low)
        x = (x - low) >> bits
    return parts


def _gram(x: np.ndarray) -> np.ndarray:
    """x.T @ x in Python's integers; each product of parts is exact in doubles."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    parts = [part.astype(np.float64) for part in _limbs(x)]
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper triangle of (1, x).T @ (1, x), the first row being count and sums, in parts (i, j, part, value)."""
    total = None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            x = _entries(batch.column(0).slice(start, ROWS))
            gram = _gram(np.hstack([np.ones((len(x), 1), np.int64), x]))
            total = gram if total is None else total + gram
    if total is None:
        return
    at = np.triu_indices(len(total))
    rest, part = total[at], 0
    while any(rest):
        half = 1 << (PART - 1)
        low = ((rest + half) & ((1 << PART) - 1)) - half
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([part] * len(low), pa.int32()), pa.array(low.tolist(), pa.int64())],
            names=["i", "j", "part", "value"],
        )
        rest, part = (rest - low) >> PART, part + 1


def scatter(vectors: DataFrame, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, sums of their entries, and n times the scatter around the mean, all exact."""
    parts = vectors.mapInArrow(_sums, "i int, j int, part int, value long").groupBy("i", "j", "part")
    gram = np.zeros((length + 1, length + 1), object)
    for row in parts.agg(F.sum("value").alias("value")).toLocalIterator():
        value = row["value"] << (PART * row["part"])
        gram[row["i"], row["j"]] += value
        if row["i"] != row["j"]:
            gram[row["j"], row["i"]] += value
    n, sums = gram[0, 0], gram[0, 1:]
    return n, sums, n * gram[1:, 1:] - np.outer(sums, sums)


# -- characteristic polynomial ---------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    """For odd p below 3,215,031,751."""
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


def _primes(above: int) -> list[int]:
    """Primes below 2**31 whose product is over ``above``."""
    found, product, p = [], 1, 2**31 - 1
    while product <= above:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, of x**0 first, by Hessenberg form."""
    h, d = (matrix % p).astype(np.int64), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    found[0, 0] = 1
    for k in range(1, d + 1):
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - (weights[:, None] * found[:k] % p).sum(axis=0)) % p
    return found[d]


def _remainders(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column(0).to_pylist()
            rows = [polynomial_modulo(shared.value, p).tolist() for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["prime", "row"])

    return run


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - matrix), of x**0 first, of a positive semi-definite integer matrix.

    Its roots are not negative and have the trace as their sum, which bounds every coefficient.
    """
    d, trace = len(matrix), sum(matrix.diagonal())
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = _primes(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)
    spread = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), 64))
    rows = {r["prime"]: r["row"] for r in spread.mapInArrow(_remainders(shared), "prime long, row array<long>").toLocalIterator()}
    shared.unpersist()
    product = 1
    for p in primes:
        product *= p
    units = {p: product // p * pow(product // p, -1, p) for p in primes}
    whole = [sum(rows[p][k] * units[p] for p in primes) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in whole]


# -- roots and their vectors -----------------------------------------------------------------------


def roots_above(polynomial: list[int], m: int, s: int) -> int:
    """Roots beyond m / 2**s, with multiplicity, of a polynomial all of whose roots are real."""
    degree = len(polynomial) - 1
    shifted = [c << (s * (degree - i)) for i, c in enumerate(polynomial)]
    for i in range(degree):
        for j in range(degree - 1, i - 1, -1):
            shifted[j] += m * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(polynomial: list[int], m: int, s: int) -> int:
    degree, total = len(polynomial) - 1, 0
    for i in range(degree, -1, -1):
        total = total * m + (polynomial[i] << (s * (degree - i)))
    return total


def root(polynomial: list[int], k: int, upto: int) -> tuple[int, int, int, int]:
    """The k-th largest root as (m, s) for m / 2**s, the first number and the count of the roots that share it.

    All roots are positive and at most ``upto``. Roots that agree in RELATIVE bits count as one.
    """
    low, high, s = 0, upto, 0
    beyond, least = 0, len(polynomial) - 1  # roots above high, and above low
    while least - beyond > 1 and (not low or (high - low) << RELATIVE > low):
        low, high, s = 2 * low, 2 * high, s + 1
        middle = (low + high) // 2
        n = roots_above(polynomial, middle, s)
        if n >= k:
            low, least = middle, n
        else:
            high, beyond = middle, n
    if least - beyond == 1:  # the sign of the value tells how many roots are above, but for an even number
        while not low or (high - low) << RELATIVE > low:
            low, high, s = 2 * low, 2 * high, s + 1
            middle = (low + high) // 2
            value = _value(polynomial, middle, s)
            if not value:
                return middle, s, k, 1
            if (value > 0) == (beyond % 2 == 0):
                high = middle
            else:
                low = middle
    return low + high, s + 1, beyond + 1, least - beyond


def null_vectors(matrix: np.ndarray, m: int, s: int, count: int) -> list[list[float]]:
    """Unit vectors that matrix - m / 2**s takes to (almost) nothing, orthogonal to each other."""
    d, trace = len(matrix), sum(matrix.diagonal())
    bits = FRACTION + 2 * max(0, (trace << s).bit_length() - m.bit_length())
    # In units of the trace, so that no entry is above one.
    rest = (matrix << bits) // trace
    rest[np.diag_indices(d)] -= (m << bits) // (trace << s)
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(rest[k + i, k]))
        if pivot != k:
            rest[[k, pivot]] = rest[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        rest[k, k] = rest[k, k] or 1
        if k + 1 < d:
            rest[k + 1 :, k] = (rest[k + 1 :, k] << bits) // rest[k, k]
            rest[k + 1 :, k + 1 :] -= (rest[k + 1 :, k, None] * rest[k, k + 1 :]) >> bits
    start = np.random.default_rng(13).integers(1, 2**40, (count, d))
    block = [v.astype(object) << (bits - 40) for v in start]
    for _ in range(STEPS):
        for c, v in enumerate(block):
            v = v[order]
            for k in range(1, d):
                v[k] -= (rest[k, :k] * v[:k]).sum() >> bits
            for k in range(d - 1, -1, -1):
                v[k] = ((v[k] << bits) - ((rest[k, k + 1 :] * v[k + 1 :]).sum() if k + 1 < d else 0)) // rest[k, k]
            for u in block[:c]:
                v = v - ((u * ((u * v).sum() >> bits)) >> bits)
            norm = isqrt((v * v).sum())
            block[c] = (v << bits) // norm
    out = []
    for v in block:
        first = max(range(d), key=lambda i: (abs(v[i]), -i))
        sign = 1 if v[first] > 0 else -1
        out.append([sign * int(x) / (1 << bits) for x in v])
    return out


def _components(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, polynomial = shared.value
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            found = []
            for k in numbers:
                m, s, first, count = root(polynomial, k, sum(matrix.diagonal()))
                found.append((str(m), s, null_vectors(matrix, m, s, count)[k - first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                names=["k", "m", "s", "vector"],
            )

    return run


def principal(spark, matrix: np.ndarray, count: int) -> list[tuple[int, int, list[float]]]:
    """(m, s, unit vector) of the ``count`` largest positive eigenvalues m / 2**s, or of all, if fewer."""
    if not matrix.any():
        return []
    common = gcd(*matrix.ravel().tolist())
    matrix = matrix // common
    polynomial = characteristic_polynomial(spark, matrix)
    zero = next(i for i, c in enumerate(polynomial) if c)
    count = min(count, len(matrix) - zero)
    shared = spark.sparkContext.broadcast((matrix, polynomial[zero:]))
    rows = spark.createDataFrame([(k,) for k in range(1, count + 1)], "k int").repartition(count)
    found = rows.mapInArrow(_components(shared), "k int, m string, s int, vector array<double>").collect()
    shared.unpersist()
    return [(int(r["m"]) * common, r["s"], list(r["vector"])) for r in sorted(found, key=lambda r: r["k"])]


# -- whitened rows ---------------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; in Python's integers if they are large."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < LARGEST:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares of each row."""
    if deviations.dtype == object:
        return (deviations * deviations).sum(axis=1).tolist()
    total, parts = np.zeros(len(deviations), object), _limbs(deviations)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a * b).sum(axis=1).astype(object) * (1 << (LIMB * (i + j)))
    return total.tolist()


def _whitened(shared, per_rows):
    """Apply ``per_rows(batch, deviations, whitened)`` to every batch (vector, ...); it gives the batch's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, axes = shared.value
        results = (
            per_rows(batch, deviations, (deviations.astype(np.float64) / n) @ axes)
            for batch in batches
            if batch.num_rows
            for deviations in [_deviations(_entries(batch.column(0)), n, sums)]
        )
        yield from (result for result in results if result is not None)

    return run


def _covariance(vectors: DataFrame, shared, count: int, n: int) -> np.ndarray:
    """Covariance of the whitened rows, centred before multiplying."""

    def sums(batch, _, white):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(count, dtype=np.int32)), pa.array(white.sum(axis=0))], names=["i", "value"]
        )

    found = vectors.mapInArrow(_whitened(shared, sums), "i int, value double").groupBy("i").agg(F.sum("value").alias("value"))
    means = np.zeros(count)
    for row in found.collect():
        means[row["i"]] = row["value"] / n
    i, j = (at.astype(np.int32) for at in np.triu_indices(count))

    def products(batch, _, white):
        centred = white - means
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array((centred.T @ centred)[i, j])], names=["i", "j", "value"])

    found = vectors.mapInArrow(_whitened(shared, products), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((count, count))
    for row in found.toLocalIterator():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["value"] / n
    return out


_SCHEMA = "id {id}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, components: int = COMPONENTS
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for every row that takes part.

    Entries become floor(64 c), at most 2**62 in size. ``deviation`` is the exact sum of squares of n times
    an entry less the sum of all, as text, since it may be beyond any number type; ``whitened`` the row on
    the ``components`` largest components, of unit variance each, ``explained`` their shares of the whole
    variance, largest first, and ``identity_error`` how far the covariance of ``whitened`` is off.

    Vectors that are null or empty, or hold null or non-finite entries, take no part, and neither do those
    of another length than most vectors have (the longest of equally frequent ones). Components without
    variance are left out, so that few or equal vectors have fewer; without any variance the arrays are
    empty and the error 0. Repeated rows, ties and null ids are rows like others. Eigenvalues that agree to
    110 bits share one space, of which any basis is taken. An empty table gives no rows; other columns,
    of any name, are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.select(id_column).schema[0].dataType.simpleString()
    schema = _SCHEMA.format(id=kind)
    rows = vectors.select(F.col(vector_column).cast("array<double>").alias("vector"), F.col(id_column).alias("id"))
    rows = rows.where(_usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == most["length"])
    plain = rows.select("vector")
    n, sums, matrix = scatter(plain, most["length"])
    found = principal(spark, matrix, components)
    trace = sum(matrix.diagonal())
    explained = [m / (trace << s) for m, s, _ in found]
    # The matrix is n * n times the covariance.
    deviations = [isqrt((m << 2 * RELATIVE) // ((n * n) << s)) / (1 << RELATIVE) for m, s, _ in found]
    axes = np.array([v for _, _, v in found], np.float64).reshape(len(found), most["length"]).T / np.array(deviations)
    shared = spark.sparkContext.broadcast((n, sums, axes))
    error = 0.0
    if found:
        covariance = _covariance(plain, shared, len(found), n)
        error = float(np.abs(covariance - np.eye(len(found))).max())

    def result(batch, deviations, white):
        k = white.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
        squares = pa.array([str(x) for x in _squares(deviations)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(1), squares, lists], names=["id", "deviation", "whitened"])

    out = rows.mapInArrow(_whitened(shared, result), f"id {kind}, deviation string, whitened array<double>")
    return out.select(
        "id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(x) for x in explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
