"""Embedding whitening: exact distributed covariance, leading eigenvectors by tridiagonalisation, projection by broadcast."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, pick, prepare, saved, table

#: Components at most.
COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no place in a long next to their sums; such a vector is dropped as one without a finite entry is.
LARGEST = float(2**52)
#: Products of two entries below 2 ** 20 are exact in a double for this many rows.
BLOCK, EXACT = 4096, 1 << 20
#: Components whose eigenvalue is below this share of the first are rounding, not a direction.
RANK = 1e-13


def fixed(rows: DataFrame) -> DataFrame:
    """(vec_id, x) with integer vectors; vectors that are null, empty, or hold null, non-finite or too large entries go."""
    v = pick(rows, "vec_id", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    good = F.expr(f"v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < {LARGEST!r}D / {SCALE})")
    return v.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.expr(f"transform(v, c -> floor({SCALE} * c) + {SHIFT}L)").alias("x"))


def _by_size(b: pa.RecordBatch):
    """(dimension, rows, matrix) for the vectors of each length in a batch."""
    x = b.column("x")
    sizes = np.asarray(x.value_lengths())
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, np.asarray(x.take(pa.array(at)).flatten(), np.int64).reshape(len(at), d)


def _halves(values) -> tuple[list[int], list[int]]:
    """Integers of any size as (high, low) longs: high * 2 ** 32 + low."""
    return [int(v) >> 32 for v in values], [int(v) & 0xFFFFFFFF for v in values]


_SUM = "cast(sum(cast(hi as decimal(38,0)) * 4294967296BD + lo) as decimal(38,0))"


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dimension: (rows, exact sums)} of distinct vectors; one row per dimension and entry reaches the driver."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for b in batches:
            for d, at, x in _by_size(b):
                total[d] = total.get(d, 0) + (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                rows[d] = rows.get(d, 0) + len(at)
        for d, t in total.items():
            hi, lo = _halves(t)
            yield batch(d=pa.array([d] * d, pa.int32()), i=pa.array(range(d), pa.int32()), n=pa.array([rows[d]] * d, pa.int64()), hi=pa.array(hi, pa.int64()), lo=pa.array(lo, pa.int64()))

    parts = fit.select("x").mapInArrow(run, "d int, i int, n long, hi long, lo long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.expr(_SUM).alias("s")).orderBy("d", "i").collect():
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def covariances(fit: DataFrame, known: dict[int, tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, float]]:
    """{dimension: (covariance, trace)} of distinct vectors, divisor n.

    Entries are centred by the integer part of their mean, then multiplied and summed as exact integers; what the fraction of the
    mean adds is taken off exactly on the driver, and each entry is rounded once. The result doesn't depend on how
    rows are dealt. Tasks send one row per pair of dimensions; Spark adds them up.
    """
    centre = fit.sparkSession.sparkContext.broadcast({d: np.array([s // n for s in t], np.int64) for d, (n, t) in known.items()})

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_size(b):
                y = x - centre.value[d]
                total.setdefault(d, np.zeros((d, d), object))
                for at in range(0, len(y), BLOCK):
                    z = y[at:at + BLOCK]
                    if np.abs(z).max(initial=0) < EXACT:
                        z = z.astype(np.float64)
                        total[d] += (z.T @ z).astype(np.int64).astype(object)
                    else:
                        z = z.astype(object)
                        total[d] += z.T @ z
        for d, t in total.items():
            for i in range(d):
                hi, lo = _halves(t[i, i:])
                yield batch(d=pa.array([d] * (d - i), pa.int32()), i=pa.array([i] * (d - i), pa.int32()), j=pa.array(range(i, d), pa.int32()),
                            hi=pa.array(hi, pa.int64()), lo=pa.array(lo, pa.int64()))

    parts = fit.select("x").mapInArrow(run, "d int, i int, j int, hi long, lo long")
    q = {d: np.zeros((d, d), object) for d in known}
    for r in parts.groupBy("d", "i", "j").agg(F.expr(_SUM).alias("s")).toLocalIterator():
        q[r.d][r.i, r.j] = q[r.d][r.j, r.i] = int(r.s)
    out = {}
    for d, (n, s) in known.items():
        rest = np.array([v % n for v in s], object)
        exact = n * q[d] - np.outer(rest, rest)  # n * n times the covariance
        out[d] = np.array([[float(Fraction(v, n * n)) for v in row] for row in exact]), float(Fraction(sum(exact.diagonal()), n * n))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, subdiagonal and the reflections (unit vectors) that make a symmetric matrix tridiagonal."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.abs(v).max(initial=0.0)
        if size == 0 or not np.abs(v[1:]).max(initial=0.0):
            mirrors.append(np.zeros(n - k - 1))
            continue
        v /= size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        mirrors.append(v)
        w = a[k + 1:, k + 1:] @ v
        w -= (v @ w) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def leading(diag: np.ndarray, sub: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a symmetric tridiagonal matrix, falling: bisection of Sturm counts, all k at once."""
    n = len(diag)
    pad = np.abs(np.concatenate(([0.0], sub, [0.0])))
    reach = pad[:-1] + pad[1:]
    lo, hi = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    tiny = np.finfo(float).tiny * max(1.0, float((sub * sub).max(initial=0.0))) + np.finfo(float).tiny
    want = n - np.arange(k)  # the j-th largest has at least n - j eigenvalues not above it
    square = sub * sub
    for _ in range(4096):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        below, q = np.zeros(k, int), np.ones(k)
        for i in range(n):
            q = diag[i] - mid - (square[i - 1] / q if i else 0.0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            below += q < 0
        up = below >= want
        hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)
    return lo + (hi - lo) / 2


def _solve(diag: np.ndarray, sub: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; a pivot of zero counts as ``least``."""
    n = len(diag)
    rows = [[diag[i] - shift, sub[i] if i < n - 1 else 0.0, 0.0] for i in range(n)]
    b = b.copy()
    for i in range(n - 1):
        low = [sub[i], diag[i + 1] - shift, sub[i + 1] if i < n - 2 else 0.0]
        if abs(low[0]) > abs(rows[i][0]):
            rows[i], low = low, [rows[i][0], rows[i][1], rows[i][2]]
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(rows[i][0]) < least:
            rows[i][0] = least
        f = low[0] / rows[i][0]
        rows[i + 1] = [low[1] - f * rows[i][1], low[2] - f * rows[i][2], 0.0]
        b[i + 1] -= f * b[i]
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        r = b[i] - sum(rows[i][k] * x[i + k] for k in (1, 2) if i + k < n)
        x[i] = r / (rows[i][0] if abs(rows[i][0]) >= least else least)
    return x


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Inverse iteration on the tridiagonal form; vectors of a cluster (neighbours within 1e-3 of the matrix's norm) are
    made orthogonal to those before them in every step.
    """
    n = len(a)
    k = min(k, n)
    size = float(np.abs(a).max(initial=0.0))
    if not size:
        return np.zeros(k), np.eye(n)[:, :k]
    diag, sub, mirrors = tridiagonal(a / size)
    values = leading(diag, sub, k)
    norm = float(max(np.abs(diag).max(), np.abs(sub).max(initial=0.0)))
    eps, rng = np.finfo(float).eps, np.random.default_rng(1)
    vectors, first = np.zeros((n, k)), 0
    for j in range(k):
        if j and values[j - 1] - values[j] > 1e-3 * norm:
            first = j
        x = rng.normal(size=n)
        # equal shifts would give equal vectors: a later one of a cluster is moved by some roundings
        shift = values[j] - (j - first) * eps * norm
        for _ in range(5):
            x = _solve(diag, sub, shift, x / np.linalg.norm(x), eps * norm)
            for _ in range(2):
                x = x - vectors[:, first:j] @ (vectors[:, first:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    return values * size, vectors


class Whitening:
    """Of one dimension: rows and sums of the fit list, eigenvalues, shares of the trace, and the scaled components."""

    def __init__(self, n: int, s: list[int], v: np.ndarray, trace: float):
        values, vectors = eigen(v, COMPONENTS)
        real = values > RANK * max(values[0], 0.0)
        self.n, self.sums, self.values = n, s, values[real]
        self.explained = self.values / trace if trace else self.values
        self.map = vectors[:, real] / np.sqrt(self.values)
        self.floor = np.array([t // n for t in s], np.int64)
        self.rest = np.array([float(Fraction(t % n, n)) for t in s])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor) - self.rest) @ self.map

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; null where a long can't hold it."""
        y, d = x - self.floor, len(self.sums)
        rest = np.array([t % self.n for t in self.sums], object)
        most = int(np.abs(y).max(initial=0))
        if d * most * max(most, self.n) < 2**62:
            squares, cross = (y * y).sum(1), y @ rest.astype(np.int64)
        else:
            y = y.astype(object)
            squares, cross = (y * y).sum(1), y @ rest
        total, n = int((rest * rest).sum()), self.n
        exact = (n * n * a - 2 * n * b + total for a, b in zip(squares.tolist(), cross.tolist(), strict=True))
        return [v if v < 2**63 else None for v in exact]


def _identity_error(fit: DataFrame, models) -> dict[int, float]:
    """{dimension: largest entry of |covariance of the whitened fit list - identity|}.

    Tasks centre their own whitened rows before they multiply; their means, products and counts then give the whole.
    """

    def run(batches: Batches) -> Batches:
        count: dict[int, int] = {}
        mean: dict[int, np.ndarray] = {}
        square: dict[int, np.ndarray] = {}
        for b in batches:
            for d, at, x in _by_size(b):
                if not len(models.value[d].values):
                    continue
                w = models.value[d].whitened(x)
                m, k, c = w.mean(0), len(at), count.get(d, 0)
                off = m - mean.get(d, m)
                square[d] = square.get(d, 0) + (w - m).T @ (w - m) + np.outer(off, off) * (c * k / (c + k))
                mean[d] = mean.get(d, m) + off * (k / (c + k))
                count[d] = c + k
        for d, m in mean.items():
            i, j = (a.ravel() for a in np.indices((len(m), len(m))))
            yield batch(d=pa.array([d] * len(i), pa.int32()), i=pa.array(i, pa.int32()), j=pa.array(j, pa.int32()), c=pa.array([float(count[d])] * len(i)),
                        mi=m[i], mj=m[j], q=square[d].ravel())

    parts = fit.select("x").mapInArrow(run, "d int, i int, j int, c double, mi double, mj double, q double")
    total = parts.groupBy("d", "i", "j").agg(F.expr("(sum(q) + sum(c * mi * mj) - sum(c * mi) * sum(c * mj) / sum(c)) / sum(c)").alias("v"))
    worst = total.groupBy("d").agg(F.max(F.abs(F.col("v") - F.expr("if(i = j, 1D, 0D)"))).alias("e"))
    return {r.d: r.e for r in worst.collect()}


def whiten(rows: DataFrame) -> DataFrame:
    """For each row with a usable vector and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct integer vector once. Vectors of different lengths are whitened each with their like; a
    length is a model of its own, and models (the square of a length) are all that is broadcast. A component without
    spread is left out, so a length with one distinct vector gives no rows. Null, empty and non-finite vectors are
    dropped, as are entries beyond 2 ** 52 / 64; repeated rows give their rows each, a null vec_id stays null; an empty table gives no
    rows; other columns are not read. A deviation that no long can hold is null.
    """
    spark = rows.sparkSession
    vectors = fixed(rows)
    fit = saved(vectors.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "whitening-fit")
    known = sums(fit)
    cov = covariances(fit, known)
    fitted = {d: Whitening(n, s, *cov[d]) for d, (n, s) in known.items()}
    models = spark.sparkContext.broadcast(fitted)
    errors = spark.sparkContext.broadcast(_identity_error(fit, models))

    def run(batches: Batches) -> Batches:
        for b in batches:
            for d, at, x in _by_size(b):
                m = models.value[d]
                k, rows = len(m.values), len(at)
                if not k:
                    continue
                yield batch(vec_id=b.column("vec_id").take(pa.array(np.repeat(at, k))), component=pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                            n=pa.array(np.full(rows * k, m.n)), deviation=pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                            whitened=m.whitened(x).ravel(), explained=np.tile(m.explained, rows), identity_error=np.full(rows * k, errors.value[d], float))

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of all embeddings."""
    prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings"))
