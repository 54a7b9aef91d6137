"""Whitening of embeddings by principal components, found by contour integration (FEAST).

Vectors are scaled to whole numbers, so sums are exact. Rows meet only in sums of tasks: per dimension,
then row by row of the covariance. The covariance, dimension squared, is the one matrix that leaves Spark.
Inertia counts slice the spectrum; for each slice a task applies the spectral projector, a quadrature of
shifted solves on a circle round the slice, to a block of vectors, and Rayleigh-Ritz gives its
eigenvectors; the counts tell whether all are there.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import map_arrow

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries beyond 2^40 count as not finite: sums of batches must stay exact.
LARGEST = 1 << 40
#: Eigenvalues of a slice, and points of the quadrature on its half circle.
SLICE, POINTS = 8, 8
#: Eigenvalues below this share of the largest are rounding, not variance.
NOISE = 1e-10


@dataclass
class Whitening:
    """n vectors, the exact sums of their scaled entries, components as columns, eigenvalues, trace, identity error."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part subtracted as integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([(s % self.n) / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; null where it does not fit a long."""
        whole, left = np.array([s // self.n for s in self.sums], np.int64), [s % self.n for s in self.sums]
        away = x - whole
        if (self.n * (int(np.abs(away).max(initial=0)) + 1)) ** 2 * len(left) < 2**62:
            d = away * np.int64(self.n) - np.array(left, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, left)) for row in away.tolist()]
        return [v if v < 2**63 else None for v in exact]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors without null, non-finite or huge entries, v as doubles; those of length zero go too."""
    fine = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < float(LARGEST // SCALE), F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def scaled(column: pa.ListArray) -> np.ndarray:
    """floor(64 c) + 1000000 of the vectors of a batch, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + SHIFT


def add_up(parts: DataFrame) -> list[np.ndarray]:
    """Rows (i, part), part an array of doubles: the sum of the parts of each i, in order of i."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1)):
                part = part.values.to_numpy(zero_copy_only=False)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["i", "part"])

    spread = parts.repartition("i").sortWithinPartitions("i", F.xxhash64("part"))
    return [np.array(r["part"]) for r in sorted(spread.transform(map_arrow, run, "i int, part array<double>").collect(), key=lambda r: r["i"])]


def products(rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all vectors of the outer product of ``of(x)``: a row of the matrix from each task, added up in Spark."""

    def run(batches):
        total, any_row = np.zeros((width, width)), False
        for b in batches:
            if b.num_rows:
                y = of(scaled(b.column(0)))
                total += y.T @ y
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    return np.vstack(add_up(rows.select("v").transform(map_arrow, run, "i int, part array<double>")))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size > 0:
            p = a[k + 1 :, k + 1 :] @ v * (2 / size)
            w = p - v * (v @ p / size)
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = -np.copysign(np.linalg.norm(a[k + 1 :, k]), a[k + 1, k])
    return a.diagonal().copy(), a.diagonal(-1).copy()


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: the eigenvalues below each shift are the negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny ** 0.5
    pivot, n = diagonal[0] - shifts, np.zeros(len(shifts), int)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        n += pivot < 0
    return n


def slices(a: np.ndarray, k: int, width: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) of slices that hold the ``k`` largest positive eigenvalues, fewer if there are fewer.

    Borders lie in the widest gap near each ``width``-th eigenvalue; a cluster is never cut.
    """
    d, e = tridiagonal(a)
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    n, top = len(d), float((d + reach).max())
    floor = top * NOISE
    k = min(k, n - int(count_below(d, e, np.array([floor]))[0])) if top > 0 else 0
    if k <= 0:
        return []
    seen = min(n, k + width)
    low, high = np.full(seen, float((d - reach).min()) - floor), np.full(seen, top + floor)
    for _ in range(60):  # the j-th largest eigenvalue, all j at once
        mid = (low + high) / 2
        under = n - count_below(d, e, mid) <= np.arange(seen)
        low, high = np.where(under, low, mid), np.where(under, mid, high)
    values = (low + high) / 2
    gaps = values[:-1] - values[1:]
    border, borders = top * 1.01 + floor, []
    at = 0
    while at < k:
        if k - at <= width:
            near = [r for r in range(k, seen) if gaps[r - 1] > 1e-6 * top]
        else:
            near = [r for r in range(at + width // 2, min(seen - 1, at + 2 * width) + 1) if gaps[r - 1] > 1e-6 * top and (r >= k or r <= at + width + width // 2)]
        if not near:  # to the end of the spectrum
            low_end, at = float((d - reach).min()) - max(floor, 0.01 * top), n
        else:
            at = max(near, key=lambda r: gaps[r - 1])
            low_end = (values[at - 1] + values[at]) / 2
        between = count_below(d, e, np.array([low_end, border]))
        borders.append((float(low_end), float(border), int(between[1] - between[0])))
        border = low_end
    return borders


def feast(a: np.ndarray, low: float, high: float, count: int, points: int = POINTS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their eigenvectors.

    A round applies the projector to a block of vectors and takes Ritz vectors of what it gives, until
    residuals fall no more. A block that lacks some is doubled; if a block as wide as the matrix does, it is an error.
    """
    n, size = len(a), float(np.abs(a).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(points)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (1 + nodes))
    width = min(n, max(count + 4, (3 * count + 1) // 2))
    while True:
        y, best = np.random.default_rng(width).standard_normal((n, width)), None
        for _ in range(rounds):
            q = sum(0.5 * w * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, y)).real for w, t in zip(weights, turn))
            q = np.linalg.qr(q)[0]
            values, u = np.linalg.eigh(q.T @ a @ q)
            y = q @ u
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                worst = np.linalg.norm(a @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0)
                if best is not None and worst > best[0] / 2 and best[0] < 1e-10 * size:
                    break
                if best is None or worst < best[0]:
                    best = worst, values[inside], y[:, inside]
        if best is not None and best[0] < 1e-10 * size:
            return best[1], best[2]
        if width == n:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} by inertia, not found by projection")
        width = min(n, 2 * width)


def components(spark: SparkSession, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Each slice is a task of its own; the matrix goes along with the function, dimension squared in size.
    """
    own = slices(a, k)
    if not own:
        return np.zeros(0), np.zeros((len(a), 0))

    def run(batches):
        for b in batches:
            for low, high, count in zip(*(b.column(c).to_pylist() for c in range(3))):
                values, vectors = feast(a, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    tasks = spark.createDataFrame([(i, *s) for i, s in enumerate(own)], "i int, low double, high double, count int").repartitionByRange(len(own), "i").drop("i")
    found = tasks.mapInArrow(run, "value double, vector array<double>").collect()
    if len(found) != sum(s[2] for s in own):
        raise ArithmeticError("the slices hold more eigenvalues than were found")
    q = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)[0]
    values, u = np.linalg.eigh(q.T @ a @ q)  # one basis for all slices
    k = min(k, int((values > NOISE * values[-1]).sum()))
    return values[::-1][:k].copy(), (q @ u[:, ::-1])[:, :k].copy()


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable vectors of the commonest length (the longer of two); None if there is none.

    Directions without variance are no components, so there may be fewer than ``k``; equal vectors have none.
    """
    rows = usable(vectors, id_col, vector_col)
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not found:
        return None
    width, n = found[0]["d"], found[0]["n"]
    rows = rows.where(F.size("v") == width)

    def sums(batches):
        total = [0] * width
        for b in batches:
            if b.num_rows:
                total = [t + s for t, s in zip(total, scaled(b.column(0)).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([[decimal.Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["s"])

    parts = rows.select("v").transform(map_arrow, sums, "s array<decimal(38,0)>").select(F.posexplode("s").alias("i", "s"))
    exact = [int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]
    model = Whitening(n, exact, np.zeros((width, 0)), np.zeros(0), 0.0)
    covariance = products(rows, model.centred, width) / n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    model.values, model.basis = components(vectors.sparkSession, covariance, k)
    if len(model.values):
        model.identity_error = float(np.abs(products(rows, model.whitened, len(model.values)) / n - np.eye(len(model.values))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of each usable vector of the model's length: its distance from the mean and its whitened form.

    Vectors that are null or hold null, non-finite or huge entries go, and those of another length;
    repeated rows and ids stay, null ids too; other columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col).select(F.col("id").alias(id_col), F.col("v"))
    fields = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], fields)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = scaled(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.deviations(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))], names=[id_col, "deviation", "whitened"])

    return rows.where(F.size("v") == len(model.sums)).transform(map_arrow, run, fields)


def by_component(whitened: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    shares = [float(v / model.trace) for v in model.values] if model else []
    rows = whitened.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, shares or [0.0])), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
