"""Whitening of embeddings by an incremental eigendecomposition.

Entries become long integers x = floor(scale * c) + offset. The spectrum is fitted on every distinct x vector once:

1. Every task keeps (count, mean, eigenvalues, eigenvectors) of the scatter of the vectors it has read. A new
   vector, centred on the running mean, is a rank-one update: the roots of the secular equation are the new
   eigenvalues, and components that do not take part (no weight, or equal eigenvalues) are deflated.
2. Spectra of tasks are joined ``FAN`` at a time, by one rank-one update per eigenpair and one for the distance
   of the means, in a tree of Spark jobs, so no task or driver meets more than ``FAN`` of them.
3. A Rayleigh-Ritz pass over the data projects the exactly centred vectors on the joined eigenvectors; the small
   projected covariance, summed in the same kind of tree, gives the final components to double precision.

What reaches the driver or all tasks is one matrix of dimension x dimension, which does not grow with the rows.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, and rows whose vector is not
of the commonest length (of equally common ones the longest), are dropped. Repeated rows are returned each but
fitted once. Rows without vec_id take part. Components without variance (at most dimension * 2^-52 of the
largest eigenvalue) keep their rows with ``whitened`` null and take no part in ``identity_error``, which is null
if no component varies; ``explained`` is null if nothing varies. ``deviation`` is null where the exact sum
passes a long. Equal eigenvalues share a space, in which any basis may be returned. An empty table gives no
rows; further columns are not read, and text plays no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.session import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN = 16
# Vectors a task updates its spectrum with: an update costs far more than reading the vector, so tasks are cut by
# rows. Beyond 8 tasks a core, tasks get longer instead.
TASK_ROWS = 2048
EPS = float(np.finfo(np.float64).eps)
LONG_MAX = (1 << 63) - 1
STEPS = 80


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) for ascending distinct d, positive z2 and rho > 0.

    Returns (roots, gaps) with gaps[j, i] = d[i] - roots[j], which is computed from the pole nearest to each root
    and so keeps its relative accuracy. All roots are sought together, by rational interpolation of the sums left
    and right of the root, inside a bracket that is halved whenever a step leaves it.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    width = upper - d
    # the sign at the middle of each interval says which end is nearer
    middle = d + width / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + rho * (z2 / (d - middle[:, None])).sum(axis=1)
    left = at_middle >= 0
    left[-1] = True  # the last interval has a pole at its lower end only
    origin = np.where(left, d, upper)
    poles = d - origin[:, None]
    near, far = d - origin, upper - origin
    low, high = np.where(left, 0.0, -width / 2), np.where(left, width / 2, 0.0)
    high[-1] = width[-1]
    eta = (low + high) / 2
    below = np.tril(np.ones((n, n)))
    active = np.ones(n, dtype=bool)
    for _ in range(STEPS):
        gap = poles - eta[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = rho * z2 / gap
            slope = term / gap
            total, lower = term.sum(axis=1), np.einsum("ij,ij->i", term, below)
            f = 1 + total
            bound = EPS * n * (1 + total - 2 * lower)  # terms of lower poles are negative
            psi = np.einsum("ij,ij->i", slope, below)
            phi = slope.sum(axis=1) - psi
            low, high = np.where(f < 0, eta, low), np.where(f > 0, eta, high)
            a, b = near - eta, far - eta
            c = f - a * psi - b * phi
            p, q = (a + b) * f - a * b * (psi + phi), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            moved = eta + step
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        moved = np.where(inside, moved, (low + high) / 2)
        active &= (np.abs(f) > bound) & (moved != eta) & (high > low)
        if not active.any():
            break
        eta = np.where(active, moved, eta)
    return origin + eta, poles - eta[:, None]


class Spectrum:
    """Count, mean and eigenpairs (ascending) of the scatter matrix of the vectors seen so far."""

    def __init__(self, width: int):
        self.count = 0
        self.mean = np.zeros(width)
        self.values = np.zeros(width)
        self.vectors = np.eye(width)

    def add(self, x: np.ndarray) -> None:
        gap = x - self.mean
        self.count += 1
        self.mean = self.mean + gap / self.count
        self.update(gap, (self.count - 1) / self.count)

    def join(self, other: Spectrum) -> None:
        """Adds the vectors behind another spectrum: one update per eigenpair, one for the means."""
        if not other.count:
            return
        gap, total = other.mean - self.mean, self.count + other.count
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, float(value))
        self.update(gap, self.count * other.count / total)
        self.mean = self.mean + gap * (other.count / total)
        self.count = total

    def update(self, v: np.ndarray, rho: float) -> None:
        """Eigenpairs of the scatter plus rho * v v'."""
        size = float(np.sqrt(v @ v))
        if rho <= 0 or size == 0:
            return
        z, rho = self.vectors.T @ (v / size), rho * size * size
        d = self.values
        tiny = 8 * EPS * max(float(d[-1]), rho)
        part = np.flatnonzero(rho * np.abs(z) > tiny)
        if len(part) > 1 and (np.diff(d[part]) <= tiny / max(EPS, float(np.abs(z[part]).max()) ** 2)).any():
            part = self._deflate_equal(part, z, tiny)
        if not len(part):
            return
        sign = np.where(z[part] < 0, -1.0, 1.0)
        own = d[part]
        roots, gaps = secular_roots(own, z[part] ** 2, rho)
        # weights for which the computed roots are exact keep the vectors orthogonal
        n = len(part)
        ratio = -gaps  # roots[j] - d[i]
        base = own[:, None] - own[None, :]
        j, i = np.indices((n, n))
        lower = np.zeros((n, n))
        lower[j < i] = base[j[j < i], i[j < i]]
        between = (j >= i) & (j < n - 1)
        lower[between] = base[j[between] + 1, i[between]]
        lower[n - 1, :] = 1
        z2 = np.abs(np.prod(ratio / lower, axis=0))
        basis = (sign * np.sqrt(z2))[:, None] / gaps.T
        basis /= np.sqrt((basis * basis).sum(axis=0))
        self.vectors[:, part] = self.vectors[:, part] @ basis
        self.values[part] = np.maximum(roots, 0)
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _deflate_equal(self, part: np.ndarray, z: np.ndarray, tiny: float) -> np.ndarray:
        """Rotates pairs of (nearly) equal eigenvalues until only one of each pair has weight."""
        kept = []
        last = part[0]
        for at in part[1:]:
            r = np.hypot(z[last], z[at])
            c, s = z[at] / r, z[last] / r
            gap = self.values[at] - self.values[last]
            if abs(gap * c * s) > tiny:
                kept.append(last)
                last = at
                continue
            a, b = self.vectors[:, last].copy(), self.vectors[:, at].copy()
            self.vectors[:, last], self.vectors[:, at] = c * a - s * b, s * a + c * b
            low, high = self.values[last], self.values[at]
            self.values[last], self.values[at] = low * c * c + high * s * s, low * s * s + high * c * c
            z[last], z[at] = 0.0, r
            last = at
        kept.append(last)
        return np.array(kept)

    def row(self, group: int) -> tuple:
        return group, self.count, self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()

    @classmethod
    def of_row(cls, count: int, mean, values, vectors) -> Spectrum:
        out = cls(len(mean))
        out.count, out.mean, out.values = int(count), np.array(mean), np.array(values)
        out.vectors = np.array(vectors).reshape(len(mean), len(mean))
        return out


def usable(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): integer vectors of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select("vec_id", ints.alias("x"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _tree(rows: DataFrame, schema: str, merge: Callable[[pd.DataFrame], tuple]) -> tuple | None:
    """Merges the rows of ``schema`` (grp, ..) ``FAN`` at a time until one is left; returns its values."""
    names = [part.split()[0] for part in schema.split(", ")]

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("grp", kind="stable")
        return pd.DataFrame([(int(ordered["grp"].iloc[0]) // FAN, *merge(ordered))], columns=names)

    left = materialize(rows, "spectra")
    while left.count() > 1:
        grouped = left.groupBy(F.expr(f"grp div {FAN}").alias("above"))
        left = materialize(grouped.applyInPandas(lambda frame: meet(frame), schema), "spectra")
    one = left.collect()
    return tuple(one[0])[1:] if one else None


def _numbered(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], tuple | None], schema: str) -> DataFrame:
    """One row (grp, ..) per task that has rows, numbered by task."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out = work(frames)
        if out is not None:
            yield pd.DataFrame([(TaskContext.get().partitionId(), *out)], columns=names)

    return df.mapInPandas(run, schema)


SPECTRA = "grp long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"
MATRIX = "grp long, cells array<double>"


def fit_spectrum(fit: DataFrame) -> Spectrum | None:
    """Spectrum of the vectors ``x``: rank-one updates in every task, tasks joined in a tree."""

    def work(frames: Iterator[pd.DataFrame]) -> tuple | None:
        spectrum = None
        for frame in frames:
            for x in _stack(frame["x"]) if len(frame) else ():
                spectrum = spectrum or Spectrum(len(x))
                spectrum.add((x - OFFSET).astype(np.float64))
        return spectrum.row(0)[1:] if spectrum else None

    def merge(frame: pd.DataFrame) -> tuple:
        parts = [Spectrum.of_row(*r) for r in frame[["n", "mean", "eigenvalues", "eigenvectors"]].itertuples(index=False)]
        for other in parts[1:]:
            parts[0].join(other)
        return parts[0].row(0)[1:]

    found = _tree(_numbered(fit, work, SPECTRA), SPECTRA, merge)
    return Spectrum.of_row(*found) if found else None


def _projected(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors on the columns of ``basis``, summed in a tree."""

    def work(frames: Iterator[pd.DataFrame]) -> tuple | None:
        total, seen = np.zeros((basis.shape[1], basis.shape[1])), False
        for frame in frames:
            if len(frame):
                y = _centred(_stack(frame["x"]), n, sums) @ basis
                total, seen = total + y.T @ y, True
        return (total.ravel().tolist(),) if seen else None

    def merge(frame: pd.DataFrame) -> tuple:
        return (np.sum(np.stack(frame["cells"].to_numpy()), axis=0).tolist(),)

    cells = _tree(_numbered(fit, work, MATRIX), MATRIX, merge)
    return np.array(cells[0]).reshape(basis.shape[1], -1) / n


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact integers n*x - S."""
    return _exact(x, n, sums).astype(np.float64) / n


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if float(n) * float(np.abs(x).max(initial=0)) < LONG_MAX / 4:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    exact = _exact(x, n, sums)
    if float(np.abs(exact).max(initial=0)) ** 2 * x.shape[1] < LONG_MAX / 4:
        return [int(v) for v in (exact.astype(np.int64) ** 2).sum(axis=1)]
    wide = (exact.astype(object) ** 2).sum(axis=1)
    return [int(v) if v <= LONG_MAX else None for v in wide]


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), see the module's text."""
    schema = (
        f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, vector_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["width"])
    fit = materialize(rows.select("x").distinct(), "fit")
    n = fit.count()
    totals = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).orderBy("at")
    sums = np.array([r["s"] for r in totals.collect()], dtype=np.int64)  # one number per dimension

    tasks = min(-(-n // TASK_ROWS), max(200, 8 * spark.sparkContext.defaultParallelism))
    spectrum = fit_spectrum(fit.repartition(tasks, "x"))
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    ritz = _projected(fit, n, sums, basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, axes = np.maximum(values[::-1], 0), basis @ turn[:, ::-1]
    trace = float(np.trace(ritz))
    kept = min(components, len(values))
    varies = values[:kept] > len(values) * EPS * values[0]
    scaled = axes[:, :kept] / np.sqrt(np.where(varies, values[:kept], 1.0))
    explained = [float(v) / trace if trace > 0 else None for v in values[:kept]]
    error = None
    if varies.any():
        error = float(np.abs(_projected(fit, n, sums, scaled[:, varies]) - np.eye(int(varies.sum()))).max())

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _stack(frame["x"])
            white = np.where(varies, _centred(x, n, sums) @ scaled, np.nan)
            deviation = pd.array(_deviations(x, n, sums), dtype="Int64")
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].repeat(kept).to_numpy(),
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x)),
                "deviation": deviation.repeat(kept),
                "whitened": white.ravel(),
            })

    out = rows.mapInPandas(project, f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, deviation long, whitened double")
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return out.select(
        "vec_id",
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
