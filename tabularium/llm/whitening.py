"""Whitening of vectors by shifted CholeskyQR.

A pass over the rows sums a Gram matrix; its Cholesky factor R turns the rows into better conditioned ones by triangular
solves, and the next pass sums the Gram matrix of those. The first passes add a shift, so that the factor exists however
ill-conditioned the rows are; passes end when the rows are orthonormal. The product of the factors is the R of all rows,
and its singular vectors and values give components and variances: no covariance is formed, whose condition would be the
square. A pass gives one matrix a task, summed by entry in Spark; rows are read anew and never shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_vectors, map_arrow, slices, summed

LARGEST = 1 << 62
UNIT = np.finfo(np.float64).eps / 2


@dataclass
class Fit:
    """n rows, their integer sums and largest entry; ``basis`` turns a centred row into whitened values; variances fall."""

    n: int
    sums: list[int]
    reach: int
    scale: float
    shift: int
    factors: list[np.ndarray] = field(default_factory=list)
    basis: np.ndarray | None = None
    variances: np.ndarray | None = None

    @property
    def wide(self) -> bool:
        """Whether n * x - sums may leave 64 bits: then Python's integers are used."""
        return self.n * self.reach >= 1 << 61


def entries(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integers(values: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift; products beyond 2^62 count as 2^62."""
    return np.clip(np.floor(scale * values), -float(LARGEST), float(LARGEST)).astype(np.int64) + shift


def offsets(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - sums, exact."""
    if fit.wide:
        return x.astype(object) * fit.n - np.array(fit.sums, dtype=object)
    return x * fit.n - np.array(fit.sums, dtype=np.int64)


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows @ inv(r) for an upper triangular r, column by column."""
    q = np.empty_like(rows)
    for j in range(len(r)):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def count_and_sums(vectors: DataFrame, width: int, scale: float, shift: int) -> Fit:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, reach, total = 0, 0, [0] * width
        for batch in slices(batches):
            x = integers(entries(batch.column(0), width), scale, shift)
            largest = max(int(x.max()), -int(x.min()))
            part = x.sum(axis=0) if largest * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            n, reach, total = n + len(x), max(reach, largest), [a + int(b) for a, b in zip(total, part)]
        yield {"part": [[n, *total]], "reach": [reach]}

    sums, reach = summed(vectors, run, "decimal(38,0)", largest="reach")
    return Fit(int(sums[0]) if sums else 0, [int(s) for s in sums[1:]], reach, scale, shift)


def gram(vectors: DataFrame, width: int, fit: Fit, project: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the factors' solves, or of the rows projected on a basis."""
    size = width if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((size, size))
        for batch in slices(batches):
            rows = (offsets(integers(entries(batch.column(0), width), fit.scale, fit.shift), fit) / fit.n).astype(np.float64)
            if project is not None:
                rows = rows @ project
            else:
                for r in fit.factors:
                    rows = solve(rows, r)
            total += rows.T @ rows
        yield {"part": [total.ravel().tolist()]}

    found, _ = summed(vectors, run, "double")
    return np.array(found).reshape(size, size)


def orthogonalise(vectors: DataFrame, width: int, fit: Fit, tolerance: float, most_passes: int) -> np.ndarray:
    """Fill ``fit.factors`` and return the R of all centred rows: R'R is their Gram matrix, to rounding."""
    ratio = 0.0
    while True:
        g = gram(vectors, width, fit)
        values, sides = np.linalg.eigh(g)
        last, ratio = ratio, values[0] / values[-1] if values[-1] > 0 else 0.0
        done = np.abs(g - np.eye(width)).max() <= tolerance
        # rows that lie in fewer dimensions never become orthonormal: a shift that gains nothing ends the passes
        stuck = len(fit.factors) >= 2 and ratio < 1e-12 and ratio < 4 * last
        if done or stuck or values[-1] <= 0 or len(fit.factors) == most_passes:
            r = np.sqrt(np.maximum(values, 0))[:, None] * sides.T
            for factor in reversed(fit.factors):
                r = r @ factor
            return r
        shift = 0.0 if ratio > 1e-12 else 11 * (fit.n * width + width * (width + 1)) * UNIT * values[-1]
        fit.factors.append(np.linalg.cholesky(g + shift * np.eye(width)).T)


def fit_components(vectors: DataFrame, width: int, components: int, scale: float, shift: int, tolerance: float = 1e-13, most_passes: int = 12) -> Fit:
    """Components of clean vectors of one width; those without variance are left out."""
    fit = count_and_sums(vectors, width, scale, shift)
    r = orthogonalise(vectors, width, fit, tolerance * max(1.0, width), most_passes) if fit.n else np.zeros((width, width))
    _, values, sides = np.linalg.svd(r)
    own = values > values[0] * 8 * width * UNIT
    sides = sides.T
    # the largest entry of a component is positive
    sides = sides * np.where(np.take_along_axis(sides, np.abs(sides).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)
    kept = np.flatnonzero(own)[:components]
    fit.variances = values**2 / max(fit.n, 1)
    fit.basis = sides[:, kept] / np.sqrt(fit.variances[kept])
    return fit


def whiten(
    embeddings: DataFrame,
    components: int = 32,
    scale: float = 64.0,
    shift: int = 1_000_000,
    width: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    Entries become integers floor(scale * c) + shift. Components are numbered from 1 by falling variance; whitened is the
    centred row on the component over the square root of its variance, explained the share of the total variance,
    identity_error the largest entry of the whitened rows' covariance minus the identity, measured in a pass of its own.
    deviation is the exact sum of (n * x - sum) squared, null where it is no long.

    Vectors that are null or hold null or non-finite entries are left out, as are those of another width than the most
    frequent (of two as frequent ones the larger). Components without variance (constant or dependent entries, a single
    row) have no rows. Repeated rows each count and each have their rows; a null vec_id stays null; variances that are
    equal leave the choice of their components open. An empty table gives no rows; other columns are not read.
    """
    rows = clean_vectors(embeddings, id_col, vector_col)
    if width is None:
        common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = common["width"] if common else 0
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == width)
    vectors = rows.select("vector")
    fit = fit_components(vectors, width, components, scale, shift)
    m = fit.basis.shape[1]
    error = float(np.abs(gram(vectors, width, fit, fit.basis) / fit.n - np.eye(m)).max()) if m else 0.0
    explained = (fit.variances[:m] / fit.variances.sum()).tolist() if m else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 1 << 20):
            off = offsets(integers(entries(batch.column(1), width), fit.scale, fit.shift), fit)
            small = off.dtype != object and int(np.abs(off).max(initial=0)) < int((2**62 / width) ** 0.5)
            squares = (off * off).sum(axis=1) if small else [sum(int(v) ** 2 for v in row) for row in off]
            deviation = pa.array([v if v < 1 << 63 else None for v in map(int, squares)], pa.int64())
            white = (off / fit.n).astype(np.float64) @ fit.basis
            each = np.repeat(np.arange(len(off)), m)
            yield {
                "vec_id": batch.column(0).take(pa.array(each)),
                "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(off)),
                "n": np.full(len(each), fit.n),
                "deviation": deviation.take(pa.array(each)),
                "whitened": white.ravel(),
                "explained": np.tile(explained, len(off)),
                "identity_error": np.full(len(each), error),
            }

    return map_arrow(rows if m else rows.limit(0), run, schema)
