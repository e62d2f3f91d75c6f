"""Whitening of embeddings by shifted CholeskyQR.

The centred rows Y are orthogonalised by passes over all rows: each sums the Gram matrix of Y inv(R1) ... inv(Rk), where rows go through
triangular solves in the tasks, and the driver factors it. A shift keeps the first factorisation from failing whatever the condition of Y; the passes
behind it restore orthogonality. Y = Q R with R = Rk ... R1, so the singular values and right vectors of the small R are those of Y.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import saved
from sitequarry.llm.whole_vectors import matrix, whole_vectors

PASSES = 10
#: Rows of one batch that are centred and solved together.
STEP = 4096
#: A component whose singular value is a smaller share of the largest has no direction of its own in double precision.
LEAST = 1e-12


def solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y inv(r) for an upper triangular r: column by column, for all rows at once."""
    q = np.empty_like(y)
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they suffice, integers of any size elsewhere."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(diff: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; None if beyond 64 bits."""
    if diff.dtype != object and diff.size and int(np.abs(diff).max()) ** 2 * diff.shape[1] < 1 << 63:
        return (diff * diff).sum(axis=1).tolist()
    sums = (sum(d * d for d in row) for row in diff.astype(object).tolist())
    return [s if s < 1 << 63 else None for s in sums]


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


@dataclass
class Whitening:
    """Axes (a column for each component, largest variance first), their variances, and what they were fitted on."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float
    passes: int = 0
    identity_error: float | None = None
    factors: list[np.ndarray] = field(default_factory=list)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (differences(x, self.n, self.sums) / self.n).astype(np.float64)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def totals(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in steps(batches):
            x = matrix(batch.column("x"), d)  # below 2**53, so 1024 rows never overflow
            n += len(x)
            for a in range(0, len(x), 1000):
                sums = [s + t for s, t in zip(sums, x[a : a + 1000].sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d)), pa.array([str(s) for s in (n, *sums)])], names=["i", "s"])

    # d + 1 rows, whatever the input
    got = {r.i: int(r.s) for r in rows.select("x").mapInArrow(part, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def gram(rows: DataFrame, d: int, of, k: int) -> np.ndarray:
    """The sum over all rows of of(x).T @ of(x), a k by k matrix: each task sums its rows, Spark adds the sums."""
    i, j = np.triu_indices(k)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in steps(batches):
            q = of(matrix(batch.column("x"), d))
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(i * k + j), pa.array(total[i, j])], names=["place", "v"])

    out = np.zeros((k, k))
    # k * (k + 1) / 2 rows, whatever the input
    for r in rows.select("x").mapInArrow(part, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r.place // k, r.place % k] = out[r.place % k, r.place // k] = r.v
    return out


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of g, shifted as far as it takes."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-15 * max(np.trace(g), 1e-300))


def fit(rows: DataFrame, d: int, components: int) -> Whitening:
    """Fits on the column x of all rows. Reads them once for sums, once for each Gram pass and once to measure the result.

    Directions without variance (constant or dependent dimensions, one row) get no component, so there may be fewer than asked for.
    """
    n, sums = totals(rows, d)
    model = Whitening(n, sums, np.empty((d, 0)), np.empty(0), 0.0)
    if not n:
        return model
    unit = np.finfo(float).eps / 2
    r = np.eye(d)
    for k in range(PASSES):
        factors = list(model.factors)

        def orthogonal(x: np.ndarray, factors=factors) -> np.ndarray:
            y = model.centred(x)
            for f in factors:
                y = solved(y, f)
            return y

        g = gram(rows, d, orthogonal, d)
        model.passes += 1
        own = np.linalg.eigvalsh(g)
        if own[-1] <= 0:
            return model
        # directions are orthonormal now, or have no length at all
        if k and np.all((np.abs(own - 1) < 1e-11) | (np.abs(own) < 1e-6)):
            break
        shift = min(11 * (n * d + d * (d + 1)) * unit, 1e-2) * own[-1] if k == 0 else 0.0
        model.factors.append(factor(g, shift))
        r = model.factors[-1] @ r
    _, values, axes = np.linalg.svd(r)
    keep = (np.arange(d) < components) & (values > LEAST * d * values[0])
    model.axes = axes[keep].T
    flip = np.sign(model.axes[np.abs(model.axes).argmax(axis=0), np.arange(model.axes.shape[1])])
    model.axes = model.axes * flip
    model.variances, model.total = values[keep] ** 2 / n, float((values**2).sum() / n)
    k = len(model.variances)
    if k:
        model.identity_error = float(np.abs(gram(rows, d, model.apply, k) / n - np.eye(k)).max())
    return model


def whitened(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, components: int = 8) -> tuple[DataFrame, Whitening]:
    """vec_id, deviation, whitened (array of up to `components` numbers) of each usable row, and the fitted model.

    Components c become floor(scale * c) + shift. whole_vectors says which rows are usable; rows that repeat a vec_id and those without one count like any.
    deviation, the exact sum of (n * x - sum)^2, is null where 64 bits can't hold it. No usable row gives no rows.
    """
    rows, d = whole_vectors(vectors, scale, shift, vec_id=F.col("vec_id"))
    rows = saved(rows, "whole-vectors")
    model = fit(rows, d, components)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = matrix(batch.column("x"), d)
            out = model.apply(x)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32) if out.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(differences(x, model.n, model.sums)), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(each, f"vec_id {kind}, deviation long, whitened array<double>"), model


def components_of(vectors: DataFrame, **how) -> DataFrame:
    """A row per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, model = whitened(vectors, **how)
    explained = F.array(*(F.lit(float(v / model.total)) for v in model.variances)).cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("k")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
