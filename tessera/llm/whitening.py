"""Whitening by Chebyshev-filtered subspace iteration over distributed products.

Entries become whole numbers x = floor(scale * entry) + shift, so sums are exact. With the distinct
vectors' mean m, one pass gives XᵀX Q / n of the centred vectors X: every task multiplies its rows
block by block, centred before multiplying, and the tasks' sums are added by Spark, cell by cell. A few
Lanczos steps bound the spectrum from below; then each round turns the block Q by a Chebyshev
polynomial in the covariance, whose recurrence damps what lies between that bound and the block's
smallest Ritz value, and takes Q by QR and Rayleigh-Ritz. It ends when the wanted pairs are certified:
their residuals |V q - e q| are within `tolerance` of the largest e, and no longer halve. Only blocks
of dimensions x columns reach the driver.

Centring is exact: n * x - S is a whole number, divided once. `deviation` is the exact sum of its squares; NULL
where that exceeds a long.

Defined cases: vectors that are NULL or empty, hold a NULL or non-finite entry, or one that doesn't fit a
whole number (2^53 or more after scaling) are left out. Vectors of other lengths are tables of their own. Where fewer components have variance
(few distinct vectors, constant dimensions), only these are given; no row where none has. NULL ids and
repeated rows get their rows. Extra columns aren't read. An empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

ROWS = 8192  # multiplied at once


@dataclass
class Whitening:
    """What is fitted: n distinct vectors, sums by dimension, components (columns, unit length), their variances, the trace, and the error of the whitened covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector takes part."""
    fits = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < 2.0**53, F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fits), F.lit(False))


def whole_numbers(vectors: DataFrame, id_col: str, vector: str, scale: int, shift: int) -> DataFrame:
    """id, x and length of the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * float(scale)).cast("long") + shift)
    rows = vectors.where(usable(F.col(vector), float(scale))).select(F.col(id_col).alias("id"), x.alias("x"))
    return rows.withColumn("length", F.size("x"))


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for b in batches:
        x = b.column(b.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        for k in range(0, len(x), ROWS):
            yield x[k : k + ROWS]


def _cells(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _added(rows: DataFrame, task, shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum of the arrays that the tasks give."""
    found = rows.select("x").mapInArrow(task, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r.cell] = r.value
    return out.reshape(shape)


def _summing(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, length):
            total = x.sum(axis=0) + (0 if total is None else total)
        yield from _cells(total)

    return run


def _products(n: int, sums: np.ndarray, block: np.ndarray):
    """Task of XᵀX Q / n; the first column's square sums, which give the trace, are columns of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, len(sums)):
            c = _centred(x, n, sums)
            part = np.column_stack([c.T @ (c @ block), (c * c).sum(axis=0)]) / n
            total = part if total is None else total + part
        yield from _cells(total)

    return run


def _grams(fit: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, len(fit.sums)):
            w = _whitened(x, fit)
            total = w.T @ w / fit.n + (0 if total is None else total)
        yield from _cells(total)

    return run


def _whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    return (_centred(x, fit.n, fit.sums) @ fit.components) / np.sqrt(fit.variances)


def _lowest(product, size: int, steps: int, rng: np.random.Generator) -> float:
    """A bound that few or no eigenvalues are below: the smallest Ritz value of Lanczos steps less its residual."""
    q = rng.standard_normal(size)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, size)):
        w = product(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        for _ in range(2):  # against all earlier vectors, twice
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
    return max(0.0, float(values[0] - betas[k - 1] * abs(vectors[-1, 0])))


def _filtered(product, block: np.ndarray, image: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The block under the Chebyshev polynomial of [low, cut], scaled to 1 at top; image is its product."""
    centre, half = (low + cut) / 2, (cut - low) / 2
    sigma = first = half / (top - centre)
    before, now = block, (image - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, 2 * (new / half) * (product(now) - centre * now) - (sigma * new) * before
        sigma = new
    return now


def top_components(product, size: int, wanted: int, extra: int = 16, degree: int = 8, most_rounds: int = 60, tolerance: float = 1e-13, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the matrix that product multiplies a block by: the `wanted` largest, certified."""
    rng = np.random.default_rng(seed)
    width, wanted = min(size, wanted + extra), min(size, wanted)
    low = _lowest(product, size, 12, rng) if width < size else 0.0
    block, last = np.linalg.qr(rng.standard_normal((size, width)))[0], np.inf
    for _ in range(most_rounds):
        image = product(block)
        h = block.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        if values[0] <= 0:
            return values[:wanted], block[:, :wanted]
        worst = float(np.linalg.norm(image - block * values, axis=0)[:wanted].max() / values[0])
        if worst <= tolerance and (worst > last / 2 or worst <= 1e-15):
            return values[:wanted], block[:, :wanted]
        last = worst
        cut = values[-1]
        if width < size and cut > low and values[0] > cut:
            block = _filtered(product, block, image, low, cut, values[0], degree)
        block = np.linalg.qr(block)[0]
    raise RuntimeError(f"top_components: residual {last:.3g} of the largest value after {most_rounds} rounds")


def fit(distinct: DataFrame, length: int, most: int = 16) -> Whitening | None:
    """The whitening of distinct vectors x of one length; None without any variance."""
    n = distinct.count()
    sums = _added(distinct, _summing(length), (length,), "long")
    found = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        out = _added(distinct, _products(n, sums, block), (length, block.shape[1] + 1))
        found.trace, found.passes = float(out[:, -1].sum()), found.passes + 1
        return out[:, :-1]

    values, vectors = top_components(product, length, most)
    real = values > 1e-12 * found.trace
    if not real.any():
        return None
    found.variances, found.components = values[real], vectors[:, real]
    k = len(found.variances)
    found.identity_error = float(np.abs(_added(distinct, _grams(found), (k, k)) - np.eye(k)).max())
    return found


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of squares of n * x - S of every row, exact; NULL where it exceeds a long."""
    gap = n * x - sums
    if len(gap) and float(np.abs(gap).max()) ** 2 * gap.shape[1] < 2.0**62:
        return pa.array((gap * gap).sum(axis=1))
    exact = (sum(v * v for v in row) for row in gap.tolist())
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitening(found: Whitening):
    """Arrow function of rows (id, x): a row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.variances)
        shares = found.variances / found.trace
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = next(_blocks(iter([part]), len(found.sums)))
                rows = pa.array(np.repeat(np.arange(len(x)), k))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                same = lambda v, c=component: pa.array(np.full(len(c), v))
                made = [pa.array(component), same(found.n), _deviations(x, found.n, found.sums).take(rows), pa.array(_whitened(x, found).ravel()), pa.array(np.tile(shares, len(x))), same(found.identity_error)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *made], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id_col, component (from 1, by falling variance), n, deviation, whitened, explained and identity_error of every vector that takes part."""
    rows = stored(whole_numbers(vectors, id_col, vector, scale, shift), "whole-numbers")
    distinct = stored(rows.select("x", "length").distinct(), "distinct-vectors")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = [r.length for r in distinct.select("length").distinct().orderBy("length").collect()]
    parts = [(m, fit(distinct.where(F.col("length") == m), m, most)) for m in lengths]
    out = [rows.where(F.col("length") == m).select("id", "x").mapInArrow(whitening(f), schema) for m, f in parts if f]
    out = out or [rows.sparkSession.createDataFrame([], schema)]
    return functools.reduce(DataFrame.unionByName, out).withColumnRenamed("id", id_col)
