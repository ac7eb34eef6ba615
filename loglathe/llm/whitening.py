"""Whitening of embeddings by spectrum slicing.

The covariance of the vectors is summed up in Spark in two passes: exact sums of
whole numbers first, then products of values that are centred exactly before
they are multiplied. The matrix (its side is the width of a vector, whatever the
number of rows) is brought to tridiagonal form by reflections, which keep its
eigenvalues. The LDL' factors of the shifted matrix have as many positive pivots
as there are eigenvalues above the shift; bisection by these counts isolates
each leading eigenvalue, Rayleigh quotient iteration within the interval finds
it with its vector (it converges cubically), and counts just below and just
above the result certify its number. Where eigenvalues are so close that no
interval holds one alone, their vectors are kept orthogonal to each other, and
the counts certify the whole group.

A vector's entry c is the whole number x = floor(64 c) + 1000000.

Defined results: rows whose vector is null or holds a null or a number that isn't
finite are left out; a vector shorter than the longest counts as filled up with
zeros; entries count within +-2^40; null ids and repeated rows are rows like all
others; equal eigenvalues have some orthonormal basis, the same for all rows;
components without variance (beside the trace) aren't returned, since nothing
scales them to one; a deviation beyond 64 bits is null; an empty table or one
vector alone gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, small_batches

SCALE, SHIFT, MOST = 64.0, 1_000_000, 2.0**40
ROWS = 4096  # vectors taken at once
BLOCK = 64  # rows of the matrix in one row of a partial sum


def _vectors(batch: pa.RecordBatch, column: str) -> pa.ListArray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.list_(pa.float64()))


def _usable(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are usable, their sizes, their starts in the entries, the entries)."""
    flat = vectors.flatten()
    entries = flat.to_numpy(zero_copy_only=False)
    there = np.asarray(vectors.is_valid())
    sizes = np.where(there, np.asarray(vectors.value_lengths().fill_null(0)), 0).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])  # nulls come as NaN
    rows = np.nonzero(there & (wrong[starts + sizes] == wrong[starts]))[0]
    return rows, sizes[rows], starts[rows], entries


def _matrix(sizes: np.ndarray, starts: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers of the vectors, one row each."""
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == width).all():
        out[:] = entries[starts[:, None] + np.arange(width)]
    else:
        for size in np.unique(sizes):
            rows = np.nonzero(sizes == size)[0]
            out[rows[:, None], np.arange(size)] = entries[starts[rows][:, None] + np.arange(size)]
    return np.floor(SCALE * np.clip(out, -MOST, MOST)).astype(np.int64) + SHIFT


def _parts(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            rows, sizes, starts, entries = _usable(_vectors(piece, column))
            yield piece, rows, sizes, starts, entries


def moments(vectors: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(number of usable vectors, exact sum of each dimension)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, filled = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, rows, sizes, starts, entries in _parts(batches, column):
            if not len(rows):
                continue
            width = max(len(total), int(sizes.max()))
            grown = lambda a, w=width: np.concatenate([a, np.zeros(w - len(a), np.int64)])
            total, filled = grown(total), grown(filled)
            x = _matrix(sizes, starts, entries, width) - SHIFT
            n, total = n + len(rows), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(-1, len(total))), "total": pa.array(np.concatenate([[n], total]))})

    parts = vectors.select(column).mapInArrow(sums, "dim long, total long")
    rows = parts.groupBy("dim").agg(F.sum("total").alias("total")).collect()  # one row a dimension
    found = {r["dim"]: r["total"] for r in rows}
    n = found.pop(-1, 0)
    return n, np.array([found[k] + n * SHIFT for k in range(len(found))], dtype=object)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits if it fits, else in Python's integers."""
    low = [int(v) // n for v in sums]  # S = n low + rest
    rest = np.array([int(v) - n * k for v, k in zip(sums, low, strict=True)], dtype=object)
    near = x - np.array(low, dtype=np.int64)
    if len(near) == 0 or n * (int(np.abs(near).max()) + 1) < 2**62:
        return n * near - rest.astype(np.int64)
    return near.astype(object) * n - rest


def covariance(vectors: DataFrame, column: str, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of products of centred values over n, in double precision."""
    width = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for _, rows, sizes, starts, entries in _parts(batches, column):
            if len(rows):
                centred = _exact(_matrix(sizes, starts, entries, width), n, sums).astype(np.float64) / n
                total, seen = total + centred.T @ centred, True
        if seen:
            for at in range(0, width, BLOCK):
                block = total[at : at + BLOCK]
                yield pa.RecordBatch.from_pydict({"row": pa.array(range(at, at + len(block))), "values": _lists(block)})

    return _summed(vectors.select(column).mapInArrow(products, "row long, values array<double>"), width) / n


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Rows of partial matrices summed up entry by entry; what is collected is one matrix."""
    cells = parts.select("row", F.posexplode("values").alias("col", "value")).groupBy("row", "col").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("all")).collect():
        out[r["row"]] = [c["value"] for c in r["all"]]
    return (out + out.T) / 2


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, entries beside it) of a similar tridiagonal matrix, by Householder reflections."""
    a = matrix.astype(np.float64).copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = p - (v @ p) * v
        rest -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, beside: np.ndarray, shifts) -> np.ndarray:
    """How many eigenvalues are above each shift: positive pivots of the LDL' factors of T - shift."""
    shifts = np.atleast_1d(np.asarray(shifts, dtype=np.float64))
    least = np.finfo(np.float64).tiny * max(1.0, float(np.max(beside**2, initial=0.0)))
    count, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shifts - (beside[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def _quotient_iteration(matrix: np.ndarray, start: float, low: float, high: float, before: np.ndarray, scale: float, seed: int) -> tuple[float, np.ndarray, float]:
    """(value, vector, residual) by Rayleigh quotient iteration that stays in an interval, orthogonal to ``before``."""
    size = len(matrix)
    v = np.random.default_rng(seed).standard_normal(size)
    value, eye, best = start, np.eye(size), None

    def cleaned(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - before.T @ (before @ x)
        return x / np.linalg.norm(x)

    v = cleaned(v)
    for step in range(30):
        shifted = matrix - value * eye
        try:
            v = cleaned(np.linalg.solve(shifted, v))
        except np.linalg.LinAlgError:
            v = cleaned(np.linalg.solve(shifted + np.finfo(np.float64).eps * scale * eye, v))
        quotient = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - quotient * v))
        if best is None or residual < best[2]:
            best = quotient, v, residual
        if residual <= 1e-14 * scale:
            break
        # until the quotient is in the interval, the shift stays where the counts have put it
        value = quotient if step and low < quotient < high else start
    return best


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the leading eigenpairs with variance, by falling value."""
    size = len(matrix)
    trace = float(np.trace(matrix))
    if size == 0 or trace <= 0:
        return np.zeros(0), np.zeros((0, size))
    diagonal, beside = tridiagonal(matrix)
    reach = np.abs(np.concatenate([[0.0], beside])) + np.abs(np.concatenate([beside, [0.0]]))
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    scale = max(abs(low), abs(high))
    narrow, floor = 1e-13 * scale, 1e-12 * trace
    wanted = min(most, int(above(diagonal, beside, floor)[0]))
    lows, highs = np.full(wanted, low - narrow), np.full(wanted, high + narrow)
    number = np.arange(1, wanted + 1)
    at_low, at_high = np.full(wanted, size), np.zeros(wanted, np.int64)
    # each interval (low, high] holds the eigenvalue of its number: count(low) >= number > count(high)
    while True:
        alone = (at_low - at_high == 1) & (highs - lows < 1e-3 * scale)
        open_ = ~alone & (highs - lows > narrow)
        if not open_.any():
            break
        middle = (lows + highs) / 2
        count = above(diagonal, beside, middle)
        upper = open_ & (count >= number)
        lower = open_ & (count < number)
        lows, at_low = np.where(upper, middle, lows), np.where(upper, count, at_low)
        highs, at_high = np.where(lower, middle, highs), np.where(lower, count, at_high)
    values, vectors = np.zeros(wanted), np.zeros((wanted, size))
    for k in range(wanted):
        lo, hi = float(lows[k]), float(highs[k])
        while True:
            values[k], vectors[k], residual = _quotient_iteration(matrix, (lo + hi) / 2, lo, hi, vectors[:k], scale, k)
            inside = lo - narrow <= values[k] <= hi + narrow
            if inside and residual <= 1e-10 * scale or hi - lo <= narrow:
                break
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if above(diagonal, beside, middle)[0] > k else (lo, middle)
    certified(diagonal, beside, values, 1e-9 * scale)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


def certified(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, slack: float) -> None:
    """An error unless the counts on both sides of each value agree with its number."""
    ordered = np.sort(values)[::-1]
    number = np.arange(1, len(values) + 1)
    under, over = above(diagonal, beside, ordered - slack), above(diagonal, beside, ordered + slack)
    if not ((under >= number) & (over < number)).all():
        raise ArithmeticError("eigenvalue counts don't agree with the numbers of the components")


def whitened(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each usable vector and leading component."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("vector"))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = moments(vectors, "vector")
    matrix = covariance(vectors, "vector", n, sums) if n and len(sums) else np.zeros((0, 0))
    values, axes = leading(matrix, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = (axes / np.sqrt(values)[:, None]).T
    width, kept = len(sums), len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows, sizes, starts, entries in _parts(batches, "vector"):
            if len(rows):
                exact = _exact(_matrix(sizes, starts, entries, width), n, sums)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows)), _deviations(exact), _lists((exact.astype(np.float64) / n) @ turn)], ["vec_id", "deviation", "all"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, kept)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(kept + 1)), "values": _lists(total)})

    out = saved(vectors.mapInArrow(project, f"vec_id {id_type}, deviation long, all array<double>"), "whitened")
    cells = out.select("all").mapInArrow(errors, "row long, values array<double>").select("row", F.posexplode("values").alias("col", "value"))
    found = np.zeros((kept + 1, kept))
    for r in cells.groupBy("row", "col").agg(F.sum("value").alias("value")).collect():  # one small matrix
        found[r["row"], r["col"]] = r["value"] / n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(kept)).max())
    shares = F.array(*[F.lit(float(v / np.trace(matrix))) for v in values])
    rows = out.select("vec_id", "deviation", F.posexplode("all").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))


def _deviations(exact: np.ndarray) -> pa.Array:
    """Sums of squares, exact; null where 64 bits don't hold them."""
    if exact.dtype != object and (len(exact) == 0 or exact.shape[1] * int(np.abs(exact).max()) ** 2 < 2**63):
        return pa.array((exact * exact).sum(axis=1), pa.int64())
    sums = [sum(int(v) * int(v) for v in row) for row in exact]
    return pa.array([s if s < 2**63 else None for s in sums], pa.int64())


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))
