"""Embedding whitening: leading principal axes by spectrum slicing.

Entries become integers, so sums are exact. Tasks add up the covariance of the distinct vectors around their exact mean;
its size is the dimension squared, whatever the number of rows. Eigenvalues are isolated by counting: the LDL^T factors of
covariance - s I have as many negative pivots as there are eigenvalues below s. Rayleigh quotient iteration then converges to
the eigenvector, and the counts on both sides of each eigenvalue certify that it is the one of that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import stored

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
ROWS = 4_096  # vectors that are worked on at a time
SAFE = 1 << 62


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _quantised(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """vec_id and the integers as bytes; entries beyond 64 bits take the outermost number."""
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        scaled = np.floor(values * SCALE)
        x = np.where(abs(scaled) < 2.0**62, scaled, 0).astype(np.int64)
        x = np.where(abs(scaled) < 2.0**62, x, np.where(scaled > 0, SAFE, -SAFE)) + SHIFT
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["vec_id", "x"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64 bits where it fits, else in Python's integers."""
    bound = n * max(int(abs(x).max(initial=0)), 1) + max((abs(int(s)) for s in sums), default=0)
    if bound < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per dimension the sums of high and low halves of the integers, which fit 64 bits for 2^31 rows of a task."""
    n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
    for batch in batches:
        x = _vectors(batch.column(0), width)
        n += len(x)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(width)), "n": pa.array(np.full(width, n)), "high": pa.array(high), "low": pa.array(low)})


def _products(batches: Iterator[pa.RecordBatch], width: int, n: int, sums: list[int], axes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One task's part of the covariance of the vectors, or of their whitened values: (row, its entries)."""
    size = width if axes is None else axes.shape[1]
    total = np.zeros((size, size))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            y = (centred(_vectors(batch.column(0).slice(at, ROWS), width), n, sums) / n).astype(np.float64)
            y = y if axes is None else y @ axes
            total += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total / n), pa.list_(pa.float64()))], names=["i", "row"])


def _covariance(fit: DataFrame, width: int, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    size = width if axes is None else axes.shape[1]
    parts = fit.mapInArrow(lambda b: _products(b, width, n, sums, axes), "i long, row array<double>")
    added = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for i, j, v in added.collect():  # dimension squared
        out[i, j] = v
    return (out + out.T) / 2


def below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues under ``shift``: negative pivots of an LDL^T factorisation with pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    count, ratio = 0, (1 + 17**0.5) / 8
    while len(a):
        side = np.abs(a[1:, 0])
        far = int(side.argmax()) + 1 if len(side) else 0
        beside = side[far - 1] if far else 0.0
        pair = False
        if abs(a[0, 0]) < ratio * beside:
            others = np.abs(a[:, far])
            others[far] = 0
            widest = others.max()
            if abs(a[0, 0]) * widest < ratio * beside * beside:
                pair = bool(abs(a[far, far]) < ratio * widest)
                swap = (1, far) if pair else (0, far)
                a[list(swap)] = a[list(swap[::-1])]
                a[:, list(swap)] = a[:, list(swap[::-1])]
        if pair:  # chosen only where the determinant is negative: one root on each side of zero
            count += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        else:
            count += int(a[0, 0] < 0)
            a = a[1:, 1:] - (np.outer(a[1:, 0], a[1:, 0] / a[0, 0]) if a[0, 0] else 0)
    return count


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those that vanish are left out.

    A value is bracketed by counts until nothing else is inside (or, for equal ones, the bracket has shrunk to rounding), then
    refined by Rayleigh quotient iteration, kept orthogonal to the vectors found before.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0))
    tiny = max(size, 8) * np.finfo(float).eps * scale
    values: list[float] = []
    vectors = np.zeros((size, 0))
    if not scale or not np.isfinite(scale):
        return np.zeros(0), vectors
    counts: dict[float, int] = {}

    def under(shift: float) -> int:
        if shift not in counts:
            counts[shift] = below(matrix, shift)
        return counts[shift]

    for number in range(min(wanted, size)):
        place = size - 1 - number  # so many eigenvalues are smaller
        low, high = -tiny, scale + tiny
        for shift, count in counts.items():  # what earlier counts tell
            low, high = (max(low, shift), high) if count <= place else (low, min(high, shift))
        while high - low > 4 * tiny and not (under(low) == place and under(high) == place + 1 and low > 0):
            middle = (low + high) / 2
            low, high = (middle, high) if under(middle) <= place else (low, middle)
        if high <= 4 * tiny:
            break
        pair = _refined(matrix, low, high, vectors, tiny, number)
        while pair is None and high - low > tiny:  # its middle was nearer to a value outside
            for _ in range(3):
                middle = (low + high) / 2
                low, high = (middle, high) if under(middle) <= place else (low, middle)
            pair = _refined(matrix, low, high, vectors, tiny, number)
        if pair is None:
            raise ArithmeticError(f"no eigenvector found for eigenvalue {number + 1}")
        value, vector = pair
        if not under(value - 8 * tiny) <= place < under(value + 8 * tiny):
            raise ArithmeticError(f"eigenvalue {number + 1} is not confirmed by its counts")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _refined(matrix: np.ndarray, low: float, high: float, found: np.ndarray, tiny: float, seed: int) -> tuple[float, np.ndarray] | None:
    """The eigenpair inside the bracket, if found: inverse iteration from its middle, then Rayleigh quotients as shifts."""
    size = len(matrix)
    vector = np.random.default_rng(seed).standard_normal(size)
    shift, best = (low + high) / 2, (np.inf, 0.0, vector)
    for turn in range(20):
        vector = vector - found @ (found.T @ vector)
        vector /= np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        inside = low - 4 * tiny <= value <= high + 4 * tiny
        if inside and residual < best[0]:
            best = (residual, value, vector)
        elif best[0] <= 16 * tiny:
            break
        # a quotient outside of the bracket, or still far from an eigenpair, would lead to another eigenvalue
        if turn > 1 and inside and residual < (high - low) / 2 + 4 * tiny:
            shift = value
        try:
            vector = np.linalg.solve(matrix - shift * np.eye(size), vector)
        except np.linalg.LinAlgError:
            vector = np.linalg.solve(matrix - (shift + tiny) * np.eye(size), vector)
    return (best[1], best[2]) if best[0] <= 64 * tiny else None


def _whitened(batches: Iterator[pa.RecordBatch], width: int, n: int, sums: list[int], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    count = axes.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            y = centred(_vectors(part.column(1), width), n, sums)
            if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * width >= SAFE:
                exact = (y.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())
            else:
                deviation = pa.array((y * y).sum(axis=1))
            white = (y / n).astype(np.float64) @ axes
            rows = np.repeat(np.arange(len(y)), count)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))),
                 deviation.take(pa.array(rows)), pa.array(white.ravel())], names=["vec_id", "component", "deviation", "whitened"])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of another length than
    the most frequent one (of equally frequent ones the longer). The fit list holds each distinct integer vector once, so a
    large group of copies weighs as much as one; repeated rows get equal results. Directions without variance
    (eigenvalue 0 to rounding) cannot be whitened and are not returned, so one distinct vector alone gives an empty result, as
    does an empty table. ``deviation`` is null where it exceeds 64 bits. Equal eigenvalues get orthogonal axes of
    their common space. A null vec_id is carried along. Other columns are ignored; a text plays no part.
    """
    spark = embeddings.sparkSession
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = usable.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("width")).first()
    if not common:
        return spark.createDataFrame([], schema)
    width = common.width
    rows = stored(usable.where(F.size("v") == width).mapInArrow(lambda b: _quantised(b, width), "vec_id long, x binary"), "integers")
    fit = stored(rows.select("x").distinct(), "fit")
    parts = fit.mapInArrow(lambda b: _sums(b, width), "dim long, n long, high long, low long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    told = sorted(parts.groupBy("dim").agg(*whole).collect())  # one row per dimension
    n, sums = int(told[0].n), [int(r.high) * (1 << 32) + int(r.low) for r in told]
    covariance = _covariance(fit, width, n, sums)
    values, vectors = leading(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    axes = vectors / np.sqrt(values)
    error = float(np.abs(_covariance(fit, width, n, sums, axes) - np.eye(len(values))).max())
    explained = F.element_at(F.array(*[F.lit(float(v / np.trace(covariance))) for v in values]), F.col("component"))
    white = rows.mapInArrow(lambda b: _whitened(b, width, n, sums, axes), "vec_id long, component int, deviation long, whitened double")
    return white.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
                        F.lit(error).alias("identity_error"))
