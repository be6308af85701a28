"""Whitening of vectors: TSQR of the centred distinct rows; the right vectors of the last R factor whiten."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, bounded, column, map_batches, pieces, quoted, schema_text, stage, without

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
#: Components at most.
COMPONENTS = 16
#: Factors that one task merges, and vectors of a QR step.
FAN, STEP = 8, 4096


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the integer vectors of these: not those that are null or empty, or hold nulls or non-finite entries."""
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n)), n)
    sound = n > 0
    sound[of[~np.isfinite(values)]] = False
    lengths = np.unique(n[sound]).tolist() or [0]
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and of {lengths[1]} entries have no common covariance")
    values = SCALE * values[sound[of]]
    if np.abs(values).max(initial=0) >= 2.0**62:
        raise OverflowError("an entry is too large for an integer of 64 bits")
    return sound, (np.floor(values).astype(np.int64) + OFFSET).reshape(int(sound.sum()), lengths[0])


def gaps(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(sums).max(initial=0)) // n + 1)
    if n * most >= 1 << 61:
        raise OverflowError("an entry times the number of vectors doesn't fit into 64 bits")
    return n * x - sums


def deviations(gap: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact; large numbers are multiplied as two halves, the largest one by one."""
    most, d = int(np.abs(gap).max(initial=0)), gap.shape[1]
    if most * most * d < 1 << 62:
        return (gap * gap).sum(1).tolist()
    if d <= 512 and ((most >> 26) + 1) ** 2 * d < 1 << 62:
        high, low = gap >> 26, gap & ((1 << 26) - 1)
        parts = [(a * b).sum(1).tolist() for a, b in ((high, high), (high, low), (low, low))]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts, strict=True)]
    return [sum(v * v for v in row) for row in gap.tolist()]


@dataclass
class Whitening:
    """What is fitted: ``n`` distinct vectors, their sums, and by falling variance the components as columns of ``axes``.

    ``values`` are the components' variances, ``rank`` of them more than rounding leaves; ``error`` is the largest
    absolute entry of the whitened fit list's covariance minus the identity (null without a component to whiten).
    """

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    rank: int
    error: float | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows, NaN in components without variance."""
        out = (gaps(x, self.n, self.sums) / self.n) @ self.axes
        out[:, : self.rank] /= np.sqrt(self.values[: self.rank])
        out[:, self.rank :] = np.nan
        return out

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from ``part long, value binary``: FAN neighbours at a time are merged in a task, level by level, in order.

    What a task gets, and what comes to the driver, doesn't depend on the number of parts.
    """
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return None

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN], "value": [merge([bytes(v) for v in pdf.value])]})

    level, width = parts, int(top) + 1
    while width > 1:
        level = level.groupBy(F.floor(F.col("part") / FAN).alias("_node")).applyInPandas(merged, "part long, value binary")
        width = -(-width // FAN)
    return bytes(level.collect()[0].value)  # one row


def _parts(fitted: DataFrame, dim: int, made: Callable[[Iterator[np.ndarray]], bytes | None], name: str) -> DataFrame:
    """``part, value``: what ``made`` gets out of each partition's vectors, which come in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = made(_blocks(batches, dim))
        if value is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], names=["part", "value"])

    return stage(fitted.select("raw").mapInArrow(run, "part long, value binary"), name)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors, STEP together (fewer of very long ones)."""
    step, held, rows = max(64, min(STEP, (32 << 20) // (8 * dim))), [], 0
    for batch in pieces(batches):
        x = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.int64).reshape(-1, dim)
        held.append(x)
        rows += len(x)
        if rows >= step:
            yield np.concatenate(held)
            held, rows = [], 0
    if held:
        yield np.concatenate(held)


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct integer vector once; None if there is none.

    1. Vectors become integers, and equal ones one row: the fit list, which is written.
    2. Exact sums of each entry.
    3. Each partition centres its rows by them, exactly before the one division, and keeps the R of its QR. R factors are
       merged in a tree; the last one, as large as an entry's count squared, comes to the driver. Its singular values are
       sqrt(n) times the standard deviations of the components and its right vectors are these, without a covariance.
    4. The covariance of the whitened fit list, centred in each partition and merged in a tree, is held against 1.

    Vectors of several lengths raise a ValueError, entries whose product with the number of vectors passes 61 bits an
    OverflowError. A component whose variance is no more than rounding (constant entries, fewer vectors than entries)
    can't be whitened: its values are null.
    """
    bounded(vectors.sparkSession)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = integers(batch.column("v"))
        return pa.record_batch([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["dim", "raw"])

    fitted = stage(map_batches(vectors.select(column(vector).alias("v")), whole, "dim int, raw binary").distinct(), "fit")
    dims = [r.dim for r in fitted.select("dim").distinct().limit(2).collect()]
    if not dims:
        return None
    if len(dims) > 1:
        raise ValueError(f"vectors of {min(dims)} and of {max(dims)} entries have no common covariance")
    dim = dims[0]

    def summed(blocks: Iterator[np.ndarray]) -> bytes | None:
        n, total = 0, [0] * dim
        for x in blocks:
            n, total = n + len(x), [a + b for a, b in zip(total, _exact(x), strict=True)]
        return _text([n, *total]) if n else None

    def added(parts: list[bytes]) -> bytes:
        return _text([sum(c) for c in zip(*map(_numbers, parts), strict=True)])

    n, *totals = _numbers(tree(_parts(fitted, dim, summed, "sums"), added))
    sums = np.array(totals, np.int64)  # raises where it doesn't fit

    def factor(blocks: Iterator[np.ndarray]) -> bytes | None:
        r = None
        for x in blocks:
            rows = gaps(x, n, sums) / n
            r = _triangle([rows] if r is None else [r, rows])
        return None if r is None else r.tobytes()

    def joined(parts: list[bytes]) -> bytes:
        return _triangle([np.frombuffer(p).reshape(-1, dim) for p in parts]).tobytes()

    last = np.frombuffer(tree(_parts(fitted, dim, factor, "factors"), joined)).reshape(-1, dim)
    _, s, right = np.linalg.svd(last, full_matrices=True)
    k = min(components, dim)
    values = np.zeros(dim)
    values[: len(s)] = s * s / n
    axes = right[:k].T.copy()
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)  # a sign that reruns share
    rank = min(k, int((s > s.max(initial=0) * np.finfo(float).eps * max(n, dim)).sum()) if s.max(initial=0) > 0 else 0)
    found = Whitening(n, sums, axes, values[:k], float(values.sum()), rank)
    if rank:
        found.error = _error(fitted, dim, found)
    return found


def _exact(x: np.ndarray) -> list[int]:
    """Sums of columns as numbers of any size: the upper and lower halves are summed apart."""
    return [(a << 32) + b for a, b in zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist(), strict=True)]


def _text(numbers: list[int]) -> bytes:
    return " ".join(map(str, numbers)).encode()


def _numbers(text: bytes) -> list[int]:
    return [int(x) for x in text.split()]


def _error(fitted: DataFrame, dim: int, found: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = found.rank

    def moments(blocks: Iterator[np.ndarray]) -> bytes | None:
        parts = []
        for x in blocks:
            w = found.of(x)[:, :k]
            mean = w.mean(0)
            parts.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes())
            if len(parts) == FAN:
                parts = [both(parts)]
        return both(parts) if parts else None

    def both(parts: list[bytes]) -> bytes:
        m = np.array([np.frombuffer(p) for p in parts])
        n, means, squares = m[:, 0], m[:, 1 : k + 1], m[:, k + 1 :].reshape(-1, k, k)
        mean = n @ means / n.sum()
        off = means - mean
        return np.concatenate([[n.sum()], mean, (squares.sum(0) + (off * n[:, None]).T @ off).ravel()]).tobytes()

    m = np.frombuffer(tree(_parts(fitted, dim, moments, "moments"), both))
    return float(np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """All columns of the rows that take part, and ``whitened`` array<double> and ``deviation`` decimal(38,0).

    These replace columns of the same names, whatever their case. ``whitened`` has the components in order, null where
    there is no variance; ``deviation`` is the sum over entries of (n * x - S)^2, exact. Repeated rows stay. Rows whose
    vector is null, empty, or holds null or non-finite entries are left out.
    """
    keep = without(vectors, "whitened", "deviation")
    schema = schema_text(vectors.select(*quoted(keep))) + ", whitened array<double>, deviation decimal(38,0)"

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        sound, x = integers(batch.column(vector))
        if not len(x):
            return pa.record_batch([pa.array([], batch.column(c).type) for c in keep] + [pa.array([], pa.list_(pa.float64())), pa.array([], pa.decimal128(38, 0))], names=[*keep, "whitened", "deviation"])
        gap, w = gaps(x, model.n, model.sums), model.of(x)
        lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel(), from_pandas=True))
        rows = batch.filter(pa.array(sound))
        return pa.record_batch([*(rows.column(c) for c in keep), lists, pa.array([Decimal(v) for v in deviations(gap)], pa.decimal128(38, 0))], names=[*keep, "whitened", "deviation"])

    return map_batches(vectors, made, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_whitening``: every row's first 16 whitened components. ``deviation`` is null where it passes a long."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whiten(vectors, model).select(as_long(vectors, "vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(F.array(*[F.lit(v).cast("double") for v in model.explained()]), F.col("place")).alias("explained"), F.lit(model.error).cast("double").alias("identity_error"),
    )
