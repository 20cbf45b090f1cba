"""Whitening of embeddings: leading eigenvectors by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acosh, ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.session import scratch_path

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the iterated block beyond the wanted ones, and columns drawn anew in each round.
GUARD, FRESH = 16, 4
#: Residual of an eigenpair, as a share of the largest eigenvalue, at which it is certified.
TOLERANCE = 2e-14
ROUNDS, LEAST_DEGREE, MOST_DEGREE, FIRST_DEGREE = 60, 4, 24, 8
#: Bytes of numbers in a block of vectors, and the largest absolute entry a block can hold.
BLOCK_BYTES, LARGEST = 4 << 20, float(1 << 52)
#: Sums of entries are kept as two longs: this many low bits, and the rest.
LOW_BITS = 26


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, one row a vector."""
    return (np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)) + SHIFT).astype(np.int64).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors, widths = batch.columns
        for width in pa.compute.unique(widths).to_pylist():
            mine = pa.compute.equal(widths, width)
            own, x = ids.filter(mine), _ints(vectors.filter(mine), width)
            step = max(1, BLOCK_BYTES // (8 * width))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                small = bool((np.abs(part) < 1 << 31).all())
                low = (part & ((1 << LOW_BITS) - 1)).sum(axis=0)
                high = (part >> LOW_BITS).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([width], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([small]),
                     pa.array([own.slice(at, step).to_pylist()], pa.list_(pa.int64())),
                     pa.array([part.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                     pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))],
                    names=["width", "n", "small", "ids", "x", "low", "high"])


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Blocks of x-vectors in the shared folder: a row holds some thousand vectors of one length as bytes."""
    spark = vectors.sparkSession
    v = F.col("v")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    path = scratch_path(spark, "whitening")
    (own.where(v.isNotNull() & good & (F.size(v) > 0)).select("id", "v", F.size(v).alias("width"))
     .mapInArrow(_blocks, "width int, n long, small boolean, ids array<long>, x binary, low array<long>, high array<long>")
     .write.parquet(path))
    return spark.read.parquet(path)


@dataclass
class Fit:
    """Rows, sums and the certified eigenpairs of a table of vectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int
    residual: float


def _integers(row: dict, width: int) -> np.ndarray:
    return np.frombuffer(row["x"], "<i4" if row["small"] else "<i8").astype(np.int64).reshape(-1, width)


class Centred:
    """Centring that loses nothing: x - S/n as (x - q) - r/n with the whole and the broken part of S/n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row; NULL where it is beyond a long."""
        apart = x - self.whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            z = self.n * apart - self.rest
            return (z * z).sum(axis=1).tolist()
        z = self.n * apart.astype(object) - self.rest.astype(object)
        return [int(s) if s < 1 << 63 else None for s in (z * z).sum(axis=1)]


def _summed(blocks: DataFrame, width: int, work) -> np.ndarray:
    """The sum over all blocks of ``work(x)``, a flat vector: tasks add their blocks, Spark adds the tasks' vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                part = work(_integers(row, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    rows = blocks.select("x", "small").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = dict(rows.collect())  # one number per entry of the vector, whatever the rows
    return np.array([out[k] for k in range(len(out))])


class Operator:
    """Products of the covariance with a narrow block, each one distributed pass over the centred vectors."""

    def __init__(self, blocks: DataFrame, width: int, centred: Centred):
        self.blocks, self.width, self.centred, self.passes = blocks, width, centred, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        centred = self.centred

        def work(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return (y.T @ (y @ q)).ravel()

        self.passes += 1
        return _summed(self.blocks, self.width, work).reshape(q.shape) / centred.n


def _filtered(apply: Operator, q: np.ndarray, locked: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of the covariance times ``q``, free of ``locked``: small on [low, high] of the spectrum, 1 at ``top``."""
    def free(x: np.ndarray) -> np.ndarray:
        return x - locked @ (locked.T @ x)

    middle, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - middle)
    before = free(q)
    now = free(apply(before) - middle * before) * (sigma / half)
    for _ in range(2, degree + 1):
        after = 1 / (2 / first - sigma)
        before, now = now, free(apply(now) - middle * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def eigenpairs(apply: Operator, width: int, wanted: int, trace: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, falling, their unit vectors as columns, and the largest residual.

    Each round filters the block, orthonormalises it by QR, and solves the projected problem
    (Rayleigh-Ritz). The damped interval ends at the smallest value the block keeps. It begins at zero
    in the first round, then at an estimate from what the block leaves of the trace; a direction below
    it would be raised by the filter, be seen in the next projected problem and lower the estimate.
    Leading pairs that are done are locked, so a dominant one doesn't drown the rest.
    Some columns are drawn anew in each round, so a direction the block had missed would come up. Ends when
    every wanted pair leaves a residual of TOLERANCE or the residuals, all below 100 TOLERANCE, fall no more.
    """
    drawn = np.random.default_rng(11)
    size = min(width, wanted + GUARD)
    q = np.linalg.qr(drawn.standard_normal((width, size)))[0]
    low, degree, last, least = 0.0, 0, np.inf, np.inf
    for _ in range(ROUNDS):
        vq = apply(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        ritz = q @ turn
        left = np.linalg.norm(vq @ turn - ritz * values, axis=0)
        worst = float(left[:wanted].max()) / max(values[0], np.finfo(float).tiny)
        done = worst <= TOLERANCE or (worst <= 100 * TOLERANCE and worst > last / 4)
        if done or values[0] <= 0 or len(values) == width:
            return values[:wanted], ritz[:, :wanted], worst
        keep, least = min(size, len(values)), min(least, values[-1])
        high = float(max(values[keep - 1], values[0] * 1e-12))
        if degree:  # what the block leaves of the trace is shared by the rest of the spectrum
            rest = (trace - values[:keep].sum()) / (width - keep)
            low = float(np.clip(min(2 * rest - high, 2 * least - high), 0.0, 0.99 * high))
        edge = (2 * values[min(wanted, keep) - 1] - high - low) / (high - low)
        want = max(worst / (TOLERANCE / 10), 10.0)
        degree = ceil(acosh(want) / acosh(edge)) if edge > 1.0001 else MOST_DEGREE
        degree = max(LEAST_DEGREE, min(degree, MOST_DEGREE if low else FIRST_DEGREE))
        lock = int(np.argmax(np.append(left[:wanted - 1] > TOLERANCE * values[0], True)))  # leading pairs that are done
        block = np.hstack([ritz[:, lock:keep], drawn.standard_normal((width, min(FRESH, width - keep)))])
        block = _filtered(apply, block, ritz[:, :lock], degree, low, high, float(values[lock]))
        q = np.linalg.qr(np.hstack([ritz[:, :lock], block]))[0]
        last = worst
    raise RuntimeError(f"eigenpairs not certified: residual {worst:.1e} after {apply.passes} passes")


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Sums and certified eigenpairs of the most frequent vector length (the longest of equally frequent); None without rows."""
    sizes = blocks.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if sizes is None:
        return None
    width, n = sizes["width"], sizes["n"]
    mine = blocks.where(F.col("width") == width)
    sums = [0] * width
    for part, bits in (("low", 0), ("high", LOW_BITS)):
        for r in mine.select(F.posexplode(part)).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect():
            sums[r["pos"]] += int(r["s"]) << bits
    centred = Centred(n, sums)
    trace = float(_summed(mine, width, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    apply = Operator(mine, width, centred)
    values, vectors, residual = eigenpairs(apply, width, min(components, width), trace)
    real = values > width * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    return Fit(n, sums, trace, values[real], vectors[:, real], apply.passes, residual)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    Vectors that are NULL or hold a NULL, NaN or infinite entry are left out, and so are empty ones,
    those with an entry of 2^42 or more, and those whose length is not the most frequent one (of
    equally frequent the longest). Repeated rows and NULL ids stay. Directions without variance give
    no component, so one row or equal rows give none, and so does an empty table. ``deviation`` is NULL
    beyond a long. Other columns play no part. Only sums as wide as a vector reach the driver.
    """
    spark = vectors.sparkSession
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    blocks = blocks_of(vectors, id_col, vector_col)
    found = fit(blocks, components)
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    width, k, n = len(found.sums), len(found.values), found.n
    centred, axes = Centred(n, found.sums), found.vectors / np.sqrt(found.values)
    mine = blocks.where(F.col("width") == width)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = _summed(mine, width, moments) / n
    spread = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    error, explained = float(np.abs(spread - np.eye(k)).max()), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _integers(row, width)
                m = len(x)
                deviation = pa.array(centred.deviation(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, n)), deviation.take(each), pa.array((centred(x) @ axes).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mine.select("ids", "x", "small").mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all ``embeddings``."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
