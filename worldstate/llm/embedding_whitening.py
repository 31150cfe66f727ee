"""Whitening of embeddings by a one-sided Jacobi SVD of what a blockwise QR leaves of the centred rows.

1. Vectors become whole numbers x = floor(scale * c). Each distinct x counts once: the fit list, n rows, written to the
   shared folder. Its sums S and n are exact; they come from partial sums of each task.
2. TSQR: a task centres its rows (x - S / n) block by block, stacks each block on the triangle of those before and
   takes the triangle R of the whole. Triangles meet in a tree, FAN of them at a time, until one is left. Every step
   holds BLOCK rows or FAN triangles of d * d numbers. R has the singular values and right vectors of all centred rows, and
   no product of the rows with themselves is formed, which would square the condition.
3. One-sided Jacobi: plane rotations make R's columns orthogonal, d / 2 disjoint pairs at a time in the order of a
   round-robin tournament, until no pair has a cosine above TOLERANCE. The rotations' product is the components, the columns'
   lengths over sqrt(n) are the standard deviations, with a small relative error also for small ones.
4. Rows are projected where they stand, by a broadcast of d * k numbers.

The driver sees n, S, one triangle and the covariance of what was whitened: d * d numbers at most, never rows.

Defined cases: null vectors and those with null or non-finite entries take no part, nor do empty ones; of vectors of
several lengths those of the most frequent length do (the shortest of several). Repeated rows are each returned and
fitted once. A component without variance (equal rows, fewer distinct rows than dimensions) is returned with a null
whitened and isn't in identity_error. Fewer than k dimensions give fewer components; an empty table gives no rows. A
deviation beyond a long is null. Columns of the result's names are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
#: Rows of a block, triangles that meet at once, cosine that counts as none, most sweeps over all pairs.
BLOCK, FAN, TOLERANCE, SWEEPS = 4096, 16, 1e-15, 60
LONG = 2**63


def whole(vector: Column, scale: int = SCALE) -> Column:
    """x for each entry; null where a vector takes no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                small = np.abs(x).max() < LONG // (2 * len(x))
                own = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
                total, n = own if total is None else total + own, n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    parts = fit.select("x").mapInArrow(partial, "n long, s array<string>")
    found = parts.select("n", F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _as_batch(r: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows of the fit list, up to signs of its rows."""
    d = len(mean)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.empty((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = _triangle(np.vstack([r, _matrix(batch.column("x").slice(at, BLOCK)) - mean]))
        if len(r):
            yield _as_batch(r, TaskContext.get().partitionId())

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        r = np.empty((0, d))
        for row in table.column("r").to_pylist():
            r = _triangle(np.vstack([r, np.asarray(row).reshape(-1, d)]))
        return pa.Table.from_batches([_as_batch(r, key[0].as_py())])

    left, parts = fit.select("x").mapInArrow(blocks, "part long, r array<double>"), fit.rdd.getNumPartitions()
    while parts > 1:
        left = left.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(meet, "part long, r array<double>")
        parts = -(-parts // FAN)
    return np.asarray(left.first().r).reshape(-1, d)


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns in d - 1 (odd d: d) rounds of disjoint ones."""
    even = d + d % 2
    ring = list(range(even))
    for _ in range(even - 1):
        pairs = [(a, b) for a, b in zip(ring[: even // 2], reversed(ring[even // 2 :]), strict=True) if max(a, b) < d]
        yield np.array([min(p) for p in pairs], dtype=int), np.array([max(p) for p in pairs], dtype=int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, of a matrix with few rows."""
    a, v = np.array(r, dtype=float), np.eye(r.shape[1])
    floor = np.finfo(float).tiny
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha * beta)
            cosine = np.where(size > floor, np.abs(gamma) / np.maximum(size, floor), 0)
            turn = cosine > TOLERANCE
            worst = max(worst, cosine.max(initial=0))
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1), 0)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, t), 1)
            s = np.where(turn, c * t, 0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if worst <= a.shape[1] * np.finfo(float).eps:
            break
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order] / np.sqrt((v * v).sum(axis=0))[order]


def identity_error(fit: DataFrame, mean: np.ndarray, scaled: np.ndarray) -> float:
    """The largest absolute entry of the covariance of what the fit list becomes, minus the identity."""
    k = scaled.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = (_matrix(batch.column("x").slice(at, BLOCK)) - mean) @ scaled
                total += np.concatenate([[len(w)], w.sum(axis=0), (w.T @ w).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(partial, "m array<double>").select(F.posexplode("m").alias("k", "m"))
    m = np.array([r.m for r in parts.groupBy("k").agg(F.sum("m").alias("m")).orderBy("k").collect()])
    means = m[1 : k + 1] / m[0]
    return float(np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.outer(means, means) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """A row of df for each component: component, n, deviation, whitened, explained, identity_error."""
    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [x.split(" ")[0] for x in added.split(", ")]
    marked = df.drop(*names).withColumn("_x", whole(F.col(vector), scale)).where("_x is not null")
    lengths = marked.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths.d if lengths else 0
    rows = marked.where(F.size("_x") == d)
    fit = common.stored(rows.select(F.col("_x").alias("x")).distinct(), "fit")
    n, s = sums(fit)
    k = min(components, d)
    kept = [c for c in df.columns if c not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), added])
    if not n:
        return rows.drop("_x").select("*", *(F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in added.split(", ")))
    mean = np.array([v / n for v in s])
    sigma, v = jacobi(triangle(fit, mean))
    sigma = np.concatenate([sigma, np.zeros(max(0, d - len(sigma)))])
    live = sigma[:k] > sigma[0] * d * np.finfo(float).eps
    share = sigma[:k] ** 2 / (sigma**2).sum() if sigma[0] else np.zeros(k)
    # either sign would do: the largest entry is positive
    v = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(axis=0), np.arange(k)])
    scaled = v[:, live] / (sigma[:k][live] / np.sqrt(n))
    error = identity_error(fit, mean, scaled) if live.any() else None
    shared = df.sparkSession.sparkContext.broadcast((mean, scaled, s))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scaled, s = shared.value
        exact = np.array(s, dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("_x"))
                most = max(int(np.abs(x).max()) * n, max(map(abs, s)))
                if 4 * d * most * most < LONG:
                    deviation = pa.array(((x * n - np.array(s, dtype="i8")) ** 2).sum(axis=1))
                else:
                    deviation = pa.array([int(t) if t < LONG else None for t in ((x.astype(object) * n - exact) ** 2).sum(axis=1)], pa.int64())
                w = np.full((len(x), k), np.nan)
                w[:, live] = (x - mean) @ scaled
                nth = pa.array(np.repeat(np.arange(len(x)), k))
                whitened = pa.array(w.ravel(), mask=np.tile(~live, len(x)))
                own = [part.column(c).take(nth) for c in kept]
                more = [pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))), pa.array(np.full(len(nth), n)), deviation.take(nth), whitened, pa.array(np.tile(share, len(x))), pa.array([error] * len(nth), pa.float64())]
                yield pa.RecordBatch.from_arrays([*own, *more], names=[*kept, *names])

    return rows.select(*kept, "_x").mapInArrow(project, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
