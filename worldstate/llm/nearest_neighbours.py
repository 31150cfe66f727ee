"""Nearest neighbours of a query set by a block matrix join with int8 product tiles.

Vectors are dealt into blocks of bounded size; every query block meets every candidate block once, as a tile.
A tile multiplies the vectors' int8 forms (x = s * q + e, |e| <= s / 2 each), which gives the inner product
of x and y up to (s_y / 2) * |s_x q_x|_1 + (s_x / 2) * |y|_1. A candidate whose upper bound is below the k-th
largest lower bound of its query in the tile can't be among its k nearest; the rest are recomputed in double
precision. Heaps merge the tiles of a task by query, a ranked window merges the tasks. So the result is exact.

The stated query set meets all rows in blocks: tiles are (queries / QUERY_BLOCK) * (rows / BLOCK), each in
memory for itself; blocks, not rows, are copied to tiles. Blocks are dealt by row number, so no id is hot.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; a query is
no candidate of its own, other rows with its id or vector are; vectors of another length than a query's are no
candidates of it; ties go to the smaller id; fewer than k candidates give all; further columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK, QUERY_BLOCK, K = 4096, 1024, 20
#: Queries whose heaps a task holds before it passes them on.
HELD = 20_000

PACKED = "dim int, block int, rows binary, ids binary, matrix binary"


def usable(vector: str) -> Column:
    """Finite, not zero, and not empty."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """A row per block: its row numbers, ids and matrix."""
    count = max(1, -(-vectors.count() // rows))

    def pack(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("row")
        matrix = np.stack([np.asarray(x, dtype=np.float64) for x in batch["vector"]])
        return pd.DataFrame([(*key, batch["row"].to_numpy("i8").tobytes(), batch["id"].to_numpy("i8").tobytes(), matrix.tobytes())], columns=["dim", "block", "rows", "ids", "matrix"])

    keyed = vectors.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")})
    return common.stored(keyed.groupBy("dim", "block").applyInPandas(pack, PACKED), "blocks")


def int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, s): int8 forms and scales of the rows."""
    s = np.abs(x).max(axis=1) / 127
    return np.rint(x / s[:, None]).astype(np.int8), s


def tile(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, (places, scores) of its k nearest in the tile. own: the query's place among the candidates, or -1."""
    (qi, qs), (ci, cs) = int8(q), int8(c)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which the int8 products add up exactly
    near = (qi.astype(exact) @ ci.astype(exact).T).astype(np.float64) * qs[:, None] * cs[None, :]
    l1 = np.abs(qi.astype(np.float64)).sum(axis=1) * qs
    error = (l1[:, None] * cs[None, :] + qs[:, None] * np.abs(c).sum(axis=1)[None, :]) / 2 * (1 + 1e-9)
    there = np.flatnonzero(own >= 0)
    low, high = near - error, near + error
    low[there, own[there]] = high[there, own[there]] = -np.inf
    out = []
    for i in range(len(q)):
        bound = np.partition(low[i], -k)[-k] if low.shape[1] > k else -np.inf
        left = np.flatnonzero((high[i] >= bound) & (high[i] > -np.inf))
        score = (c[left] * q[i]).sum(axis=1)
        first = np.lexsort((ids[left], -score))[:k]
        out.append((left[first], score[first]))
    return out


def search(df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: the k nearest rows by inner product for each row of df that `queries` marks."""
    rows = df.where(usable(vector) & F.col(id_col).isNotNull())
    rows = common.stored(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    candidates = _blocks(rows.drop("asks"), block)
    asking = _blocks(rows.where("asks").drop("asks"), query_block)
    # each candidate block's number is one of a query block's list; the blocks meet in a plain equi-join
    others = candidates.groupBy("dim").agg(F.collect_list("block").alias("others"))
    left = asking.join(others, "dim").withColumn("other", F.explode("others")).select("dim", "other", *(F.col(x).alias(f"q_{x}") for x in ("rows", "ids", "matrix")))
    tiles = left.join(candidates.withColumnRenamed("block", "other"), ["dim", "other"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[tuple[int, int], list] = {}

        def flush() -> pd.DataFrame:
            out = [(*key, -other, score, row) for key, heap in heaps.items() for score, other, row in heap]
            heaps.clear()
            return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score", "row"])

        for batch in batches:
            for x in batch.itertuples():
                q, c = (np.frombuffer(m).reshape(-1, x.dim) for m in (x.q_matrix, x.matrix))
                q_rows, q_ids, c_rows, c_ids = (np.frombuffer(v, dtype="i8") for v in (x.q_rows, x.q_ids, x.rows, x.ids))
                at = np.searchsorted(c_rows, q_rows)  # rows of a block are in order
                own = np.where((at < len(c_rows)) & (c_rows[np.minimum(at, len(c_rows) - 1)] == q_rows), at, -1)
                for i, (places, scores) in enumerate(tile(q, c, own, c_ids, k)):
                    heap = heaps.setdefault((int(q_rows[i]), int(q_ids[i])), [])
                    for p, score in zip(places.tolist(), scores.tolist(), strict=True):
                        entry = (score, -int(c_ids[p]), int(c_rows[p]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                if len(heaps) > HELD:
                    yield flush()
        yield flush()

    found = tiles.mapInPandas(near, "query_row long, query_id long, vec_id long, score double, row long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("query_row")
