"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length 1 and projected on ``PROJECTIONS`` fixed random directions. The table
is dealt into blocks by a hash of ``vec_id``; a block keeps one sorted array a direction. A query
opens a window around its own projection in every array, and virtual rehashing widens all windows
by the factor ``GROWTH`` round by round, counting only what a round adds. A vector whose count
reaches ``SHARE`` of the directions is verified by its exact cosine. A query is done in a block when
the windows are too narrow to hold back a vector nearer than its k-th best (their half width, less a
slack for the directions a near vector may miss, passes that distance), or when they span the block.
Every block answers every query, and the best answers of all blocks are merged.

Cases: vectors that are null, empty or zero, or hold a null or a number that is not finite, take no
part; vectors are compared with those of equal length only; ties go to the smaller ``vec_id``;
repeated rows are candidates of their own, but a query is asked once for each ``vec_id`` and vector;
rows of a null ``vec_id`` take no part; with fewer than k candidates all are returned; an empty table gives an
empty result; columns other than ``vec_id`` and ``embedding`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceloom.llm.common import stored

PROJECTIONS = 16
SEED = 11
START = 0.4
GROWTH = 1.35
#: Share of the directions in whose windows a vector must be to be verified.
SHARE = 0.6875
#: A vector at distance d is within d * REACH of the query in SHARE of the directions, all but rarely.
REACH = 1.45
BLOCK_ROWS = 8_192
QUERY_ROWS = 512
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it takes no part."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite & F.exists(numbers, lambda x: x != 0), numbers)


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS)) / np.sqrt(dim)


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal vectors get equal values."""
    return (rows * query).sum(1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(1)))


def _scaled(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest found in a block for each query."""
    n, dim = rows.shape
    unit, asked = _scaled(rows), _scaled(queries)
    own, places = unit @ _directions(dim), asked @ _directions(dim)
    order = [np.argsort(own[:, j], kind="stable") for j in range(PROJECTIONS)]
    arrays = [own[o, j] for j, o in enumerate(order)]
    least = int(np.ceil(SHARE * PROJECTIONS))
    counts, verified = np.zeros((len(queries), n), np.uint8), np.zeros((len(queries), n), bool)
    lo = np.stack([np.searchsorted(a, places[:, j]) for j, a in enumerate(arrays)], 1)
    hi = lo.copy()
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    waiting, half = np.arange(len(queries)), START / np.sqrt(dim)
    while len(waiting):
        low = np.stack([np.searchsorted(a, places[waiting, j] - half, "left") for j, a in enumerate(arrays)], 1)
        high = np.stack([np.searchsorted(a, places[waiting, j] + half, "right") for j, a in enumerate(arrays)], 1)
        low, high = np.minimum(low, lo[waiting]), np.maximum(high, hi[waiting])
        left = []
        for i, q in enumerate(waiting.tolist()):
            own_counts = counts[q]
            for j, o in enumerate(order):
                own_counts[o[low[i, j] : lo[q, j]]] += 1
                own_counts[o[hi[q, j] : high[i, j]]] += 1
            new = np.flatnonzero((own_counts >= least) & ~verified[q])
            verified[q, new] = True
            new = new[ids[new] != query_ids[q]]
            if len(new):
                near = unit[new] @ asked[q]
                if len(new) > k:
                    near_enough = near >= np.partition(near, -k)[-k] - 1e-9
                    new = new[near_enough]
                pairs = best[q] + list(zip((-_cosines(queries[q], rows[new])).tolist(), ids[new].tolist(), strict=True))
                best[q] = sorted(pairs)[:k]
            far = np.sqrt(max(0.0, 2 + 2 * best[q][-1][0])) if len(best[q]) == k else np.inf
            whole = ((high[i] - low[i]) == n).all()
            if not whole and half * np.sqrt(dim) < far * REACH:
                left.append(q)
        lo[waiting], hi[waiting] = low, high
        waiting, half = np.array(left, int), half * GROWTH
    return [(int(query_ids[q]), i, -s) for q, found in enumerate(best) for s, i in found]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows for each row that ``is_query`` marks."""
    good = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL"), "vectors")
    rows = good.count()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    spread = F.xxhash64("vec_id", "vector")
    data = good.select(F.pmod(spread, F.lit(blocks)).alias("block"), F.size("vector").alias("dim"), "vec_id", "vector")
    asked = good.where(is_query).dropDuplicates(["vec_id", "vector"])
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.size("vector").alias("dim"), F.pmod(spread, F.lit(groups)).alias("part"), "vec_id", "vector"
    )

    def search(own: Iterator[pd.DataFrame], other: Iterator[pd.DataFrame]) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, matrix = own["vec_id"].to_numpy(), np.array(own["vector"].tolist(), float)
        found = []
        for _, part in other.groupby("part"):
            found += search_block(ids, matrix, part["vec_id"].to_numpy(), np.array(part["vector"].tolist(), float), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = data.groupBy("block", "dim").cogroup(asked.groupBy("block", "dim")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
