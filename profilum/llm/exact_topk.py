"""Exact top-k by integer inner product with block-at-a-time pruning.

The rows of a cell, in the order of their lists, are cut into ranges of ``BLOCK`` rows. A block keeps
the largest and the smallest value of every component, which for a query are the maxima of its
positive and of its negative terms; their weighted sum bounds every score in the block. Each query
visits blocks from the highest bound down, scores them through their rows and stops at the first
bound below its k-th score. Cells are skipped if no list in them can reach the floor: a score is at
most the centre's plus the query's length times the list's radius.

Equal scores go to the smaller id. Scores are exact below 2^53. For rows that take no part see
``vectors``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm.vectors import Layout, Pool, build, search, usable

BLOCK = 64
ROWS_PER_LIST = 128


class Blocks:
    def __init__(self, lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, lists))
        self.vectors, self.ids = vectors[order], ids[order]
        self.size = max(BLOCK, len(ids) // 256)
        self.starts = np.arange(0, len(ids), self.size)
        self.largest = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.smallest = np.minimum.reduceat(self.vectors, self.starts, axis=0)

    def __call__(self, queries: np.ndarray, lists: np.ndarray, floors: np.ndarray, k: int) -> Pool:
        pool = Pool(floors, k)
        bounds = np.maximum(queries, 0) @ self.largest.T + np.minimum(queries, 0) @ self.smallest.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        going = np.arange(len(queries))
        for turn in range(len(self.starts)):
            going = going[bounds[going, order[going, turn]] >= pool.floor[going]]
            if not len(going):
                break
            block = order[going, turn]
            together = np.argsort(block, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(block[together])) + 1).tolist(), len(going)]
            found = []
            for low, high in zip(cuts, cuts[1:]):
                asking = going[together[low:high]]
                start = self.starts[block[together[low]]]
                scores = queries[asking] @ self.vectors[start : start + self.size].T
                who, what = np.nonzero(scores >= pool.floor[asking][:, None])
                found.append((asking[who], scores[who, what], self.ids[start + what]))
            pool.offer(*[np.concatenate(columns) for columns in zip(*found)])
        return pool


def reachable(layout: Layout, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Lists that may hold a score at or above the floor; the margin covers rounding."""
    length = np.sqrt((queries**2).sum(axis=1))[:, None]
    bound = queries @ layout.centres.T + length * layout.radius
    return (layout.radius >= 0) & (bound * (1 + 1e-9) + 1e-6 * (1 + length) >= floors[:, None])


def scaled(rows: DataFrame, factor: int = 64) -> DataFrame:
    """The components as ``floor(factor * x)``."""
    return rows.select("id", F.transform("vector", lambda x: F.floor(x * factor).cast("double")).alias("vector"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, id, score`` over ``id, vector`` for queries that are some of those rows."""
    index = build(rows, k + 1, ROWS_PER_LIST)
    if index is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return search(index, queries, Blocks, reachable, k).withColumn("score", F.col("score").cast("long"))


def of_table(rows: DataFrame, every: int, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Queries are all rows whose id is divisible by ``every``."""
    whole = scaled(usable(rows, row_id, vector))
    return top_k(whole, whole.where(F.col("id") % every == 0), k)
