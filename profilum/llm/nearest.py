"""Approximate nearest neighbours by cosine with adaptive dimension scans.

Vectors are scaled to length one before centres are found and lists are filled, so lengths decide nothing. They
are turned by one random rotation and held in blocks of columns per list. A query
probes the ``PROBES`` share of the lists with the nearest centres. In each it compares all rows on the
first block of columns, then only those that a hypothesis test leaves: a row is abandoned after d of
D columns if its partial squared distance, scaled by D/d, exceeds the squared distance of the k-th
best so far by the factor ``(1 + CONFIDENCE / sqrt(d))^2``. Those that are left after all columns are
scored on the original vectors in double precision.

Zero vectors take no part; for other rows that do not see ``vectors``. Equal scores go to the smaller
id. Fewer candidates than k are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm.vectors import Layout, Pool, build, search, usable

PROBES = 0.7
ROWS_PER_LIST = 128
COLUMNS = 16
CONFIDENCE = 2.1
_PAIRS = 1 << 22


def rotation(size: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    turned, triangle = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return turned * np.sign(np.diag(triangle))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither vanish nor overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, with the same operations for equal rows."""
    scale = [np.abs(side).max(axis=1, keepdims=True) for side in (left, right)]
    left, right = left / scale[0], right / scale[1]
    return (left * right).sum(axis=1) / (np.sqrt((left**2).sum(axis=1)) * np.sqrt((right**2).sum(axis=1)))


def probed(layout: Layout, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """The lists to probe: the share of all with rows whose centres are nearest."""
    far = (layout.centres**2).sum(axis=1) - 2 * unit(queries) @ layout.centres.T
    far[:, layout.radius < 0] = np.inf
    count = max(1, int(np.ceil(PROBES * (layout.radius >= 0).sum())))
    result = np.zeros(far.shape, dtype=bool)
    np.put_along_axis(result, np.argsort(far, axis=1, kind="stable")[:, :count], True, axis=1)
    return result


class Scan:
    def __init__(self, layout: Layout, lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, lists))
        self.layout, self.vectors, self.ids = layout, vectors[order], ids[order]
        self.present, self.starts = np.unique(lists[order], return_index=True)
        self.size = vectors.shape[1]
        self.turn = rotation(self.size)
        turned = unit(self.vectors) @ self.turn
        self.blocks = [np.ascontiguousarray(turned[:, low : low + COLUMNS]) for low in range(0, self.size, COLUMNS)]

    def __call__(self, queries: np.ndarray, lists: np.ndarray, floors: np.ndarray, k: int) -> Pool:
        pool = Pool(floors, k)
        turned = unit(queries) @ self.turn
        going = probed(self.layout, queries, floors)
        step = max(1, _PAIRS // max(1, int(np.diff(self.starts, append=len(self.ids)).max())))
        for place, low, high in zip(self.present, self.starts, [*self.starts[1:], len(self.ids)]):
            asking = np.flatnonzero(going[:, place])
            for start in range(0, len(asking), step):
                self._scan(queries, turned, asking[start : start + step], low, high, pool)
        return pool

    def _scan(self, queries: np.ndarray, turned: np.ndarray, asking: np.ndarray, low: int, high: int, pool: Pool) -> None:
        limit = 2 - 2 * pool.floor + 1e-9
        left, right = turned[asking, :COLUMNS], self.blocks[0][low:high]
        partial = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1) - 2 * left @ right.T
        who, what = np.nonzero(partial <= self._most(limit[asking], COLUMNS)[:, None])
        partial = partial[who, what]
        who = asking[who]
        for number, block in enumerate(self.blocks[1:], 1):
            done = min(self.size, COLUMNS * (number + 1))
            partial = partial + ((turned[who, COLUMNS * number : done] - block[low + what]) ** 2).sum(axis=1)
            stays = partial <= self._most(limit[who], done)
            who, what, partial = who[stays], what[stays], partial[stays]
        for start in range(0, len(who), 1 << 16):
            one, other = who[start : start + (1 << 16)], low + what[start : start + (1 << 16)]
            pool.offer(one, cosine(queries[one], self.vectors[other]), self.ids[other])

    def _most(self, limit: np.ndarray, done: int) -> np.ndarray:
        """The largest partial squared distance that the test lets pass after ``done`` columns."""
        done = min(done, self.size)
        slack = 1.0 if done == self.size else (1 + CONFIDENCE / np.sqrt(done)) ** 2
        return limit * slack * done / self.size


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, id, score`` over ``id, vector`` for queries that are some of those rows."""
    index = build(rows, k + 1, ROWS_PER_LIST, unit)
    if index is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
    layout = index.layout
    return search(index, queries, lambda lists, vectors, ids: Scan(layout, lists, vectors, ids), probed, k)


def of_table(rows: DataFrame, every: int, k: int, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Queries are all rows whose id is divisible by ``every``."""
    whole = usable(rows, row_id, vector).where(F.exists("vector", lambda x: x != 0))
    return neighbours(whole, whole.where(F.col("id") % every == 0), k)
