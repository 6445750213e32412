"""What both vector searches share: usable rows, lists around centres, and queries meeting cells of rows.

Rows of equal vectors need only their ``k + 1`` smallest ids as candidates, and equal query vectors are
searched once; both are cut by rank before the shuffle. Rows belong to the list of the centre nearest
to their form, which is the vector itself or what a search makes of it (of length one, for cosine); the centres (``LISTS`` at most) come from a bounded sample. Whole lists, or parts of a large
one, make cells of a bounded number of rows. A task holds one cell at a time while the queries sent
to it stream past.

A search has two passes. Each query first meets the cell of its own vector, which gives a floor under
its k-th score; then it goes, with that floor, to the other cells that a rule of the search allows.

Rows with a null id, a null or empty vector, or a null or non-finite component take no part, nor do
those whose dimension is not the most common one (the smaller of equally common ones). Of rows
sharing an id the least vector counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

LISTS = 1024
SAMPLE = 8192
ROUNDS = 8
CELL_ROWS = 1 << 16
KEY = ["key", "key2"]


def usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``id, vector`` with one vector of doubles per id and one dimension throughout."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    single = named.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite).groupBy("id").agg(F.min("vector").alias("vector"))
    stored = write_version(single, "vectors")
    common = stored.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return stored.where(F.size("vector") == (common["size"] if common else 0))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.xxhash64(F.lit(seed), "vector").alias(name) for seed, name in enumerate(KEY)])


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre and the distance from it."""
    lists, squares = np.empty(len(vectors), dtype=np.int32), np.empty(len(vectors))
    for start in range(0, len(vectors), 4096):
        part = vectors[start : start + 4096]
        far = (centres**2).sum(axis=1) - 2 * part @ centres.T
        lists[start : start + 4096] = far.argmin(axis=1)
        squares[start : start + 4096] = ((part - centres[lists[start : start + 4096]]) ** 2).sum(axis=1)
    return lists, np.sqrt(squares)


def _centres(rows: DataFrame, lists: int, form: Callable) -> np.ndarray:
    """Centres of a sample of ``SAMPLE`` rows, chosen by a hash of the id."""
    sample = form(np.array([row.vector for row in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]))
    centres = sample[:lists].copy()
    for _ in range(ROUNDS):
        near, _ = _nearest(sample, centres)
        for place in np.unique(near):
            centres[place] = sample[near == place].mean(axis=0)
    return centres


@dataclass
class Layout:
    """Where lists lie: centres, the largest distance from each, its first cell and over how many it is spread."""

    centres: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray


@dataclass
class Index:
    """All candidates with their ``cell`` and ``list``, as written, and how they are laid out."""

    rows: DataFrame
    layout: Layout


def build(rows: DataFrame, keep: int, rows_per_list: int, form: Callable[[np.ndarray], np.ndarray] = np.asarray) -> Index | None:
    """Index ``id, vector``; of equal vectors the ``keep`` smallest ids. None without rows. Centres, lists and radii are
    those of ``form(vectors)``; the cells hold the vectors themselves."""
    distinct = write_version(top_per_group(keyed(rows), KEY, [F.col("id")], keep, "_rank").drop("_rank"), "distinct-vectors")
    size = distinct.count()
    if not size:
        return None
    centres = _centres(distinct, min(LISTS, max(16, size // rows_per_list), size), form)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, distance = _nearest(form(matrix(batch.column("vector"))), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(distance)], names=[*batch.schema.names, "list", "distance"])

    kind = distinct.schema["id"].dataType.simpleString()
    assigned = write_version(distinct.select("id", "vector", *KEY).mapInArrow(assign, f"id {kind}, vector array<double>, key long, key2 long, list int, distance double"), "assigned")
    # At most one row per list.
    known = {row["list"]: row for row in assigned.groupBy("list").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).collect()}
    cell_rows = min(CELL_ROWS, max(2048, size // LISTS))
    first, parts, cell, filled = [], [], 0, 0
    for place in range(len(centres)):
        count = known[place]["rows"] if place in known else 0
        if filled and filled + count > cell_rows:
            cell, filled = cell + 1, 0
        first.append(cell)
        parts.append(max(1, math.ceil(count / cell_rows)))
        filled += count
        if parts[-1] > 1:
            cell, filled = cell + parts[-1], 0
    radius = np.array([known[place]["radius"] if place in known else -1.0 for place in range(len(centres))])
    layout = Layout(centres, radius, np.array(first), np.array(parts))
    spread = F.broadcast(rows.sparkSession.createDataFrame([(place, first[place], parts[place]) for place in range(len(centres))], "list int, first int, parts int"))
    placed = assigned.join(spread, "list").withColumn("cell", F.col("first") + F.pmod("key", F.col("parts")).cast("int")).drop("first", "parts", "distance")
    return Index(write_version(placed, "cells"), layout)


def best(query: np.ndarray, score: np.ndarray, row_id: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((row_id, -score, query))
    ranked = query[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    return order[np.arange(len(ranked)) - begin < k]


class Pool:
    """The best candidates so far of a batch of queries, and the score that a new one must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k = floor.copy(), k
        self.query, self.score, self.id = np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64)

    def offer(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        good = score >= self.floor[query]
        if not good.any():
            return
        query, score, row_id = np.append(self.query, query[good]), np.append(self.score, score[good]), np.append(self.id, row_id[good])
        kept = best(query, score, row_id, self.k)
        self.query, self.score, self.id = query[kept], score[kept], row_id[kept]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.floor)) == self.k)
        lowest = np.full(len(self.floor), np.inf)
        np.minimum.at(lowest, self.query, self.score)
        self.floor[full] = np.maximum(self.floor[full], lowest[full])


def _meet(index: Index, asked: DataFrame, make: Callable, k: int) -> DataFrame:
    """``key, key2, id, score`` of the best rows of each cell for the queries ``cell, key, key2, vector, list, floor``
    sent there. ``make(lists, vectors, ids)`` gives what a task holds of a cell; it is called with
    ``(vectors, lists, floors, k)`` of a batch of queries and returns a pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, held = None, [], None
        for batch in batches:
            cells, asking = batch.column("cell").to_numpy(), batch.column("asking").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (asking[1:] != asking[:-1])) + 1
            for low, high in zip([0, *change.tolist()], [*change.tolist(), len(cells)]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                vectors, lists = matrix(part.column("vector")), part.column("list").to_numpy()
                if cells[low] != current:
                    current, waiting, held = cells[low], [], None
                if not asking[low]:
                    waiting.append((lists, vectors, part.column("id").to_numpy()))
                    continue
                if held is None and waiting:
                    held, waiting = make(*[np.concatenate(columns) for columns in zip(*waiting)]), []
                if held is not None:
                    pool = held(vectors, lists, part.column("floor").to_numpy(), k)
                    keys = [part.column(name).take(pa.array(pool.query)) for name in KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(pool.id), pa.array(pool.score)], names=[*KEY, "id", "score"])

    own = index.rows.select("cell", F.lit(False).alias("asking"), *KEY, F.col("id").cast("long").alias("id"), "vector", "list", F.lit(0.0).alias("floor"))
    sent = asked.select("cell", F.lit(True).alias("asking"), *KEY, F.lit(0).cast("long").alias("id"), "vector", "list", "floor")
    together = own.unionByName(sent).repartition("cell").sortWithinPartitions("cell", "asking")
    return together.mapInArrow(run, "key long, key2 long, id long, score double")


def search(index: Index, queries: DataFrame, make: Callable, allowed: Callable, k: int) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best rows, other than its own, for each of ``id, vector``.

    ``allowed(layout, vectors, floors)`` tells, per query and list, where the second pass goes.
    """
    layout, few = index.layout, k + 1
    asked = keyed(queries)
    single = top_per_group(asked, KEY, [F.col("id")], 1, "_rank").select("id", *KEY)
    members = index.rows.select(*KEY, "vector", "list", "cell").withColumn("_one", F.lit(1))
    distinct = write_version(single.join(top_per_group(members, KEY, [F.col("_one")], 1, "_rank"), KEY).select("cell", *KEY, "vector", "list"), "queries")
    near = write_version(_meet(index, distinct.withColumn("floor", F.lit(float("-inf"))), make, few), "own-cell")
    floors = near.groupBy(*KEY).agg(F.when(F.count("*") >= few, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                own, floors_of = part.column("cell").to_numpy(), part.column("floor").to_numpy()
                going = allowed(layout, matrix(part.column("vector")), floors_of)
                query, place = np.nonzero(going)
                times = layout.parts[place]
                ends = np.cumsum(times)
                query = np.repeat(query, times)
                cells = np.repeat(layout.first[place], times) + np.arange(len(query)) - np.repeat(ends - times, times)
                pairs = np.unique(np.stack([query, cells], axis=1)[cells != own[query]], axis=0)
                chosen = part.take(pa.array(pairs[:, 0]))
                yield chosen.set_column(0, "cell", pa.array(pairs[:, 1].astype(np.int32)))

    routed = distinct.join(floors, KEY, "left").select("cell", *KEY, "vector", "list", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    elsewhere = routed.mapInArrow(route, "cell int, key long, key2 long, vector array<double>, list int, floor double")
    found = top_per_group(near.unionByName(_meet(index, elsewhere, make, few)), KEY, [F.desc("score"), F.col("id")], few, "_rank").drop("_rank")
    answers = asked.select(F.col("id").alias("query_id"), *KEY).join(found, KEY).where("id <> query_id")
    return top_per_group(answers, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "rank", "id", "score")
