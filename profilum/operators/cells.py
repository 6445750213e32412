"""Exact top-k search for large query sets: cells with a radius, a floor per query, split pairs.

The documents are written once, each under the nearest of a bounded set of centres. A cell is its centre, the
number of its documents and its radius, the largest angle between the centre and one of them: by the triangle
inequality of angles no document of a cell scores above ``cos(max(0, angle(query, centre) - radius))``.

1. Every query meets the cell with the greatest bound among those that hold more than k documents. The k-th score
   it finds there is its floor.
2. It then goes only to cells whose bound reaches that floor. Pairs of a query and a cell that cannot are never made.

A cell of more than ``PART_DOCUMENTS`` documents is split into parts by a hash of the document, and the queries of
a cell, counted before they move, are split into slices of about ``SLICE_QUERIES``; the documents go to each slice.
So no task holds more than a part of a cell, and none meets all queries of one that many queries ask.

Documents without a direction (zero length, components that are no finite numbers) score zero and have a cell with
the bound zero. Queries without a direction score zero everywhere, so the smallest ids are their result.
While one cell holds all documents, the queries are split and nothing else is done. Centres are a bounded sample: results do not depend on it, only how much is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.functions.topk import hit_frame, query_rows, scan
from profilum.functions.vectors import norm, unit_rows
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

# A part is held by a task as doubles, so it is bounded by bytes too: 160,000 documents at 64 dimensions take 82 MB, 21,845 at 768 take 134 MB.
PART_DOCUMENTS = 160_000
PART_BYTES = 128 * 1024 * 1024
PART_QUERIES = 1024
SLICE_QUERIES = 65_536
# Centres are held by every task: at 768 dimensions 4096 take 25 MB. Cells beyond are split into parts.
MAX_CENTRES = 4096
# How far a bound may be off through rounding.
BOUND_SLACK = 1e-6
NO_DIRECTION = -1


def part_size(dimension: int | None) -> int:
    """How many documents a part holds."""
    return max(1, min(PART_DOCUMENTS, PART_BYTES // (8 * max(1, dimension or 1))))


def slices_of(asking: int, places: int, cores: int) -> int:
    """Into how many slices the queries of a place are split: enough for all cores while a slice is no smaller than a block."""
    return max(1, -(-asking // SLICE_QUERIES), min(-(-cores // max(1, places)), asking // PART_QUERIES))


def meet(together: DataFrame, place: list[str], key: str, k: int, schema: str, scanned=None) -> DataFrame:
    """The best k of each query among the documents of its place. ``together`` holds documents and queries, the
    documents of a place first (see :func:`documents_held` and :func:`queries_sent`); the queries stream past them.
    With ``scanned``, ``scan_scopes`` or ``scan_lists``, a query sees those of its ``_scope`` only."""
    together = together.repartition(*place).sortWithinPartitions(*place, "_asks")

    def run(frames):
        current, waiting, held = None, [], None
        for frame in frames:
            edges = (frame[[*place, "_asks"]] != frame[[*place, "_asks"]].shift()).any(axis=1).cumsum()
            for _, rows_here in frame.groupby(edges, sort=False):
                here = tuple(rows_here[name].iloc[0] for name in place)
                if here != current:
                    current, waiting, held = here, [], None
                if not rows_here["_asks"].iloc[0]:
                    waiting.append((rows_here["_doc"].to_numpy(), rows_here["_scope"].to_numpy(), unit_rows(rows_here["vector"])))
                    continue
                if held is None:
                    if not waiting:
                        continue
                    held, waiting = tuple(np.concatenate(column) for column in zip(*waiting)), []
                ids, scopes, rows = held
                for first in range(0, len(rows_here), PART_QUERIES):
                    part = rows_here.iloc[first : first + PART_QUERIES].rename(columns={"vector": "query_vector"})
                    vectors, excluded = query_rows(part, rows.shape[1])
                    if scanned:
                        best = scanned(part["_scope"].to_numpy(), vectors, excluded, scopes, ids, rows, k)
                    else:
                        best = scan(vectors, excluded, [(ids, rows)], k)
                    if len(best):
                        yield hit_frame(part["query_id"], key, best)

    return together.mapInPandas(run, schema)


def documents_held(docs: DataFrame, place: list[str], key: str, queries: DataFrame) -> DataFrame:
    """Documents ``_scope, key, vector`` as rows of :func:`meet`. Neither side leaves an id empty, so that large
    ids stay whole numbers on their way to Python."""
    no_query, no_doc = F.lit("0").cast(queries.schema["query_id"].dataType), F.lit("0").cast(docs.schema[key].dataType)
    return docs.select(*place, F.lit(False).alias("_asks"), "_scope", F.col(key).alias("_doc"), no_query.alias("query_id"), "vector", no_doc.alias("exclude_id"), F.lit(False).alias("excludes"))


def queries_sent(queries: DataFrame, place: list[str], docs: DataFrame, key: str) -> DataFrame:
    """Prepared queries as rows of :func:`meet`."""
    no_doc = F.lit("0").cast(docs.schema[key].dataType)
    return queries.select(*place, F.lit(True).alias("_asks"), "_scope", no_doc.alias("_doc"), "query_id", F.col("query_vector").alias("vector"), "exclude_id", "excludes")


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def _directed(rows: np.ndarray) -> np.ndarray:
    return np.isfinite(rows).all(axis=1) & rows.any(axis=1)


@dataclass(frozen=True)
class Cells:
    """Documents ``cell, key, vector`` in a written table, and what the driver knows of the cells. A last cell holds
    what has no direction."""

    table: DataFrame
    key: str
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """The best score each cell can hold for each unit row; minus infinity for empty cells."""
        # Without centres nothing is known, and nothing may be skipped.
        found = np.zeros((len(rows), len(self.centres) + 1)) if len(self.centres) else np.ones((len(rows), 1))
        found[:, :-1] = np.cos(np.maximum(0.0, _angles(rows, self.centres) - self.radii[None, :]))
        found[:, self.counts == 0] = -np.inf
        return found


def one_cell(queries: DataFrame, docs: DataFrame, key: str, k: int, documents: int, asking: int, schema: str) -> DataFrame:
    """The search while all documents fit a cell, where no bound can spare a query anything: the documents go to
    slices of the queries, so many that no more documents move than queries, or one for each core."""
    slices = max(asking // max(documents, PART_QUERIES), slices_of(asking, 1, docs.sparkSession.sparkContext.defaultParallelism))
    spread = docs.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("_scope", F.lit(0))
    some = queries.withColumn("_slice", F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(slices)).cast("int")).withColumn("_scope", F.lit(0))
    return meet(documents_held(spread, ["_slice"], key, queries).unionByName(queries_sent(some, ["_slice"], docs, key)), ["_slice"], key, k, schema)


def build_cells(docs: DataFrame, key: str, dimension: int) -> Cells:
    """Write ``key, vector`` under the nearest of up to ``MAX_CENTRES`` sampled documents; equally near: the first.
    A cell is to hold half a part."""
    wanted = min(MAX_CENTRES, max(1, -(-2 * docs.count() // part_size(dimension))))
    length = norm(F.col("vector"))
    sampled = docs.filter((length > 0) & (length < float("inf"))).orderBy(F.xxhash64(key), key).limit(wanted).toPandas()["vector"]
    rows = unit_rows(sampled) if len(sampled) else np.zeros((0, dimension))
    centres = np.unique(rows[_directed(rows)], axis=0)
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def assign(frames):
        for frame in frames:
            if not len(frame):
                continue
            rows, centres = unit_rows(frame["vector"]), shared.value
            cells, angles = np.full(len(rows), NO_DIRECTION), np.zeros(len(rows))
            directed = np.flatnonzero(_directed(rows))
            if len(directed) and len(centres):
                apart = _angles(rows[directed], centres)
                cells[directed] = apart.argmin(axis=1)
                angles[directed] = apart.min(axis=1)
            yield frame.assign(cell=cells.astype("int32"), angle=angles)

    kind = docs.schema[key].dataType.simpleString()
    placed = docs.select(key, "vector").mapInPandas(assign, f"{key} {kind}, vector array<double>, cell int, angle double")
    table = write_version(placed, "cells")
    # One row per cell.
    sizes = table.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    counts, radii = np.zeros(len(centres) + 1, dtype=np.int64), np.zeros(len(centres))
    for row in sizes:
        counts[row.cell] = row.n
        if row.cell >= 0:
            radii[row.cell] = row.radius
    return Cells(table.drop("angle"), key, centres, counts, radii)


@dataclass(frozen=True)
class Found:
    """Hits that contain the best k of each query; how many pairs of a query and a cell were scored, and how many
    there are; the greatest number of slices that the queries of a cell were split into."""

    hits: DataFrame
    pairs: int
    all_pairs: int
    slices: int


def search(queries: DataFrame, docs: DataFrame, key: str, k: int, dimension: int, schema: str) -> Found:
    """``queries`` has ``query_id, query_vector, exclude_id, excludes``, ``docs`` has ``key, vector``, vectors of
    ``dimension`` components."""
    spark, cells = docs.sparkSession, build_cells(docs, key, dimension)
    # Of the smallest k + 1 ids one may be excluded.
    least = [row[0] for row in cells.table.select(key).orderBy(key).limit(k + 1).collect()]
    ids = F.array(*map(F.lit, least)).cast(docs.select(F.array(key)).schema[0].dataType)
    shared = spark.sparkContext.broadcast((cells.centres, cells.counts, cells.radii))
    filled = int((cells.counts > 0).sum())

    def opened() -> Cells:
        return Cells(None, key, *shared.value)

    def own(frames):
        """The cell each query meets first: the greatest bound among cells with enough documents; -1 if the query has
        no direction, the number of cells if none is large enough."""
        known = opened()
        for frame in frames:
            if not len(frame):
                continue
            rows, _ = query_rows(frame, dimension)
            bounds = known.bounds(rows)
            bounds[:, known.counts <= k] = -np.inf
            first = np.where(np.isfinite(bounds).any(axis=1), bounds.argmax(axis=1), len(known.counts))
            yield frame.assign(own=np.where(_directed(rows), first, -1).astype("int32"))

    names = "query_id", "query_vector", "exclude_id", "excludes"
    fields = [f"{name} {queries.schema[name].dataType.simpleString()}" for name in names]
    asked = write_version(queries.select(*names).mapInPandas(own, ", ".join([*fields, "own int"])), "asked")

    def visit(sent: DataFrame, visits: np.ndarray) -> DataFrame:
        """Send queries with a ``cell`` to it, ``visits`` of them to each cell."""
        met = np.flatnonzero((visits > 0) & (cells.counts > 0))
        size, cores = part_size(dimension), spark.sparkContext.defaultParallelism
        rows = [(int(cell) if cell < len(cells.centres) else NO_DIRECTION, int(cell), int(-(-cells.counts[cell] // size)), slices_of(int(visits[cell]), len(met), cores)) for cell in met]
        # One row per cell.
        split = F.broadcast(spark.createDataFrame(rows, "cell int, place int, parts int, slices int"))
        place = ["place", "_part", "_slice"]
        spread = cells.table.join(split, "cell").withColumn("_part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
        spread = spread.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("_scope", F.lit(0))
        some = sent.withColumnRenamed("cell", "place").join(split.drop("cell"), "place")
        some = some.withColumn("_slice", F.pmod(F.xxhash64("query_id", "query_vector"), F.col("slices")).cast("int"))
        some = some.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("_scope", F.lit(0))
        return meet(documents_held(spread, place, key, queries).unionByName(queries_sent(some, place, docs, key)), place, key, k, schema)

    def counted(rows: DataFrame) -> np.ndarray:
        """Queries per cell: one row per cell comes to the driver."""
        visits = np.zeros(len(cells.counts) + 1, dtype=np.int64)
        for row in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            visits[row.cell] = row.n
        return visits[:-1]

    order = [F.col("similarity_score").desc(), F.col(key)]
    starting = asked.filter(F.col("own") >= 0).withColumnRenamed("own", "cell")
    first_visits = counted(starting.groupBy("cell").agg(F.count("*").alias("n")))
    first = write_version(top_per_group(visit(starting, first_visits), ["query_id"], order, k), "first-hits")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity_score").alias("floor")).filter(F.col("n") >= k).drop("n")
    floored = write_version(asked.filter(F.col("own") >= 0).join(floors, "query_id", "left"), "floored")

    def chosen(known: Cells, frame: pd.DataFrame) -> np.ndarray:
        """Which further cells each query goes to."""
        rows, _ = query_rows(frame, dimension)
        floor = frame["floor"].astype(float).fillna(-np.inf).to_numpy()
        reached = (known.bounds(rows) >= floor[:, None] - BOUND_SLACK) & (known.counts > 0)[None, :]
        before = frame["own"].to_numpy(dtype=int)
        met = before < reached.shape[1]
        reached[np.flatnonzero(met), before[met]] = False
        return reached

    def count_chosen(frames):
        known = opened()
        for frame in frames:
            if len(frame):
                totals = chosen(known, frame).sum(axis=0)
                yield pd.DataFrame({"cell": np.flatnonzero(totals).astype("int32"), "n": totals[totals > 0].astype("int64")})

    def send(frames):
        known = opened()
        for frame in frames:
            for low in range(0, len(frame), PART_QUERIES):
                part = frame.iloc[low : low + PART_QUERIES]
                reached = chosen(known, part)
                at_query, at_cell = np.nonzero(reached)
                for first in range(0, len(at_query), PART_QUERIES):
                    some = slice(first, first + PART_QUERIES)
                    yield part.iloc[at_query[some]][list(names)].assign(cell=at_cell[some].astype("int32"))

    visits = counted(floored.mapInPandas(count_chosen, "cell int, n bigint"))
    second = visit(floored.mapInPandas(send, ", ".join([*fields, "cell int"])), visits)
    still = asked.filter(F.col("own") < 0).withColumn(key, F.explode(ids)).filter(~F.col("excludes") | (F.col(key) != F.col("exclude_id")))
    still = still.select("query_id", key, F.lit(0.0).alias("similarity_score"))
    hits = first.drop("rank").unionByName(second).unionByName(still)
    pairs = int(first_visits.sum() + visits.sum())
    slices = int(-(-np.maximum(first_visits, visits).max(initial=0) // SLICE_QUERIES))
    return Found(hits, pairs, asked.filter(F.col("own") >= 0).count() * filled, slices)
