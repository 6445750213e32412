"""Vector codes by clustering every part of the vectors, with Drake-Hamerly bounds kept between the rounds.

Components become integers (``floor(SCALE * x)``), vectors are cut into ``PARTS`` consecutive parts, and each
part position has a codebook of ``ENTRIES`` entries, seeded by the rows of the smallest ids. Every round assigns
parts to their nearest entries and replaces the entries by floored means.

Kept with each part from round to round: its entry, an upper bound of the distance from it, its ``b`` next
closest entries with lower bounds in ascending order, and one outer lower bound for all other entries. A round
moves the bounds by how far the entries have moved. A part whose upper bound stays below all lower bounds is
settled without a distance. Otherwise its upper bound is made exact; then only entries whose lower bound is
not above it are measured, and all of them only if the outer bound is not above it either. ``b`` shrinks to the
depth that parts needed in the round before. Bounds are whole numbers (rounded outwards) and distances that
decide are whole numbers too, so that results are those of measuring everything, ties to the lower index.

A round is one pass over the table without a shuffle: rows with their bounds are written for the next round, and
each task adds one row with the changes of sums and counts of entries that parts moved between. The driver gets
the sums of these changes, whose number depends on the codebooks alone. Rounds end early when nothing moves.

Rows with a null vector, or null or non-finite components, take no part, nor do rows whose dimension is not the
most common one (the smaller of equally common ones), empty vectors, and vectors with a component so large that
squared distances would not fit into 64 bits (from 32,768 on in vectors of 64 components). Repeated rows each count and get a code each; equal ids seed once, by their least
vector; null ids come last as seeds and keep their row. With fewer ids than entries the codebooks are smaller.
A dimension that is no multiple of the parts gives parts that differ by one component. No rows: no result.
Null labels belong together. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm.vectors import matrix
from profilum.sources.store import write_version

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST_NEAR, FEWEST_NEAR = 8, 2
# The share of measured parts whose depth the next round's lists are to hold.
HELD = 0.95
BROADCAST_LABELS = 1 << 16
_FAR = np.iinfo(np.int64).max // 4
_SQUARED = 1 << 59
_KEPT = {"entry": pa.binary(), "upper": pa.list_(pa.int64()), "near": pa.binary(), "lower": pa.list_(pa.int64()), "outer": pa.list_(pa.int64()), "changes": pa.list_(pa.int64())}


def root_floor(squares: np.ndarray) -> np.ndarray:
    """The whole part of square roots, exactly."""
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) * (roots + 1) <= squares)


def root_ceiling(squares: np.ndarray) -> np.ndarray:
    roots = root_floor(squares)
    return roots + (roots * roots < squares)


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    apart = rows - entries
    return (apart * apart).sum(axis=-1)


def bounds_of(dimension: int, parts: int) -> list[tuple[int, int]]:
    return [(place * dimension // parts, (place + 1) * dimension // parts) for place in range(parts)]


@dataclass
class Held:
    """What is kept of the parts at one position: ``entry, upper, outer`` per part, ``near, lower`` per part and place."""

    entry: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray


def measured(rows: np.ndarray, codebook: np.ndarray, width: int) -> Held:
    """Everything measured: the nearest entry and the next ``width``."""
    squares = np.stack([squared(rows, entry) for entry in codebook], axis=1)
    order = np.argsort(squares, axis=1, kind="stable")
    ranked = np.take_along_axis(squares, order, axis=1)
    width = min(width, len(codebook) - 1)
    outer = root_floor(ranked[:, width + 1]) if width + 1 < len(codebook) else np.full(len(rows), _FAR)
    return Held(order[:, 0], root_ceiling(ranked[:, 0]), order[:, 1 : width + 1], root_floor(ranked[:, 1 : width + 1]), outer)


def narrowed(held: Held, width: int) -> Held:
    """Shorter lists; what leaves them is under the outer bound."""
    if width >= held.near.shape[1]:
        return held
    outer = np.minimum(held.outer, held.lower[:, width:].min(axis=1))
    return Held(held.entry, held.upper, held.near[:, :width], held.lower[:, :width], outer)


def moved(held: Held, moves: np.ndarray) -> Held:
    """The bounds after entries have moved by ``moves``, lower ones kept in order."""
    outer = np.maximum(held.outer - moves.max(), 0)
    lower = np.maximum(np.minimum(held.lower - moves[held.near], outer[:, None]), 0)
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    return Held(held.entry, held.upper + moves[held.entry], held.near, lower, outer)


def settled(rows: np.ndarray, codebook: np.ndarray, held: Held) -> tuple[Held, np.ndarray]:
    """The parts at their nearest entries, and how deep the lists of measured parts were needed (their width and
    one more where everything was measured)."""
    width = held.near.shape[1]
    first = held.lower[:, 0] if width else held.outer
    open_ = np.flatnonzero(held.upper >= first)
    own = squared(rows[open_], codebook[held.entry[open_]])
    held.upper[open_] = root_ceiling(own)
    left = held.upper[open_] >= first[open_]
    open_, own = open_[left], own[left]
    everything = held.upper[open_] >= held.outer[open_]
    depths = np.full(len(open_), width + 1)
    whole = open_[everything]
    if len(whole):
        found = measured(rows[whole], codebook, width)
        held.entry[whole], held.upper[whole], held.outer[whole] = found.entry, found.upper, found.outer
        held.near[whole], held.lower[whole] = found.near, found.lower
    some, own = open_[~everything], own[~everything]
    if len(some):
        # Places of the list whose lower bound is not above the upper bound, with exact distances; the part's own entry in front.
        needed = held.lower[some] <= held.upper[some][:, None]
        depths[~everything] = needed.sum(axis=1)
        squares = np.full((len(some), width + 1), np.iinfo(np.int64).max)
        squares[:, 0] = own
        lower = np.concatenate([root_floor(own)[:, None], held.lower[some]], axis=1)
        entries = np.concatenate([held.entry[some][:, None], held.near[some]], axis=1)
        for place in range(width):
            asked = np.flatnonzero(needed[:, place])
            if not len(asked):
                break
            squares[asked, place + 1] = squared(rows[some[asked]], codebook[held.near[some[asked], place]])
            lower[asked, place + 1] = root_floor(squares[asked, place + 1])
        best = np.lexsort((entries, squares), axis=1)[:, 0]
        at = np.arange(len(some))
        held.entry[some], held.upper[some] = entries[at, best], root_ceiling(squares[at, best])
        lower[at, best] = -1
        order = np.argsort(lower, axis=1, kind="stable")[:, 1:]
        held.near[some] = np.take_along_axis(entries, order, axis=1)
        held.lower[some] = np.take_along_axis(lower, order, axis=1)
    return held, depths


class Changes:
    """Sums, counts and depths of a task, also as one flat array: per part and entry the components and the count, then
    how many parts needed which depth."""

    def __init__(self, bounds: list[tuple[int, int]], entries: int) -> None:
        self.sums = [np.zeros((entries, high - low + 1), dtype=np.int64) for low, high in bounds]
        self.depths = np.zeros(ENTRIES + 1, dtype=np.int64)

    def add(self, part: int, entry: np.ndarray, rows: np.ndarray, sign: int) -> None:
        order = np.argsort(entry, kind="stable")
        present, starts = np.unique(entry[order], return_index=True)
        if len(present):
            if rows.shape[1]:
                self.sums[part][present, :-1] += sign * np.add.reduceat(rows[order], starts, axis=0)
            self.sums[part][present, -1] += sign * np.diff(np.append(starts, len(order)))

    def flat(self) -> np.ndarray:
        return np.concatenate([*[part.ravel() for part in self.sums], self.depths])

    def load(self, flat: np.ndarray) -> None:
        place = 0
        for part in self.sums:
            part += flat[place : place + part.size].reshape(part.shape)
            place += part.size
        self.depths = flat[place:]

    def means(self, codebooks: list[np.ndarray]) -> list[np.ndarray]:
        """The next codebooks; entries without parts stay."""
        return [np.where(part[:, -1:] > 0, part[:, :-1] // np.maximum(part[:, -1:], 1), codebook) for part, codebook in zip(self.sums, codebooks)]


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values.reshape(len(values), -1).astype(np.uint8)], type=pa.binary())


def _longs(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel().astype(np.int64)))


def _held(batch: pa.RecordBatch, parts: int) -> list[Held]:
    """What a written batch holds, by part."""
    entry, near = (np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.uint8).astype(np.int64) for name in ("entry", "near"))
    width = len(near) // (batch.num_rows * parts)
    upper, lower, outer = (batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("upper", "lower", "outer"))
    by_part = [column.reshape(batch.num_rows, parts, *more) for column, more in ((entry, ()), (upper, ()), (near, (width,)), (lower, (width,)), (outer, ()))]
    return [Held(*[column[:, part].copy() for column in by_part]) for part in range(parts)]


@dataclass
class Step:
    """One assignment: the codebooks, how far their entries have moved since the last one (None: no last one), and the
    width of the lists."""

    codebooks: list[np.ndarray]
    moves: list[np.ndarray] | None
    bounds: list[tuple[int, int]]
    width: int

    def assign(self, batch: pa.RecordBatch, changes: Changes) -> tuple[np.ndarray, list[Held]]:
        vectors = matrix(batch.column("vector")).astype(np.int64)
        before = _held(batch, len(self.bounds)) if self.moves is not None else [None] * len(self.bounds)
        results = []
        for part, (low, high) in enumerate(self.bounds):
            rows, codebook, held = vectors[:, low:high], self.codebooks[part], before[part]
            if held is None:
                held = measured(rows, codebook, self.width)
                changes.add(part, held.entry, rows, 1)
            else:
                old = held.entry.copy()
                held, depths = settled(rows, codebook, moved(narrowed(held, self.width), self.moves[part]))
                changes.depths += np.bincount(depths, minlength=ENTRIES + 1)
                away = np.flatnonzero(held.entry != old)
                changes.add(part, old[away], rows[away], -1)
                changes.add(part, held.entry[away], rows[away], 1)
            results.append(held)
        return vectors, results

    def keep(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their bounds, and one row per task with its changes."""
        changes, names, kinds = Changes(self.bounds, len(self.codebooks[0])), ["id", "label", "vector", *_KEPT], []
        for batch in batches:
            kinds = [batch.column(name).type for name in names[:3]]
            if batch.num_rows:
                _, results = self.assign(batch, changes)
                entry, upper, near, lower, outer = (np.stack([getattr(held, name) for held in results], axis=1) for name in names[3:-1])
                kept = [_bytes(entry), _longs(upper), _bytes(near), _longs(lower), _longs(outer), pa.nulls(batch.num_rows, _KEPT["changes"])]
                yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names[:3]], *kept], names=names)
        if kinds:
            empty = [pa.nulls(1, kind) for kind in [*kinds, *list(_KEPT.values())[:-1]]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([changes.flat().tolist()], type=_KEPT["changes"])], names=names)

    def finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes and errors."""
        changes = Changes(self.bounds, len(self.codebooks[0]))
        for batch in batches:
            if batch.num_rows:
                vectors, results = self.assign(batch, changes)
                error = sum(squared(vectors[:, low:high], codebook[held.entry]) for (low, high), codebook, held in zip(self.bounds, self.codebooks, results))
                codes = np.stack([held.entry for held in results], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes]), pa.array(error)], names=["id", "label", "code", "error"])


def whole_numbers(rows: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """``id, label, vector`` of the rows that take part, with whole components, and their dimension (0: no rows)."""
    named = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = named.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    common = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dimension = common["size"] if common else 0
    widest = max([1, *[high - low for low, high in bounds_of(dimension, PARTS)]])
    limit = (math.isqrt(_SQUARED // widest) >> 1) / SCALE
    small = usable.where((F.size("vector") == dimension) & F.forall("vector", lambda x: F.abs(x) < limit))
    return small.select("id", "label", F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("int")).alias("vector")), dimension


def seeds(whole: DataFrame) -> np.ndarray:
    """The vectors of the smallest ids, at most ``ENTRIES``."""
    ids = [row.id for row in whole.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()]
    chosen = F.col("id").isin([one for one in ids if one is not None]) | (F.col("id").isNull() if None in ids else F.lit(False))
    first = {row.id: row.vector for row in whole.where(chosen).groupBy("id").agg(F.min("vector").alias("vector")).collect()}
    return np.array([first[one] for one in ids], dtype=np.int64)


def train(whole: DataFrame, dimension: int) -> tuple[DataFrame, Step, list[int]]:
    """The rows with their last bounds, the step that assigns them finally, and the widths of the lists on the way."""
    bounds, start = bounds_of(dimension, PARTS), seeds(whole)
    codebooks = [start[:, low:high] for low, high in bounds]
    schema = whole.select("id", "label", "vector").schema
    kept = ", ".join(f"{name} {'binary' if pa.types.is_binary(kind) else 'array<bigint>'}" for name, kind in _KEPT.items())
    fields = f"{', '.join(f'{field.name} {field.dataType.simpleString()}' for field in schema)}, {kept}"
    total, state, step, widths = Changes(bounds, len(start)), whole, Step(codebooks, None, bounds, min(MOST_NEAR, len(start) - 1)), []
    for _ in range(ROUNDS):
        written = write_version(state.mapInArrow(step.keep, fields), "bounds")
        state = written.where("changes IS NULL")
        rows = written.where("changes IS NOT NULL").select(F.posexplode("changes").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
        total.load(np.array([row.value for row in sorted(rows)], dtype=np.int64))
        codebooks = total.means(step.codebooks)
        moves = [root_ceiling(squared(old, new)) for old, new in zip(step.codebooks, codebooks)]
        widths.append(step.width)
        step = Step(codebooks, moves, bounds, _next_width(total.depths, step.width))
        if not any(move.any() for move in moves):
            break
    return state, step, widths


def _next_width(depths: np.ndarray, width: int) -> int:
    """Wide enough for most of the parts that had to be measured."""
    if not depths.any():
        return width
    enough = int(np.searchsorted(np.cumsum(depths), HELD * depths.sum()))
    return min(width, max(FEWEST_NEAR, enough))


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(value) for codebook in codebooks for value in codebook.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, code, error, codebooks_sha256`` per row that takes part; the code is two hex digits a part."""
    whole, dimension = whole_numbers(rows, vec_id, vector, label)
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in whole.select("id", "label").schema)
    if not dimension or whole.isEmpty():
        return whole.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    state, step, _ = train(whole, dimension)
    codes = state.mapInArrow(step.finish, f"{kinds}, code string, error bigint")
    return codes.withColumn("codebooks_sha256", F.lit(codebooks_digest(step.codebooks)))


def with_label_error(compressed: DataFrame) -> DataFrame:
    """The rows with the summed error of their label. Labels that fit are sent to the rows; more are joined."""
    stored = write_version(compressed, "codes")
    sums = write_version(stored.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return stored.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
