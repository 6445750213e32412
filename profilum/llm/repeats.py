"""Removal of long repeated strings from a corpus by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
another, goes. Strings are judged on the input and never cross texts.

* Each window of ``length`` bytes belongs to the least hashed gram of ``GRAM`` bytes inside it, its
  anchor. Equal windows have equal anchors at equal places, so they meet under the anchor's hash. The
  windows of one anchor are consecutive and form a segment.
* Anchors met once are done. Equal segments under one anchor are one with a count; a count over one
  repeats all its windows.
* The different segments of an anchor meet in a task, which builds the suffix array of a bounded batch
  of anchors and compares neighbours in it. An anchor with more than ``DENSE`` different segments is
  not gathered: its segments are cut into pieces of ``PIECE`` windows at fixed places from the anchor.
  Equal windows lie in pieces of one place that agree in the bytes all windows of that place share.
  Pieces that agree with no other are done, equal ones repeat all their windows, and only where
  different pieces meet, windows are counted one by one by 128-bit hashes, with a map-side combine.
* What is repeated goes back to all places of the segment and is merged per text.

Null text: empty. Repeated rows and equal ids are texts of their own, so a repeated row of ``length``
bytes or more is removed whole. Shorter texts stay. An empty table gives no rows. Texts are told
apart by two 64-bit hashes of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from profilum.llm.names import unused
from profilum.llm.suffixes import repeated_windows
from profilum.sources.store import write_version

LENGTH = 400
GRAM = 128
DENSE = 512
PIECE = 16
TASK_SEGMENTS = 4096
_BLOCK = 1 << 18
_BATCH_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 31) - 1)
KEY = ["key", "key2"]
SEGMENT = ["anchor", "hash", "hash2"]
PART, SAME = ["part", "part2"], ["same", "same2"]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]


def _powers(base: int, count: int) -> np.ndarray:
    result = np.empty(count, dtype=np.uint64)
    result[0] = 1
    result[1:] = base
    return np.multiply.accumulate(result)


class Winnow:
    """Anchors of a stretch of bytes. Grams are hashed by differences of prefix sums modulo 2^64."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.span = length, gram, length - gram + 1
        self.up = _powers(_BASE, _BLOCK + length)
        self.down = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + length)

    def grams(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        hashes = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
            hashes ^= hashes >> np.uint64(shift)
            hashes *= np.uint64(factor)
        return hashes ^ hashes >> np.uint64(32)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every gram, and for each window the place of its least gram (the first of equals)."""
        hashes = self.grams(data)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keys) // self.span) * self.span, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, self.span)
        to_right = np.minimum.accumulate(blocks, axis=1).ravel()
        to_left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(data) - self.length + 1
        least = np.minimum(to_left[:windows], to_right[self.span - 1 : self.span - 1 + windows])
        return hashes, (least & _PLACE).astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, where they lie, and where each begins (with the end); null: empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return everything[bounds[0] : bounds[-1]], bounds - bounds[0]


def _segments(length: int, gram: int):
    """A function from batches of ``key, key2, text`` to the segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(length, gram)
        for batch in batches:
            data, bounds = _texts(batch.column(2))
            keys = [batch.column(place).to_numpy() for place in (0, 1)]
            for low in range(0, len(data) - length + 1, _BLOCK):
                part = data[low : low + _BLOCK + length - 1]
                hashes, places = winnow.anchors(part)
                # Windows that end inside the text they start in.
                change = np.zeros(len(places) + 1, dtype=np.int32)
                inside = np.clip(np.stack([bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - length + 1)]) - low, 0, len(places))
                np.add.at(change, inside[0], 1)
                np.add.at(change, inside[1], -1)
                valid = np.append(np.cumsum(change[:-1]) > 0, False)
                fresh = valid[:-1] & ~(np.append(False, valid[:-2]) & np.append(False, places[1:] == places[:-1]))
                starts = np.flatnonzero(fresh)
                breaks = np.flatnonzero(np.append(fresh, True) | ~valid)
                ends = breaks[np.searchsorted(breaks, starts, side="right")] if len(starts) else starts
                owner = np.searchsorted(bounds, starts + low, side="right") - 1
                raw = part.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[start : end + length - 1]) for start, end in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[0][owner]),
                        pa.array(keys[1][owner]),
                        pa.array(hashes[places[starts]].view(np.int64)),
                        *_halves(digests),
                        pa.array((starts + low - bounds[owner]).astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                    ],
                    names=[*KEY, *SEGMENT, "start", "windows"],
                )

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias(name) for seed, name in enumerate(KEY)]


def _slices(length: int):
    """Batches of ``text, wanted`` to the bytes of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                data, rows = text.as_py() or b"", wanted[row].values
                if not len(rows):
                    continue
                fields = {name: rows.field(name) for name in (*SEGMENT, "start", "windows")}
                cuts = zip(fields["start"].to_pylist(), fields["windows"].to_pylist())
                content = [data[start : start + windows + length - 1] for start, windows in cuts]
                yield pa.RecordBatch.from_arrays([*[fields[name] for name in SEGMENT], pa.array(content, type=pa.binary())], names=[*SEGMENT, "content"])

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)


def _compare(length: int):
    """Segments sorted by anchor to the ranges of windows that repeat among those of the same anchor."""

    def batches_of(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        waiting, size = [], 0
        for _, group in groupby(rows, key=lambda row: row[0]):
            distinct = [next(same) for _, same in groupby(group, key=lambda row: row[:3])]
            if len(distinct) < 2:
                continue
            waiting += distinct
            size += sum(len(row[3]) for row in distinct)
            if size >= _BATCH_BYTES:
                yield waiting
                waiting, size = [], 0
        if waiting:
            yield waiting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
        for group in batches_of(rows):
            found = []
            for row, flags in zip(group, repeated_windows([row[3] for row in group], length)):
                if flags.any():
                    low, high = _runs(flags)
                    found += [(*row[:3], a, b) for a, b in zip(low.tolist(), high.tolist())]
            yield _ranges(found)

    return run


def _ranges(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array([row[place] for row in found], type=kind) for place, kind in enumerate(kinds)], names=[*SEGMENT, "low", "high"])


def _pieces(length: int, gram: int, piece: int):
    """Segments to their pieces: the windows that start in one stretch of ``piece`` places counted back from the anchor.
    ``part`` names the stretch and the bytes that every window from there has, ``same`` the windows of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(length, gram)
        for batch in batches:
            rows, parts, sames = [], [], []
            for *segment, content in zip(*[batch.column(name).to_pylist() for name in (*SEGMENT, "content")]):
                place = int(np.argmin(winnow.grams(np.frombuffer(content, dtype=np.uint8, count=length)) & ~_PLACE))
                least = place - (len(content) - length)
                for near in range(least // piece * piece, place + 1, piece):
                    far = min(near + piece - 1, length - gram)
                    low, high = place - min(far, place), place - max(near, least) + 1
                    parts.append(xxhash.xxh3_128_digest(content[place - near : place - far + length], seed=near))
                    sames.append(xxhash.xxh3_128_digest(content[low : high + length - 1], seed=place - low))
                    rows.append((*segment, low, high))
            found = _ranges(rows)
            yield pa.RecordBatch.from_arrays([*found.columns, *_halves(parts), *_halves(sames)], names=[*found.schema.names, *PART, *SAME])

    return run


def _windows(length: int):
    """Segments to the hashes of their windows in the wanted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for *segment, content, wanted in zip(*[batch.column(name).to_pylist() for name in (*SEGMENT, "content", "wanted")]):
                for place in (place for some in wanted for place in range(some["low"], some["high"])):
                    rows.append((*segment, place, place + 1))
                    digests.append(xxhash.xxh3_128_digest(content[place : place + length]))
            found = _ranges(rows)
            yield pa.RecordBatch.from_arrays([*found.columns, *_halves(digests)], names=[*found.schema.names, "window", "window2"])

    return run


def _by_pieces(dense: DataFrame, length: int, gram: int) -> DataFrame:
    """The ranges of windows that repeat among the different segments of an anchor, for any number of them."""
    ranges = "anchor long, hash long, hash2 long, low int, high int"
    found = write_version(dense.mapInArrow(_pieces(length, gram, PIECE), f"{ranges}, part long, part2 long, same long, same2 long"), "pieces")
    distinct = found.groupBy(*PART, *SAME).agg(F.count("*").alias("times"), F.min(F.struct(*SEGMENT, "low", "high")).alias("place"))
    distinct = write_version(distinct, "distinct-pieces")
    whole = found.join(distinct.where("times > 1").select(*SAME), SAME).select(*SEGMENT, "low", "high")
    # Of equal pieces one is enough to meet the others of its part.
    mixed = distinct.groupBy(*PART).agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("kinds > 1 and fewest = 1").select(*PART)
    asked = distinct.join(mixed, PART).select("place.*").groupBy(*SEGMENT).agg(F.collect_list(F.struct("low", "high")).alias("wanted"))
    windows = dense.join(asked, SEGMENT).select(*SEGMENT, "content", "wanted").mapInArrow(_windows(length), f"{ranges}, window long, window2 long")
    windows = write_version(windows, "windows")
    counted = windows.groupBy("window", "window2").agg(F.count("*").alias("times")).where("times > 1").select("window", "window2")
    return whole.unionByName(windows.join(counted, ["window", "window2"]).select(*SEGMENT, "low", "high"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, key2, spans``: for texts with repeated strings, the byte ranges to remove as a flat array of
    starts and ends, not yet merged."""
    source = docs.select(*_keyed(docs, doc_id, text), F.col(f"`{text}`").alias("text"))
    found = write_version(source.mapInArrow(_segments(length, gram), "key long, key2 long, anchor long, hash long, hash2 long, start int, windows int"), "segments")
    # Written apart, so that the join meets the anchors as they are stored and splits those with many rows.
    often = write_version(found.groupBy("anchor").count().where("count > 1").select("anchor"), "frequent-anchors")
    places = write_version(found.join(often, "anchor"), "repeated-anchors")

    distinct = places.groupBy(*SEGMENT).agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "start", "windows")).alias("place"))
    distinct = write_version(distinct.select(*SEGMENT, "times", "place.*"), "distinct-segments")
    kinds = write_version(distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("kinds > 1 and fewest = 1"), "mixed-anchors")
    compared = distinct.join(kinds, "anchor")
    wanted = compared.groupBy(*KEY).agg(F.collect_list(F.struct(*SEGMENT, "start", "windows")).alias("wanted"))
    texts = source.join(wanted, KEY).select("text", "wanted")
    contents = texts.mapInArrow(_slices(length), "anchor long, hash long, hash2 long, content binary")
    contents = write_version(contents.join(kinds.select("anchor", "kinds"), "anchor").select(*SEGMENT, "content", "kinds"), "contents")
    ranges = "anchor long, hash long, hash2 long, low int, high int"
    sparse = contents.where(F.col("kinds") <= DENSE).select(*SEGMENT, "content")
    # Sorting costs far more than reading, so the tasks follow the number of segments and not their bytes.
    counts = contents.agg(F.count("*"), F.count_if(F.col("kinds") > DENSE)).first()
    tasks = max(1, -(-counts[0] // TASK_SEGMENTS))
    marks = sparse.repartition(tasks, "anchor").sortWithinPartitions(*SEGMENT).mapInArrow(_compare(length), ranges)
    if counts[1]:
        dense = contents.where(F.col("kinds") > DENSE).select(*SEGMENT, "content").dropDuplicates(SEGMENT)
        marks = marks.unionByName(_by_pieces(write_version(dense, "dense"), length, gram))
    whole = distinct.where("times > 1").select(*SEGMENT, F.lit(0).alias("low"), F.col("windows").alias("high"))
    marks = marks.unionByName(whole)
    spans = places.join(marks, SEGMENT).select(*KEY, F.array(F.col("start") + F.col("low"), F.col("start") + F.col("high") + (length - 1)).alias("span"))
    return spans.groupBy(*KEY).agg(F.flatten(F.collect_set("span")).alias("spans"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Ranges of a flat array as maximal runs in order; ranges that touch are one run."""
    runs: list[tuple[int, int]] = []
    if spans is None:
        return runs
    for low, high in sorted(zip(spans[::2], spans[1::2])):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    bounds = [0, *(place for run in runs for place in run), len(data)]
    return b"".join(data[low:high] for low, high in zip(bounds[::2], bounds[1::2]))


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that are removed only in part."""
    inner = []
    for low, high in runs:
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        inner.append((low, high))
    return inner


@F.arrow_udf(StructType([StructField("runs", ArrayType(LongType())), StructField("kept", BinaryType()), StructField("text", StringType())]))
def _removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
    runs = [merged(span.as_py()) for span in spans]
    whole = [(text.as_py() or "").encode("utf-8", "replace") for text in texts]
    kept = [without(data, run) for data, run in zip(whole, runs)]
    readable = [without(data, whole_characters(data, run)).decode("utf-8") for data, run in zip(whole, runs)]
    flat = [[place for run in row for place in run] for row in runs]
    return pa.StructArray.from_arrays([pa.array(flat, type=pa.list_(pa.int64())), pa.array(kept, type=pa.binary()), pa.array(readable, type=pa.string())], names=["runs", "kept", "text"])


@F.arrow_udf(StringType())
def _kept_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept = []
    for text, span in zip(texts, spans):
        text = text.as_py()
        if text is not None and span.is_valid:
            data = text.encode("utf-8", "replace")
            text = without(data, whole_characters(data, merged(span.as_py()))).decode("utf-8")
        kept.append(text)
    return pa.array(kept, type=pa.string())


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, n_bytes, runs, kept, text`` per text: its size, the maximal removed runs as a flat array of starts and
    ends, the bytes that are left, and these as text in which a character removed only in part is whole."""
    spans = repeated_spans(docs, doc_id, text, length, gram)
    source = docs.select(*_keyed(docs, doc_id, text), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    cut = source.join(spans, KEY, "left").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _removed("text", "spans").alias("cut"))
    return cut.select("id", "n_bytes", "cut.runs", "cut.kept", "cut.text")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with all their columns and the repeated strings taken out of ``text``. A character of
    which only some bytes are covered stays."""
    names = [unused(docs, f"_{name}") for name in KEY]
    found = unused(docs, "_spans")
    spans = repeated_spans(docs, doc_id, text, length, gram).select(*[F.col(name).alias(own) for name, own in zip(KEY, names)], F.col("spans").alias(found))
    keyed = docs.select("*", *[column.alias(own) for column, own in zip(_keyed(docs, doc_id, text), names)])
    joined = keyed.join(spans, names, "left")
    return joined.select(*[_kept_text(F.col(f"`{name}`"), F.col(found)).alias(name) if name == text else F.col(f"`{name}`") for name in docs.columns])


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("runs") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "text",
    )
