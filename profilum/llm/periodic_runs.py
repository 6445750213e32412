"""Periodic runs of words through string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends
and that is at least ``LEAST`` words and ``TIMES`` periods long.

Periods up to ``SMALL`` are found apart, from words that equal the word one, two or three places on; these
stretches are the highly periodic regions. Longer periods come from scales t = 2, 4, 8, ...: scale t serves
periods from 2t up to 4t.

* A place belongs to the synchronising set of its scale if the least hash among the strings of t words that start
  from it to t places on is that of the first or of the last of them. Strings inside a highly periodic region of
  a period of t/3 at most take no part. Membership depends on the next 2t words alone, so equal contexts are
  chosen alike; and any t places that no highly periodic region covers hold a chosen one.
* In a run of period q (2t <= q < 4t) and four periods, a chosen place lies within the first q + t words and recurs
  q words on with an equal context of L words, where L is 3t below a period of 3t and 4t above: both fit into
  the run. As L >= q, no closer place inside the run has that context. Chosen places are sorted by their contexts,
  and each pair of consecutive equal ones whose distance suits the scale proposes its distance as a period.
* A proposal is extended to both sides over the words themselves, which decides.

Hashes only propose. Texts are worked on whole, many at once, with a separator between them that equals nothing.

Null, empty and blank texts have no words and no runs. Repeated rows count each, null ids stay null, an empty table
gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.llm.words import numbered, parts_of

LEAST, TIMES, SMALL = 6, 4, 3
_SPACES = r"[\x20\x09-\x0D]+"
_TOP = np.uint64(np.iinfo(np.uint64).max)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _small_periods(words: np.ndarray) -> tuple[list[tuple[int, int, int]], list[np.ndarray]]:
    """Runs of the small periods, and per period for each place how many words from there on have the period."""
    runs, reach, constant = [], [], None
    for period in range(1, SMALL + 1):
        equal = words[:-period] == words[period:]
        starts, ends = _stretches(equal)
        along = np.zeros(len(words), dtype=np.int64)
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end - start >= period:
                along[start:end] = end - np.arange(start, end) + period
        reach.append(along)
        if period == 1:
            constant = along
        for start, end in zip(starts.tolist(), ends.tolist()):
            length = end - start + period
            # A long stretch of period 2 or 3 has a smaller one only if its words are all equal.
            if length >= max(LEAST, TIMES * period) and (period == 1 or constant[start] < length):
                runs.append((start, length, period))
    return runs, reach


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on, ``width`` one more than a power of two."""
    step = 1
    while 2 * step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :])


def chosen(hashes: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set among strings of ``scale`` words with these hashes; ``periodic`` ones take no part."""
    if len(hashes) <= scale:
        return np.empty(0, dtype=np.int64)
    keys = np.where(periodic, _TOP, hashes)
    least = _least(keys, scale + 1)
    first, last = keys[: len(least)], keys[scale : scale + len(least)]
    return np.flatnonzero((least != _TOP) & ((least == first) | (least == last)))


def _proposals(hashes: np.ndarray, short: np.ndarray, places: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """``period, place`` of consecutive equal contexts of the chosen places. ``hashes`` are those of ``scale`` words."""
    found = []
    twice = _joined(hashes[:-scale], hashes[scale:]) if len(hashes) > scale else hashes[:0]
    for times, low, high in ((3, 2 * scale, 3 * scale), (4, 3 * scale, 4 * scale)):
        count = len(short) - times * scale + 1
        at = places[places < count]
        if len(at) < 2:
            continue
        contexts = _joined(twice[at], hashes[at + 2 * scale] if times == 3 else twice[at + 2 * scale])
        order = np.lexsort((at, contexts))
        same = contexts[order[1:]] == contexts[order[:-1]]
        first, second = at[order[:-1]][same], at[order[1:]][same]
        apart = second - first
        suits = (apart >= low) & (apart < high)
        found += zip(apart[suits].tolist(), first[suits].tolist())
    return found


def _matching(words: np.ndarray, first: int, second: int, step: int) -> int:
    """How many words agree from both places on, walking by ``step`` (1 or -1)."""
    matched, size = 0, 16
    limit = len(words) - max(first, second) if step > 0 else min(first, second) + 1
    while matched < limit:
        size = min(size, limit - matched)
        if step > 0:
            one, other = (words[place + matched : place + matched + size] for place in (first, second))
        else:
            one, other = (words[place - matched - size + 1 : place - matched + 1][::-1] for place in (first, second))
        differs = np.flatnonzero(one != other)
        if len(differs):
            return matched + int(differs[0])
        matched, size = matched + size, 2 * size
    return matched


def _extended(words: np.ndarray, proposals: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    runs, period_before, end_before = [], 0, 0
    for period, place in sorted(proposals):
        if period == period_before and place + period < end_before:
            continue
        left = _matching(words, place - 1, place + period - 1, -1) if place else 0
        right = _matching(words, place, place + period, 1)
        start, length = place - left, left + right + period
        period_before, end_before = period, start + length
        if length >= max(LEAST, TIMES * period):
            runs.append((start, length, period))
    return runs


def _gathered(words: np.ndarray, origin: np.ndarray, bounds: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts (with their separators) named by ``longest``, and where their words come from."""
    sizes = bounds[longest + 1] - bounds[longest]
    ends = np.cumsum(sizes)
    taken = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(bounds[longest], sizes)
    return words[taken], origin[taken], np.append(0, ends), taken


def runs_of(numbers: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of all runs of each text, by start and period. ``numbers`` are the words of the texts
    one after the other, ``counts`` how many each has."""
    bounds = np.append(0, np.cumsum(counts + 1))
    words = np.empty(bounds[-1], dtype=np.int64)
    separators = bounds[1:] - 1
    inside = np.ones(len(words), dtype=bool)
    inside[separators] = False
    words[inside] = numbers
    # Separators equal nothing, not even one another.
    words[separators] = -1 - np.arange(len(separators))
    found, reach = _small_periods(words)
    origin = np.arange(len(words))
    scale = 2
    hashes = _mixed(words.astype(np.uint64))
    hashes = _joined(hashes[:-1], hashes[1:])
    while True:
        # Only texts that can hold four of the shortest periods of the scale go on.
        long = np.flatnonzero(np.diff(bounds) - 1 >= TIMES * 2 * scale)
        if not len(long):
            break
        if len(long) < len(bounds) - 1:
            full = np.append(hashes, np.zeros(len(words) - len(hashes), dtype=np.uint64))
            words, origin, bounds, taken = _gathered(words, origin, bounds, long)
            reach = [along[taken] for along in reach]
            hashes = full[taken][: len(words) - scale + 1]
        periodic = np.zeros(len(hashes), dtype=bool)
        for period in range(1, min(SMALL, scale // 3) + 1):
            periodic |= reach[period - 1][: len(hashes)] >= scale
        places = chosen(hashes, periodic, scale)
        runs = _extended(words, _proposals(hashes, words, places, scale))
        found += [(int(origin[start]), length, period) for start, length, period in runs]
        hashes = _joined(hashes[:-scale], hashes[scale:])
        scale *= 2
    begins = np.append(0, np.cumsum(counts + 1))
    by_text: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    owners = np.searchsorted(begins, [start for start, _, _ in found], side="right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), found):
        by_text[owner].append((start - int(begins[owner]), length, period))
    return [sorted(set(runs), key=lambda run: (run[0], run[2])) for runs in by_text]


def kept(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``count`` words no run contains after its first period."""
    change = np.zeros(count + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, "text"):
            words, numbers, counts = numbered(part.column("text").to_pylist())
            ends = np.cumsum(counts).tolist()
            runs, left = runs_of(numbers, counts), []
            for own, count, end in zip(runs, counts.tolist(), ends):
                mine = words[end - count : end]
                left.append(b" ".join([word for word, stays in zip(mine, kept(count, own).tolist()) if stays] if own else mine))
            rows = [[{"start": start, "length": length, "period": period} for start, length, period in own] for own in runs]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), pa.array(rows, type=RUNS), pa.array(left, type=pa.binary())], names=["id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed`` per text: its runs by start and period, and its words joined by one space
    without those that a run contains after its first period (as UTF-8 bytes)."""
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_found, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")


def repeated_on_purpose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` where about a tenth of the texts, chosen by a checksum of the id, have a periodic tail from
    a place and with a period that follow from the checksum. Texts with a null id stay."""
    checksum = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(f"`{text}`"), _SPACES), lambda word: word != "")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), checksum.alias("h"))
    base = base.withColumn("words", F.when((F.col("h") % 10 == 0), words))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    sized = base.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + g % 8)) + 1)

    def source(place: Column) -> Column:
        return F.when(place < F.col("a"), place).otherwise(F.col("a") + (place - F.col("a")) % F.col("p"))

    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda place: F.element_at("words", (source(place) + 1).cast("int")))
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per text: how many runs, the longest (ties: smallest start, then period), and digests of all runs and of what is left."""
    ranked = F.array_max(F.transform("runs", lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("start"), (-run["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))), "")
    return found.withColumn("longest", ranked).select(
        "id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / (-F.col("longest.period"))).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
