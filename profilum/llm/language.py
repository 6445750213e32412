"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of ``ORDER`` bytes: how often each byte followed each context of up to
that length, text starting after line feeds. A byte costs minus the logarithm of its share among what
followed the longest known context; where it never did, an escape (distinct followers over
occurrences plus distinct followers) and then its cost one context shorter, down to eight bits flat.
The statistics are frozen: a text's code length under a language is the sum over all its bytes, kept
in whole units of 1/65536 bit, so that it does not depend on how Spark batches the texts. The
shortest code names the language, ties the smaller name; the score is its weight among all languages
when each bit counts half.

Learning takes at most ``ROWS`` labelled texts of every language, chosen by a hash of id and text, and ``BYTES`` of
their bytes: longer texts give as many of their first bytes as fit if all of them give the same. Trees are
held for groups of languages, one group at a time; scoring takes every byte of every text under every language. Null texts and
texts without a letter are ``und`` with score 0, and so is everything if nothing was learned. Rows
with null id, text or label teach nothing. Repeated rows are scored each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

ORDER = 4
ROWS, BYTES = 1000, 1 << 20
# Grams times languages of a group, and labels that may be broadcast.
GROUP_CELLS, BROADCAST_LABELS = 1 << 24, 100_000
UNIT = 65536
UNDETERMINED = "und"
_BLOCK = 1 << 18
_FLAT = 8 * UNIT


class Places:
    """An open-addressed table from non-negative integers to their places in a sorted array."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.places = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots] < 0
            _, winners = np.unique(np.where(free, slots, -1), return_index=True)
            winners = winners[free[winners]]
            self.keys[slots[winners]] = keys[left[winners]]
            self.places[slots[winners]] = left[winners]
            waiting = np.ones(len(left), dtype=bool)
            waiting[winners] = False
            left, slots = left[waiting], (slots[waiting] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        slots = self._slots(keys)
        met = self.keys[slots]
        result = np.where(met == keys, self.places[slots], -1)
        astray = np.flatnonzero((met != keys) & (met >= 0))
        slots = slots[astray]
        while len(astray):
            slots = (slots + 1) & (len(self.keys) - 1)
            met = self.keys[slots]
            hit = met == keys[astray]
            result[astray[hit]] = self.places[slots[hit]]
            further = ~hit & (met >= 0)
            astray, slots = astray[further], slots[further]
        return result


@dataclass
class Level:
    """Costs of the known grams of one order and of escaping from its contexts: one row per language."""

    grams: Places
    costs: np.ndarray
    contexts: Places
    escapes: np.ndarray


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Every byte after the first ``order`` as the last of a gram with its context."""
    result = np.zeros(len(data) - order, dtype=np.int64)
    for place in range(order + 1):
        result = result << 8 | data[place : place + len(result)]
    return result


class Model:
    """Code lengths under the trees of several languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        self.order, self.languages, self.levels = order, sorted(counts), []
        for depth in range(order + 1):
            mask = (1 << 8 * (depth + 1)) - 1
            seen = []
            for language in self.languages:
                full, times = counts[language]
                keys, inverse = np.unique(full & mask, return_inverse=True)
                seen.append((keys, np.bincount(inverse, times)))
            union = np.unique(np.concatenate([keys for keys, _ in seen] or [np.empty(0, dtype=np.int64)]))
            above = np.unique(union >> 8)
            escapes = np.zeros((len(self.languages), len(above)), dtype=np.int32)
            costs = self.below(union).astype(np.int64)
            for row, (keys, times) in enumerate(seen):
                places = np.searchsorted(above, keys >> 8)
                total = np.bincount(places, times, minlength=len(above))
                kinds = np.bincount(places, minlength=len(above))
                known = total > 0
                escapes[row, known] = np.rint(UNIT * np.log2((total[known] + kinds[known]) / kinds[known]))
                costs[row] += escapes[row, np.searchsorted(above, union >> 8)]
                costs[row, np.searchsorted(union, keys)] = np.rint(UNIT * np.log2((total + kinds)[places] / times))
            self.levels.append(Level(Places(union), costs.astype(np.int32), Places(above), escapes))

    def below(self, keys: np.ndarray) -> np.ndarray:
        """What each gram costs under each language without its first byte, by the levels built so far."""
        result = np.zeros((len(self.languages), len(keys)), dtype=np.int64)
        left = np.arange(len(keys))
        for depth in range(len(self.levels) - 1, -1, -1):
            level, own = self.levels[depth], keys[left] & ((1 << 8 * (depth + 1)) - 1)
            place = level.grams.find(own)
            hit = place >= 0
            result[:, left[hit]] += level.costs[:, place[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return result
            context = level.contexts.find(own >> 8)
            known = context >= 0
            result[:, left[known]] += level.escapes[:, context[known]]
        result[:, left] += _FLAT
        return result

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text under each language, in units."""
        lead = b"\n" * self.order
        totals = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        top = self.levels[-1]
        for owners, data, ends in _stretches(texts, lead):
            keys = grams(np.frombuffer(data, dtype=np.uint8), self.order)
            # The grams that lead from one text into the next say nothing.
            starts = np.concatenate([[0], ends[:-1]])
            real = np.ones(len(keys), dtype=bool)
            for gap in range(1, self.order + 1):
                real[(starts[1:] - gap)] = False
            keys = keys[real]
            bounds = starts - self.order * np.arange(len(starts))
            places = top.grams.find(keys)
            missing = np.flatnonzero(places < 0)
            spare = keys[missing]
            rest = np.zeros((len(self.languages), len(missing)), dtype=np.int64)
            if len(missing):
                context = top.contexts.find(spare >> 8)
                known = context >= 0
                rest[:, known] += top.escapes[:, context[known]]
                lower = Model.__new__(Model)
                lower.languages, lower.levels = self.languages, self.levels[:-1]
                rest += lower.below(spare)
            for row in range(len(self.languages)):
                costs = top.costs[row][places]
                costs[missing] = rest[row]
                totals[owners, row] += np.add.reduceat(costs, bounds, dtype=np.int64)
        return totals


def _stretches(texts: list[bytes], lead: bytes) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Texts, each after its lead, joined to stretches of bounded size: owners, bytes and where each ends. A long
    text is cut where the next stretch begins with its last bytes as lead."""
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for owner, text in enumerate(texts):
        for low in range(0, len(text), _BLOCK):
            before = (lead + text[:low])[-len(lead) :] if low < len(lead) else text[low - len(lead) : low]
            parts.append(before + text[low : low + _BLOCK])
            owners.append(owner)
            size += len(parts[-1])
            if size >= _BLOCK:
                yield owners, b"".join(parts), np.cumsum([len(part) for part in parts])
                owners, parts, size = [], [], 0
    if owners:
        yield owners, b"".join(parts), np.cumsum([len(part) for part in parts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text, level in zip(*[batch.column(name).to_pylist() for name in ("lang", "text", "level")]):
            data = text.encode("utf-8", "replace")[:level]
            if data:
                keys, times = np.unique(grams(np.frombuffer(b"\n" * ORDER + data, dtype=np.uint8)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(times)], names=["lang", "gram", "times"])


def _groups(sizes: list[tuple[str, int]]) -> Iterator[list[str]]:
    """Languages, given with their counts of grams, in groups of at most ``GROUP_CELLS`` cells or of one language."""
    group, total = [], 0
    for language, size in sizes:
        if group and (len(group) + 1) * (total + size) > GROUP_CELLS:
            yield group
            group, total = [], 0
        group.append(language)
        total += size
    if group:
        yield group


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Broadcast[Model]]:
    """Learn from a bounded sample of labelled texts: the trees of all languages, in groups by name. The counts are
    made and kept by Spark; those of one group are bounded, so its trees can be built here and sent to the executors."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    known = write_version(rows.groupBy("lang").count(), "labels")
    # A few times as many rows as wanted pass the hash, however many there are; copies of a row count once.
    share = known.select("lang", F.least(F.lit(1.0), 4.0 * ROWS / F.col("count")).alias("share"))
    hashed = rows.withColumn("hash", F.xxhash64("id", "text")).join(F.broadcast(share) if known.count() <= BROADCAST_LABELS else share, "lang")
    passed = hashed.where(F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30)).withColumn("text", F.substring("text", 1, BYTES))
    texts = top_per_group(passed.groupBy("lang", "hash").agg(F.min("text").alias("text")), ["lang"], [F.col("hash")], ROWS, "place")
    # From the shortest text on, each may take an equal part of the bytes that are left; where that is the most, it is the level.
    own = Window.partitionBy("lang")
    ordered = own.orderBy("size", "place")
    before = F.coalesce(F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor((F.lit(BYTES) - before) / (F.count("*").over(own) - F.row_number().over(ordered) + 1))
    parts = texts.withColumn("size", F.octet_length("text").cast("long")).withColumn("part", part)
    sample = parts.withColumn("level", F.max("part").over(own)).select("lang", "text", "level")
    counted = sample.mapInArrow(_count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    stored = write_version(counted.sortWithinPartitions("lang"), "grams")
    sizes = sorted((row["lang"], row["size"]) for row in stored.groupBy("lang").agg(F.count("*").alias("size")).collect())
    models = []
    for group in _groups(sizes):
        table = stored.where(F.col("lang").isin(group)).toArrow()
        counts = {}
        for language in group:
            found = table.filter(pc.equal(table.column("lang"), language))
            counts[language] = (found.column("gram").to_numpy(), found.column("times").to_numpy())
        models.append(labelled.sparkSession.sparkContext.broadcast(Model(counts)))
    return models


def _each(models: list[Broadcast[Model]]) -> Iterator[Model]:
    """The trees of each group; of several groups a worker holds one at a time and reads it again from its local copy."""
    for shared in models:
        yield shared.value
        if len(models) > 1 and hasattr(shared, "_path"):
            del shared._value


_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predict(docs: DataFrame, models: list[Broadcast[Model]], text: str = "text") -> Column:
    """A column ``struct<lang, score>`` for the texts of ``docs``."""

    @F.arrow_udf(_RESULT)
    def predicted(texts: pa.Array) -> pa.Array:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        wanted = [row for row, has in enumerate(letters) if has and models]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if wanted:
            coded = [texts[row].as_py().encode("utf-8", "replace") for row in wanted]
            least, total, chosen = None, None, None
            for trees in _each(models):
                found = trees.code_lengths(coded)
                shortest = found.min(axis=1)
                weight = np.exp2(-(found - shortest[:, None]) / UNIT).sum(axis=1)
                best = np.array(trees.languages, dtype=object)[found.argmin(axis=1)]
                if least is None:
                    least, total, chosen = shortest, weight, best
                    continue
                # Groups come by name, so ties stay with the earlier one.
                lowest = np.minimum(least, shortest)
                total = total * np.exp2(-(least - lowest) / UNIT) + weight * np.exp2(-(shortest - lowest) / UNIT)
                chosen = np.where(shortest < least, best, chosen)
                least = lowest
            for row, name, share in zip(wanted, chosen.tolist(), (1 / total).tolist()):
                names[row], scores[row] = name, share
        return pa.StructArray.from_arrays([pa.array(names), pa.array(scores, type=pa.float64())], names=["lang", "score"])

    # Said to vary, so that a filter on the result does not predict every text a second time in a second Python worker.
    return predicted.asNondeterministic()(F.col(f"`{text}`"))


def learnable(doc_id: str = "doc_id") -> Column:
    """The fold that may be learned from; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score``, learned from the rows of the same table that are not held out. A row
    without an id is neither learned from nor held out."""
    models = fit(docs.where(learnable(doc_id)), doc_id, text, lang)
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(~learnable(doc_id), F.lit(False)).alias("held_out"), predict(docs, models, text).alias("found"))
    return found.select("id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
