"""Documents whose sets of word shingles have a Jaccard similarity of ``PERCENT`` / 100 at least, by a grouped prefix join.

Shingles are ``SHINGLE`` words joined by spaces after lower-casing A-Z, each once; a text with fewer words is one
shingle; a text without words has an empty set and is linked with nothing. Shingles are held as 64-bit hashes.

1. A first pass sizes every set, names it by a 128-bit hash (equal sets are one class) and counts all shingles of
   all documents into ``CELLS`` cells. A cell's rank among all cells and the hash order the shingles, rare ones first.
   The ranks are a table of fixed size, whatever the corpus.
2. A second pass takes the prefix of each set under that order: two sets that are similar enough share a shingle
   of their prefixes. Documents with the same prefix and size are one group, and only groups are joined on shingles.
3. Leaders first: of all groups that share a prefix shingle the one that has it earliest is the leader. Every
   group goes with the group that leads most of its shingles (where sizes and places allow a link), and its members are
   verified against one member of it; members of a group are verified against one of their own. Verified links make
   components.
4. What is left are pairs in different components. A shingle or a group whose members all are in one component is
   done, however many they are: a large group of near copies costs its size, not its square. Elsewhere the members
   outside the largest component of the shingle go with all members of other components, as far as sizes and the
   places of the shingle allow a link, and are verified.

Verification first compares sketches: a class carries the parity of its shingles in each of ``SKETCH`` bins or more, and
two sets differ in at least as many shingles as their sketches in bins. Bins grow with the set (``Rule.bins``): few bins are
half odd whatever long sets hold, which is less than linked ones may differ. What passes is compared as whole sets in whole
numbers. Components are exact, and links between documents of one
component that earlier ones imply are not looked for.

Null text: no words. Repeated rows and equal ids each count as documents. A component is named by its smallest id; a
null id names none, and a component of null ids alone has a null name. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from profilum.functions.membership import key_filter
from profilum.llm.components import components
from profilum.llm.words import numbered, parts_of
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

SHINGLE, PERCENT = 3, 90
CELLS, SEGMENT, SKETCH = 1 << 22, 1 << 12, 512
KEY, PLACE = ["key", "key2"], ["place", "place2"]
_SHIFT = np.uint64(64 - 22)


@dataclass(frozen=True)
class Rule:
    """Words per shingle, and the similarity in hundredths from which two sets are linked."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    def prefix(self, size: int) -> int:
        """How many of the first shingles of a set hold one of every set linked with it."""
        return size - (-(-size * self.percent // 100)) + 1 if size else 0

    def bins(self, size: int) -> int:
        """Bins of the sketch of a set, a power of two: four times as many as two linked sets of its size may differ in."""
        most = 2 * size + 2 * (-self.percent * 2 * size // (100 + self.percent))
        return max(SKETCH, 1 << max(0, 4 * most - 1).bit_length())

    def apart(self, sizes: Column) -> Column:
        """In how many shingles two linked sets of these sizes together may differ."""
        return sizes - 2 * F.ceil(self.percent * sizes / (100 + self.percent))

    def possible(self, size: Column, other: Column, shared: Column) -> Column:
        """Whether sets of these sizes can be linked if they share ``shared`` shingles at most."""
        return 100 * shared >= self.percent * (size + other - shared)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingles(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, numbers, counts = numbered([(text or b"").lower() for text in texts])
    distinct, places = np.unique(numbers, return_inverse=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(words[place]) for place in distinct.tolist()), dtype=np.uint64, count=len(distinct))[places]
    factor = np.uint64(0x9E3779B97F4A7C15)
    joined = hashes[: max(0, len(hashes) - width + 1)].copy()
    for place in range(1, width):
        joined = _mixed(joined * factor + hashes[place : place + len(joined)])
    start = 0
    for count in counts.tolist():
        if count >= width:
            yield np.unique(joined[start : start + count - width + 1])
        elif count:
            # A shorter text is a shingle of its own kind.
            yield np.array([xxhash.xxh3_64_intdigest(b" ".join(words[start : start + count]), seed=count)], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)
        start += count


def _name(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _halves(names: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]


def sketch(values: np.ndarray, bins: int = SKETCH) -> np.ndarray:
    """The parity of the hashes per bin, as signed 64-bit words."""
    odd = np.bincount((values & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(words: Column, count: Column) -> Column:
    """A sketch with fewer bins: a hash's bin is its low bits, so words that far apart are added up."""
    added = F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.aggregate(F.sequence(at, F.size(words) - 1, count), F.lit(0).cast("long"), lambda total, place: total.bitwiseXOR(words[place])))
    return F.when(F.size(words) > count, added).otherwise(words)


def differing(one: Column, other: Column) -> Column:
    """In how many bins two sketches differ, those of the smaller one."""
    count = F.least(F.size(one), F.size(other))
    apart = F.zip_with(_folded(one, count), _folded(other, count), lambda first, second: F.bit_count(first.bitwiseXOR(second)))
    return F.aggregate(apart, F.lit(0), lambda total, odd: total + odd)


def _count_cells(rule: Rule):
    """Texts to counts per cell, a row per segment of cells that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            for part in parts_of(batch, "text"):
                sets = list(shingles(part.column("text").to_pylist(), rule.shingle))
                if sets:
                    np.add.at(counts, (np.concatenate(sets) >> _SHIFT).astype(np.int64), 1)
        segments = counts.reshape(-1, SEGMENT)
        met = np.flatnonzero(segments.any(axis=1))
        for low in range(0, len(met), 64):
            some = met[low : low + 64]
            packed = [segments[place].astype(np.uint8 if segments[place].max() < 256 else np.int32).tobytes() for place in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, type=pa.binary())], names=["segment", "counts"])

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts sorted by segment to their sums."""
    current, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], type=pa.int32()), pa.array([total.tobytes()], type=pa.binary())], names=["segment", "counts"])

    for batch in batches:
        for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
            if segment != current:
                if current is not None:
                    yield row()
                current, total = segment, np.zeros(SEGMENT, dtype=np.int64)
            total += np.frombuffer(counts, dtype=np.uint8 if len(counts) == SEGMENT else np.int32)
    if current is not None:
        yield row()


def cell_ranks(source: DataFrame, rule: Rule) -> np.ndarray:
    """A byte per cell: the place of its count among those of all cells. The driver holds one count per cell."""
    counted = source.mapInArrow(_count_cells(rule), "segment int, counts binary")
    summed = counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(_sum_cells, "segment int, counts binary")
    counts = np.zeros((CELLS // SEGMENT, SEGMENT), dtype=np.int64)
    for row in summed.collect():
        counts[row.segment] = np.frombuffer(row.counts, dtype=np.int64)
    flat = counts.ravel()
    steps = np.unique(np.quantile(flat, np.arange(1, 192) / 192, method="lower"))
    # Cells far above all others keep their order too.
    high = max(1, steps[-1]) * 2.0 ** (np.arange(1, 255 - len(steps)) / 2)
    return np.searchsorted(np.append(steps, high), flat, side="left").clip(0, 255).astype(np.uint8)


def _prefixes(rule: Rule, ranks):
    """``id, place, place2, text`` to the class, group, size and prefix of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks.value, dtype=np.uint8)
        for batch in batches:
            for part in parts_of(batch, "text"):
                names, groups, sizes, prefixes, sketches = [], [], [], [], []
                for values in shingles(part.column("text").to_pylist(), rule.shingle):
                    order = np.lexsort((values, rank[(values >> _SHIFT).astype(np.int64)]))
                    prefix = values[order[: rule.prefix(len(values))]].view(np.int64)
                    names.append(_name(values))
                    groups.append(_name(np.append(prefix, len(values))))
                    sizes.append(len(values))
                    prefixes.append(prefix)
                    sketches.append(sketch(values, rule.bins(len(values))))
                bounds = np.append(0, np.cumsum(list(map(len, prefixes)))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(prefixes)))
                first, second = _halves(names)
                group, _ = _halves(groups)
                columns = [*[part.column(name) for name in ("id", *PLACE)], first, second, group, pa.array(sizes, type=pa.int32()), flat]
                ends = np.append(0, np.cumsum(list(map(len, sketches)))).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([*columns, words], names=["id", *PLACE, *KEY, "group", "size", "prefix", "sketch"])

    return run


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                values = [one.tobytes() for one in shingles(part.column("text").to_pylist(), rule.shingle)]
                yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(values, type=pa.binary())], names=["name", "values"])

    return run


def _linked(rule: Rule):
    @F.arrow_udf(BooleanType())
    def linked(one: pa.Array, other: pa.Array) -> pa.Array:
        found = []
        for first, second in zip(one, other):
            first, second = (np.frombuffer(side.as_py(), dtype=np.uint64) for side in (first, second))
            shared = len(np.intersect1d(first, second, assume_unique=True))
            found.append(100 * shared >= rule.percent * (len(first) + len(second) - shared))
        return pa.array(found, type=pa.bool_())

    return linked


def places(doc_id: str, text: str) -> list[Column]:
    """What names a document: hashes of its id and text."""
    return [F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias(name) for seed, name in enumerate(PLACE)]


class Join:
    """The tables of one join over ``docs``. Groups are told apart by a 64-bit hash and their size."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, rule: Rule) -> None:
        self.rule, self.spark = rule, docs.sparkSession
        self.source = docs.select(F.col(f"`{doc_id}`").alias("id"), *places(doc_id, text), F.col(f"`{text}`").cast("binary").alias("text"))
        kind = self.source.schema["id"].dataType.simpleString()
        ranks = self.spark.sparkContext.broadcast(cell_ranks(self.source.select("text"), rule).tobytes())
        schema = f"id {kind}, place bigint, place2 bigint, key bigint, key2 bigint, group bigint, size int, prefix array<bigint>, sketch array<bigint>"
        found = self.source.mapInArrow(_prefixes(rule, ranks), schema)
        name = F.unhex(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in KEY]))
        #: ``id, place, place2, group, size, prefix, sketch, class`` per document.
        self.documents = write_version(found.withColumn("class", name).drop(*KEY), "shingled")
        least = F.min(F.struct(*PLACE, "group", "size", "sketch")).alias("least")
        #: ``class, place, place2, group, size, sketch`` per distinct set.
        self.classes = write_version(self.documents.where("size > 0").groupBy("class").agg(least).select("class", "least.*"), "classes")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``u, v`` of classes that are linked. Only texts of classes in pairs move."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        for side in ("u", "v"):
            pairs = pairs.join(self.classes.select(F.col("class").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
        bins = differing(F.col("u_sketch"), F.col("v_sketch"))
        pairs = write_version(pairs.where(bins <= self.rule.apart(F.col("u_size") + F.col("v_size"))).select("u", "v"), "pairs")
        asked = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
        wanted = write_version(self.classes.join(asked, "class", "left_semi").select("class", *PLACE), "asked")
        near = key_filter(wanted, *map(F.col, PLACE)).holds(self.spark, *map(F.col, PLACE))
        texts = self.source.where(near).select(*PLACE, "text").join(wanted, PLACE).dropDuplicates(["class"]).select(F.col("class").alias("name"), "text")
        sets = write_version(texts.mapInArrow(_sets(self.rule), "name binary, values binary"), "sets")
        one, other = (sets.select(F.col("name").alias(side), F.col("values").alias(f"{side}_values")) for side in ("u", "v"))
        together = pairs.join(one, "u").join(other, "v")
        return write_version(together.where(_linked(self.rule)("u_values", "v_values")).select("u", "v"), "verified")

    def leader_pairs(self) -> DataFrame:
        """Members with one member of the group that leads most of their prefix shingles, and with one of their own group."""
        postings = self.documents.where("size > 0").select("group", "size", F.posexplode("prefix").alias("at", "token"))
        several = postings.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
        shared = write_version(several, "shared-shingles")
        # A shingle takes ten times its size in a table that is sent around.
        kept = postings.where(key_filter(shared, F.col("token")).holds(self.spark, F.col("token"))).join(shared.hint("merge"), "token")
        #: ``token, group, size, at`` of the prefix shingles that several groups have.
        self.entries = write_version(kept.distinct(), "entries")
        leaders = self.entries.groupBy("token").agg(F.min(F.struct("at", "size", "group")).alias("leader"))
        followed = self.entries.join(leaders, "token").where(F.col("group") != F.col("leader.group"))
        left = F.least(F.col("size") - F.col("at"), F.col("leader.size") - F.col("leader.at"))
        able = followed.where(self.rule.possible(F.col("size"), F.col("leader.size"), left)).groupBy("group", F.col("leader.group").alias("other")).count()
        pairs = top_per_group(able, ["group"], [F.desc("count"), F.col("other")], 1)
        first = self.classes.groupBy("group").agg(F.min("class").alias("v"))
        members = self.classes.select("group", F.col("class").alias("u"))
        across = members.join(pairs, "group").join(first.withColumnRenamed("group", "other"), "other")
        return across.select("u", "v").unionByName(members.join(first, "group").select("u", "v"))

    def pairs_left(self, found: DataFrame) -> DataFrame:
        """Pairs of classes in different components that may still be linked. ``found`` has ``class, root``."""
        # Roots are only told apart here, by a hash of 64 bits.
        rooted = self.classes.join(found, "class", "left").select("class", "group", "size", F.xxhash64(F.coalesce("root", "class")).alias("root"))
        rooted = write_version(rooted, "rooted")
        # Shared shingles and groups both bring members together; a group does so at place 0.
        by_token = self.entries.join(rooted.drop("size"), "group").select(F.lit(True).alias("by_token"), F.col("token").alias("meeting"), "at", "class", "size", "root")
        by_group = rooted.select(F.lit(False).alias("by_token"), F.col("group").alias("meeting"), F.lit(0).alias("at"), "class", "size", "root")
        meeting = ["by_token", "meeting"]
        members = write_version(by_token.unionByName(by_group), "members")
        mixed = members.groupBy(*meeting).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*meeting)
        members = write_version(members.join(mixed.hint("merge"), meeting), "mixed-members")
        # The largest component of a meeting: most members, then greatest root.
        sizes = members.groupBy(*meeting, "root").agg(F.count("*").alias("members"))
        largest = sizes.groupBy(*meeting).agg(F.max_by("root", F.struct("members", "root")).alias("largest"))
        minor = members.join(largest, meeting).where(F.col("root") != F.col("largest")).drop("largest")
        mine, theirs = (side.select(*meeting, *[F.col(name).alias(f"{prefix}_{name}") for name in ("at", "class", "size", "root")]) for side, prefix in ((minor, "u"), (members, "v")))
        # At the first shingle that two sets share, all others they share come later; there a linked pair passes.
        left = F.least(F.col("u_size") - F.col("u_at"), F.col("v_size") - F.col("v_at"))
        met = mine.join(theirs, meeting).where((F.col("u_root") != F.col("v_root")) & self.rule.possible(F.col("u_size"), F.col("v_size"), left))
        return met.select(F.col("u_class").alias("u"), F.col("v_class").alias("v"))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """Documents ``id, place, place2, size, class`` and verified links ``u, v`` between classes; every two documents
    whose sets are linked are connected by them. Places name a document by hashes of its id and text."""
    join = Join(docs, doc_id, text, rule)
    by_leaders = join.verified(join.leader_pairs())
    found = components(by_leaders).select(F.col("vertex").alias("class"), "root")
    others = join.verified(join.pairs_left(found))
    return join.documents.select("id", *PLACE, "size", "class"), by_leaders.unionByName(others)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``id, n_shingles, component_id`` per document."""
    documents, linked = links(docs, doc_id, text, rule)
    roots = components(linked).select(F.col("vertex").alias("class"), "root")
    classes = documents.where("size > 0").groupBy("class").agg(F.min("id").alias("least_id")).join(roots, "class", "left")
    rooted = write_version(classes.select("class", "least_id", F.coalesce("root", "class").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("class", "component_id")
    full = documents.join(named, "class", "left")
    return full.select("id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
