"""Near duplicates by SimHash, linked through the anchor points of a covering code.

Words are runs of anything but ASCII white space in the text with A-Z lower-cased; shingles are three
words joined by spaces, repeats included, and a text with fewer words is one shingle. A fingerprint
bit is set if over half of the shingles' XXH64 (seed 42) have it. Null, empty and blank texts have
the fingerprint zero and are linked like any other.

Each distinct fingerprint stays at its home anchor, the one within the covering radius, and visits
all anchors within the radius plus the threshold. Two fingerprints at most ``threshold`` bits apart
therefore meet at the home of either, and are compared there. An anchor that is home to more than
``DENSE`` fingerprints is not compared pair by pair: its inhabitants are grouped by the values one
bit away from them. Fingerprints that share such a value are within two bits, and two within two
bits share one, so a chain through each group has the same components. A group has 65 members at most.

Repeated rows and equal ids each count as documents. A component is named by its smallest id; a null
id names none, and a component of null ids alone has a null name. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from profilum.llm.components import components
from profilum.llm.golay import home_anchors, near_anchors
from profilum.llm.names import unused
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

SEED, SHINGLE, THRESHOLD = 42, 3, 2
DENSE = 256
_CHUNK = 4096
_HASHES = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + size + 1))
    starts = [0, *(end + 1 for end in ends[:-1])]
    lasts = ends[SHINGLE - 1 :] or ends[-1:]
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, lasts)), repeat(SEED))
    ones, left = np.zeros(64, dtype=np.int64), len(lasts)
    while left:
        block = np.fromiter(hashes, dtype="<u8", count=min(left, _HASHES))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= len(block)
    return int(np.packbits(2 * ones > len(lasts), bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(text.as_py()) for text in texts], type=pa.int64())


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    return docs.withColumn(name, _fingerprints(F.col(text)))


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(home_anchors(values).astype(np.int32)), pa.array(values)], names=["anchor", "value"])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy()
        for start in range(0, len(values), _CHUNK):
            chunk = values[start : start + _CHUNK]
            rows, anchors = near_anchors(chunk, THRESHOLD)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(chunk[rows])], names=["anchor", "visitor"])


def links(values: DataFrame) -> DataFrame:
    """Links ``u, v`` that join all distinct ``value`` within the threshold; within dense anchors chains instead of pairs."""
    homes = values.mapInArrow(_homes, "anchor int, value long")
    dense = homes.groupBy("anchor").count().where(F.col("count") > DENSE).select("anchor")
    visits = values.mapInArrow(_visits, "anchor int, visitor long")
    apart = F.bit_count(F.col("value").bitwiseXOR(F.col("visitor")))
    # Spark takes visits for as many rows as values, and would send around up to 69 times what it allows.
    compared = homes.join(dense, "anchor", "left_anti").join(visits.hint("merge"), "anchor").where((F.col("value") != F.col("visitor")) & (apart <= THRESHOLD))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(np.int64(np.uint64(1 << bit)).item()) for bit in range(64)])
    around = homes.join(dense, "anchor", "left_semi").select("value", F.explode(flips).alias("flip")).select("value", F.col("value").bitwiseXOR(F.col("flip")).alias("centre"))
    groups = around.groupBy("centre").agg(F.collect_list("value").alias("members"))
    chained = groups.where(F.size("members") > 1).select(F.explode("members").alias("u"), F.array_min("members").alias("v")).where("u <> v")
    return compared.select(F.col("value").alias("u"), F.col("visitor").alias("v")).unionByName(chained)


def classes(prints: DataFrame) -> DataFrame:
    """``fingerprint, root, component_id`` per distinct fingerprint of ``id, fingerprint``; the root is the least
    fingerprint reachable and names the component uniquely, the id is its smallest document."""
    values = write_version(prints.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "fingerprints")
    roots = components(links(values.select(F.col("fingerprint").alias("value"))))
    rooted = values.join(roots, F.col("fingerprint") == F.col("vertex"), "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint, root, component_id`` per document."""
    prints = write_version(with_fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).select("id", "fingerprint"), "prints")
    return prints.join(classes(prints), "fingerprint").select("id", "fingerprint", "root", "component_id")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each component: the smallest id (null last), then the least row."""
    columns, name = docs.columns, unused(docs, "_row")
    row = F.concat(*[F.hex(F.xxhash64(F.lit(seed), *[F.col(f"`{column}`") for column in columns])) for seed in (1, 2)])
    prints = write_version(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("id"), row.alias("row"), F.col(f"`{text}`").alias("text"))).select("id", "row", "fingerprint"), "prints")
    rooted = prints.join(classes(prints.select("id", "fingerprint")).select("fingerprint", "root"), "fingerprint")
    stays = top_per_group(rooted, ["root"], [F.col("id").asc_nulls_last(), F.col("row")], 1, "_rank").select(F.col("row").alias(name)).distinct()
    kept = docs.withColumn(name, row).join(stays, name, "left_semi")
    return kept.dropDuplicates([name]).select(*[F.col(f"`{column}`") for column in columns])
