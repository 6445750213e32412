"""Bloom filters over key columns: a fixed number of bits that say which rows cannot have one of a set of keys.

A filter only ever spares work: what it lets through is still joined. Its size follows the number of keys up to
``MOST_BITS``; beyond that it lets more through and nothing changes otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

PROBES, BITS_PER_KEY, FEWEST_BITS, MOST_BITS = 3, 16, 1 << 13, 1 << 26


def bit_places(keys: list[Column], bits: int) -> list[Column]:
    """Where the bits of a key lie."""
    return [F.pmod(F.xxhash64(F.lit(probe), *keys), F.lit(bits)) for probe in range(PROBES)]


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_PER_KEY * max(1, count) - 1).bit_length()))


@dataclass(frozen=True)
class KeyFilter:
    """The bits as 64-bit words."""

    words: bytes

    @property
    def bits(self) -> int:
        return 8 * len(self.words)

    def holds(self, spark: SparkSession, *keys: Column, part: Column | None = None, bits: int | None = None) -> Column:
        """Whether the keys may be among those of the filter, or of its ``part`` of ``bits``. Null keys are looked up
        like any other."""
        sent = spark.sparkContext.broadcast(self.words)

        @F.arrow_udf(BooleanType())
        def held(*places: pa.Array) -> pa.Array:
            words = np.frombuffer(sent.value, dtype=np.uint64)
            found = [(words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) for at in (place.to_numpy() for place in places)]
            return pa.array(reduce(np.bitwise_and, found).astype(bool))

        places = bit_places(list(keys), bits or self.bits)
        return held(*[place if part is None else part.cast("long") * bits + place for place in places])


def word_rows(frame: DataFrame, keys: list[Column], bits: int, group: list[str] = ()) -> DataFrame:
    """``word, value`` (and the group): the words of the filter of each group that have a bit set."""
    places = frame.select(*group, F.explode(F.array(*bit_places(keys, bits))).alias("place"))
    # 1 << 63 is the smallest long.
    one = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    return places.groupBy(*group, F.expr("place div 64").alias("word")).agg(F.bit_or(one).alias("value"))


def key_filter(frame: DataFrame, *keys: Column, count: int | None = None) -> KeyFilter:
    """The filter of all keys of a table. The driver holds its words, ``MOST_BITS`` at most."""
    bits = bits_for(frame.count() if count is None else count)
    found = word_rows(frame, list(keys), bits).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[found["word"].to_numpy()] = found["value"].to_numpy()
    return KeyFilter(words.tobytes())
