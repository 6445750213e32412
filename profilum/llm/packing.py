"""Cost-balanced packing of documents into token sequences.

A document's ids (with an end id) are cut into whole sequences and a rest. Rests are dealt at random
to groups of about ``GROUP`` pieces; within a group they go, longest first, to the sequence of the
lowest estimated cost that still has room. The cost of a piece is linear plus quadratic in its
length, as attention stays within a piece. A group starts with as many sequences as its tokens
need; a piece that fits nowhere opens one more.

Ids are those that ``tokenizers`` gives for the vocabulary file as loaded: an added token of the file, found
literally in a text, is one id, and what lies between added tokens is encoded apart.

Every id lies in exactly one piece and a sequence has no gaps. Null and empty texts have only the end
id. Repeated rows are packed each. Null ids stay null. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm.bpe import Encoder, text_batches
from profilum.sources.store import write_version

CAPACITY = 2048
GROUP = 8192
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY


def cost(lengths: np.ndarray) -> np.ndarray:
    return LINEAR * lengths + QUADRATIC * lengths.astype(np.float64) ** 2


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, given from the longest to the shortest."""
    costs = cost(lengths)
    sequences = max(1, math.ceil(int(lengths.sum()) / capacity))
    load, room = np.zeros(sequences), np.full(sequences, capacity, dtype=np.int64)
    chosen, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for place, length in enumerate(lengths.tolist()):
        best = int(np.where(room >= length, load, np.inf).argmin())
        if room[best] < length:
            best = len(room)
            load, room = np.append(load, 0.0), np.append(room, capacity)
        chosen[place], offsets[place] = best, capacity - room[best]
        load[best] += costs[place]
        room[best] -= length
    return chosen, offsets


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + place): byte for place, byte in enumerate(others)}


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``tokenizers`` file, whose ids are also its merge ranks."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"] for token in content["added_tokens"]}
    letters = _byte_characters()
    return {bytes(map(letters.__getitem__, token)): rank for token, rank in content["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens of a ``tokenizers`` file and a pattern that finds the longest at each place."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(token[option] for token in tokens for option in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    names = sorted((token["content"] for token in tokens), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None, {token["content"]: token["id"] for token in tokens}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary in a library that gives the same ids in less time."""
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _patient(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


def _plain_ids(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of a text without added tokens. Runs of millions of white space are too long for the library's patterns."""
    try:
        return np.asarray(tokenizer(path, pattern).encode_to_numpy(text), dtype="<u4")
    except ValueError:
        return _patient(path, pattern).encode([text])[0].astype("<u4")


def token_ids(text: str | None, path: str, pattern: str) -> np.ndarray:
    """The ids of a text, added tokens included."""
    places, added = _added(path)
    parts = places.split(text or "") if places else [text or ""]
    if len(parts) == 1:
        return _plain_ids(parts[0], path, pattern)
    # Every second part is an added token.
    return np.concatenate([np.array([added[part]], dtype="<u4") if place % 2 else _plain_ids(part, path, pattern) for place, part in enumerate(parts)])


def cut(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of each piece: whole sequences and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch):
                owners, starts, lengths, checks, totals, pieces = [], [], [], [], [], []
                for owner, value in enumerate(texts):
                    ids = np.append(token_ids(value, path, pattern), np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), CAPACITY):
                        piece = ids[start : start + CAPACITY]
                        owners.append(owner)
                        starts.append(start)
                        lengths.append(len(piece))
                        checks.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                        if with_ids:
                            pieces.append(piece.astype(np.int32))
                columns = [part.column("id").take(pa.array(owners, type=pa.int64())), *[pa.array(values, type=pa.int64()) for values in (starts, lengths, checks, totals)]]
                if with_ids:
                    columns.append(pa.array(pieces, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the pieces of one group, a partition."""
    group = list(batches)
    if not sum(batch.num_rows for batch in group):
        return
    table = pa.Table.from_batches(group).sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
    chosen, offsets = assign(table.column("length").to_numpy())
    sequence = ((TaskContext.get().partitionId() << 32) + chosen) * 2
    yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).to_batches()


def pack(pieces: DataFrame) -> DataFrame:
    """The pieces of ``cut`` with ``sequence_id`` (even: shared, odd: one whole piece) and ``offset``."""
    stored = write_version(pieces, "pieces")
    whole = stored.where(F.col("length") == CAPACITY).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    rests = stored.where(F.col("length") < CAPACITY)
    groups = max(1, math.ceil(rests.count() / GROUP))
    fields = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in stored.schema)
    shared = rests.repartition(groups).mapInArrow(_packed, f"{fields}, sequence_id long, offset long")
    return whole.unionByName(shared)
