"""Byte-level BPE by a rank queue on a hierarchical bitmap, and its decoding.

Text is cut by a pattern into pre-tokens that merge on their own. All pre-tokens of a batch that the
worker has not met before are laid out as one linked list, so one pass of the queue serves them
all, and one pre-token of many megabytes as well. There is a bucket of list positions for every
merge rank; a bitmap with 64-way levels above it finds the first rank that has any. All positions of
that bucket merge at once, from left to right where they overlap; positions whose pair has changed
since they were put in are stale and are skipped. A few tokens can make a pair of an earlier rank
than their own, which comes before their next merge: they merge once per pre-token at a time.

Null and empty texts have no ids. Repeated rows are encoded each. Other columns are not read. Ids
that the file lacks do not decode: ``decode`` raises. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARACTERS = 1 << 22
BATCH_IDS = 1 << 20
LONG_TEXT = 1 << 20
KNOWN_PIECES = 400_000


class RankQueue:
    """Buckets of positions by rank; the lowest filled rank is found by find-first-set on each level."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size <= 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            rank, bit = rank >> 6, 1 << (rank & 63)
            before = level[rank]
            level[rank] = before | bit
            if before:
                break

    def first(self) -> int | None:
        if not self.levels[-1][0]:
            return None
        place = 0
        for level in reversed(self.levels):
            word = level[place]
            place = place << 6 | (word & -word).bit_length() - 1
        return place

    def take(self, rank: int) -> np.ndarray:
        """Empty a bucket; its positions from left to right."""
        bucket = self.buckets.pop(rank)
        for level in self.levels:
            place, bit = rank >> 6, 1 << (rank & 63)
            level[place] &= ~bit
            if level[place]:
                break
            rank = place
        return np.unique(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Ranks by token: which two tokens make which, and the bytes of each."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(self.ranks.values()) + 1
        self.bytes = np.array([self.ranks[bytes([byte])] for byte in range(256)], dtype=np.int64)
        pairs = sorted(
            (left * self.size + right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        )
        self.keys = np.array([key for key, _ in pairs] or [-1], dtype=np.int64)
        self.made = np.array([rank for _, rank in pairs] or [-1], dtype=np.int64)
        # Tokens whose making can make a pair of an earlier rank.
        self.reaching_back = {int(part) for parts in (self.keys // self.size, self.keys % self.size) for part in parts[parts > self.made]}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge or has no right part."""
        keys = left * self.size + right
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[places] == keys) & (right < self.size), self.made[places], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty pieces, one after the other, and where each piece begins (with the end)."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(ends[-1]) if len(ends) else 0
        token = np.append(self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)], self.size)
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n)
        after[ends - 1] = n
        before[starts] = n
        rank_at = self.pair_ranks(token, token[after])
        queue = RankQueue(self.size)

        def push(positions: np.ndarray) -> None:
            ranks = rank_at[positions]
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for rank, begin, end in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
                queue.push(rank, positions[begin:end])

        push(np.arange(n))
        while (rank := queue.first()) is not None:
            positions = queue.take(rank)
            positions = positions[rank_at[positions] == rank]
            if not len(positions):
                continue
            if rank in self.reaching_back and len(positions) > 1:
                owners = np.searchsorted(starts, positions, side="right")
                again = np.append(False, owners[1:] == owners[:-1])
                if again.any():
                    queue.push(rank, positions[again])
                    positions = positions[~again]
            gone = after[positions]
            follows = np.append(False, gone[:-1] == positions[1:])
            if follows.any():
                place = np.arange(len(positions))
                run = place - np.maximum.accumulate(np.where(follows, 0, place))
                positions, gone = positions[run % 2 == 0], gone[run % 2 == 0]
            token[positions] = rank
            behind = after[gone]
            after[positions] = behind
            before[behind] = positions
            before[n] = n
            rank_at[gone] = -1
            token[gone] = -1
            changed = np.unique(np.concatenate([positions, before[positions]]))
            changed = changed[changed < n]
            rank_at[changed] = self.pair_ranks(token[changed], token[after[changed]])
            push(changed)
        alive = np.flatnonzero(token[:n] >= 0)
        return token[alive], np.append(np.searchsorted(alive, starts), len(alive))


class Encoder:
    """Texts to ids, with the pre-tokens met so far kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.begins = np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        coded = [piece.encode("utf-8", "replace") for piece in pieces]
        whole = [self.merges.ranks.get(piece, -1) for piece in coded]
        values, begins = self.merges.merge([piece for piece, rank in zip(coded, whole) if rank < 0])
        ranks = np.array(whole, dtype=np.int64)
        counts = np.ones(len(pieces), dtype=np.int64)
        counts[ranks < 0] = np.diff(begins)
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), dtype=np.int32)
        single = np.repeat(ranks >= 0, counts)
        ids[single] = ranks[ranks >= 0]
        ids[~single] = values
        first = len(self.begins) - 1
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.begins = np.concatenate([self.begins, self.begins[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces together and how many each has."""
        if len(self.known) > KNOWN_PIECES:
            self.forget()
        if new := [piece for piece in dict.fromkeys(pieces) if piece not in self.known]:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        begins = self.begins[places]
        counts = self.begins[places + 1] - begins
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(begins - ends + counts, counts)], counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together and where each text begins (with the end)."""
        found, sizes = [], []
        waiting: list[str] = []
        owners: list[int] = []

        def flush() -> None:
            ids, counts = self._encode(waiting)
            found.append(ids)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            sizes.extend(np.diff(bounds[np.concatenate([[0], np.cumsum(owners)]).astype(np.int64)]).tolist())
            waiting.clear()
            owners.clear()

        for text in texts:
            if text is None or len(text) < LONG_TEXT:
                pieces = self.pattern.findall(text) if text else []
                owners.append(len(pieces))
                waiting.extend(pieces)
                continue
            flush()
            matches, total = self.pattern.finditer(text), 0
            while pieces := [match.group() for match in islice(matches, LONG_TEXT // 4)]:
                ids, _ = self._encode(pieces)
                found.append(ids)
                total += len(ids)
            sizes.append(total)
        flush()
        return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def text_batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of a bounded number of bytes, and their texts."""
    sizes = np.cumsum([value or 0 for value in pc.binary_length(batch.column(column)).to_pylist()]) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + BATCH_CHARACTERS, side="right")))
        part = batch.slice(start, end - start)
        yield part, part.column(column).to_pylist()
        start = end


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids`` with the ids of each whole text. ``path`` is a file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for part, texts in text_batches(batch):
                ids, begins = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")


class Decoder:
    """Ids to bytes by a table of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.sizes, self.begins = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        place = 0
        for token, rank in ranks.items():
            self.sizes[rank], self.begins[rank] = len(token), place
            place += len(token)
        self.bytes = np.frombuffer(b"".join(ranks), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids together and how many each has."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.sizes) and (self.sizes[ids] > 0).all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.begins[ids] - ends + sizes, sizes)], sizes


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id, ids`` with the bytes that the ids stand for as ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(path)
        for batch in batches:
            begins = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(begins, begins[start] + BATCH_IDS, side="right")) - 1)
                part = batch.slice(start, end - start)
                data, sizes = table.decode(part.column("ids").flatten().to_numpy())
                places = np.concatenate([[0], np.cumsum(sizes)])[begins[start : end + 1] - begins[start]]
                decoded = pa.Array.from_buffers(pa.large_binary(), end - start, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])
                start = end

    return encoded.mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """What ids and bytes amount to: ``id, n_tokens, ids_sha256, decoded_sha256``."""
    return decoded.select("id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
