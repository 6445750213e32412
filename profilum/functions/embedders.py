"""Embedders: callables from a list of texts to a list of vectors.

A hosted model plugs in as any such callable. The default hashes words into a fixed number of
signed counts, which needs no model and gives equal texts equal vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np

Embedder = Callable[[list[str]], list[np.ndarray]]
HASHING_MODEL = "hashing-words"
# Words whose place a task keeps; rarer ones are hashed again. A word takes about 200 bytes.
REMEMBERED = 1 << 16


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Word counts hashed into ``dimension`` signed slots and scaled to length one."""
    split = re.compile(r"[ \t\r\n]+").split
    places: dict[str, tuple[int, int]] = {}

    def place(word: str) -> tuple[int, int]:
        found = places.get(word)
        if found is None:
            digest = hashlib.md5(word.encode("utf-8")).digest()
            found = int.from_bytes(digest[:4], "big") % dimension, 1 if digest[4] < 128 else -1
            if len(places) < REMEMBERED:
                places[word] = found
        return found

    def embed(texts: list[str]) -> list[np.ndarray]:
        vectors = []
        for text in texts:
            vector = np.zeros(dimension)
            for word, count in Counter(split(text.lower())).items():
                if word:
                    slot, sign = place(word)
                    vector[slot] += sign * count
            length = np.sqrt(vector @ vector)
            vectors.append(vector / length if length else vector)
        return vectors

    return embed
