"""Suffix arrays of small groups of byte strings by two-stage sorting, and their repeated windows.

Symbols are bytes; the end of a string sorts before every byte. Only suffixes that are smaller than
their successors are compared directly, by their first ``length`` bytes. All others follow: the
buckets of first symbols are scanned in order, and each suffix found puts the one before it at the
end of the placed part of that suffix's bucket. The order is exact as far as ``length`` bytes.
"""

from __future__ import annotations

import numpy as np


def _layout(strings: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The strings with one end mark each, their symbols (0: end) and where the string of each place ends."""
    joined = b"\0".join(strings) + b"\0"
    ends = np.cumsum([len(string) + 1 for string in strings]) - 1
    symbols = np.frombuffer(joined, dtype=np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    return joined, symbols, np.repeat(ends, np.diff(ends, prepend=-1))


def suffix_array(strings: list[bytes], length: int) -> np.ndarray:
    """All places of the joined strings (each followed by an end mark) in the order of their suffixes."""
    joined, symbols, end_of = _layout(strings)
    n = len(symbols)
    step = np.sign(np.diff(symbols, append=0))
    deciding = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    smaller = np.append(step, 1)[deciding] > 0
    smaller[symbols == 0] = True

    direct = np.flatnonzero(smaller & (symbols > 0))
    prefixes = [joined[place:end] for place, end in zip(direct.tolist(), np.minimum(direct + length, end_of[direct]).tolist())]
    direct = direct[sorted(range(len(prefixes)), key=prefixes.__getitem__)]
    first = symbols[direct]
    bounds = np.searchsorted(first, np.arange(258))
    placed: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for symbol in range(257):
        induced = placed[symbol]
        ready = np.concatenate(induced) if induced else np.empty(0, dtype=np.int64)
        while len(ready):
            before = ready[ready > 0] - 1
            ready = before[symbols[before] == symbol]
            induced.append(ready)
        own = np.flatnonzero(symbols == 0) if symbol == 0 else direct[bounds[symbol] : bounds[symbol + 1]]
        bucket = np.concatenate([*induced, own])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        target = symbols[before]
        before, target = before[target > symbol], target[target > symbol]
        if len(before):
            turn = np.argsort(target, kind="stable")
            before, target = before[turn], target[turn]
            cuts = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1).tolist(), len(target)]
            for begin, end in zip(cuts, cuts[1:]):
                placed[target[begin]].append(before[begin:end])
    return np.concatenate(order)


def common_prefixes(joined: bytes, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each pair of places agree."""
    text = np.frombuffer(joined + b"\0" * 8, dtype=np.uint8)
    words = np.zeros(len(joined) + 1, dtype=np.uint64)
    for shift in range(8):
        words |= text[shift : shift + len(words)].astype(np.uint64) << np.uint64(8 * shift)
    agree = np.arange(len(left))
    for offset in [*range(0, length - 8, 8), max(0, length - 8)] if length >= 8 else []:
        agree = agree[words[left[agree] + offset] == words[right[agree] + offset]]
    for offset in range(length) if length < 8 else []:
        agree = agree[text[left[agree] + offset] == text[right[agree] + offset]]
    result = np.zeros(len(left), dtype=bool)
    result[agree] = True
    return result


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, which of its windows of ``length`` bytes start in more than one place of all strings."""
    joined, _, end_of = _layout(strings)
    order = suffix_array(strings, length)
    whole = end_of[order] - order >= length
    neighbours = np.flatnonzero(whole[:-1] & whole[1:])
    same = neighbours[common_prefixes(joined, order[neighbours], order[neighbours + 1], length)]
    repeated = np.zeros(len(joined), dtype=bool)
    repeated[order[same]] = repeated[order[same + 1]] = True
    starts = np.cumsum([0, *(len(string) + 1 for string in strings)])
    return [repeated[start : start + max(0, len(string) - length + 1)] for start, string in zip(starts.tolist(), strings)]
