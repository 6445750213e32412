"""Greedy word-piece lengths by a linear longest-match automaton.

A word is cut from the left into the longest known pieces, the first from those that begin a word and
the others from those that go on. The automaton is a trie of both kinds under two roots. Where a word
leaves the trie, a node's failure link leads to the node of what is still unmatched, past the pieces
that are certain by then; their number is stored with the link. So each character is read once and
no piece is built. A word that cannot be cut is one unknown piece.

Words are runs of anything but white space. Null, empty and blank texts have no words. Repeated rows
are counted each, null ids stay null, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the mark of a word's beginning in piece vocabularies.
WORD_START = "▁"
KNOWN_WORDS, LONGEST_KNOWN = 200_000, 64
_WIDTH = 0x110000


class Automaton:
    def __init__(self, starts: set[str], others: set[str]) -> None:
        self.children: dict[int, int] = {}
        self.known: dict[str, int] = {}
        # Node 0 is the root of words, node 1 the root of continuations.
        final, spelt = [False, False], [[], []]
        for root, pieces in ((0, starts), (1, others)):
            for piece in pieces:
                node = root
                for character in piece:
                    key = node * _WIDTH + ord(character)
                    if key not in self.children:
                        self.children[key] = len(final)
                        final.append(False)
                        spelt.append([])
                        spelt[node].append((ord(character), self.children[key]))
                    node = self.children[key]
                final[node] = node > 1
        self.failure, self.popped = [-1] * len(final), [0] * len(final)
        waiting = deque([0, 1])
        while waiting:
            node = waiting.popleft()
            for character, child in spelt[node]:
                waiting.append(child)
                if final[child]:
                    self.failure[child], self.popped[child] = 1, 1
                    continue
                back, count = self.failure[node], self.popped[node]
                while back >= 0 and (back * _WIDTH + character) not in self.children:
                    count += self.popped[back]
                    back = self.failure[back]
                if back >= 0:
                    self.failure[child], self.popped[child] = self.children[back * _WIDTH + character], count

    def pieces(self, word: str) -> int:
        """The number of pieces of a non-empty word; 0 if it cannot be cut."""
        children, failure, popped = self.children, self.failure, self.popped
        node = count = 0
        for character in map(ord, word):
            while (following := children.get(node * _WIDTH + character)) is None:
                count += popped[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = following
        while node != 1:
            count += popped[node]
            node = failure[node]
            if node < 0:
                return 0
        return count

    def lengths(self, words: list[str]) -> list[int]:
        """``pieces`` of each word, through a bounded table of those met before."""
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        long = {}
        for word in set(words):
            if len(word) > LONGEST_KNOWN:
                long[word] = self.pieces(word)
            elif word not in known:
                known[word] = self.pieces(word)
        return [long[word] if len(word) > LONGEST_KNOWN else known[word] for word in words] if long else list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Pieces of a vocabulary file: those marked as beginning a word and all others."""
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [vocabulary.id_to_piece(place) for place in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(place) or vocabulary.is_unknown(place) or vocabulary.is_byte(place))]
    starts = {piece[len(WORD_START) :] for piece in pieces if piece.startswith(WORD_START)} - {""}
    return Automaton(starts, {piece for piece in pieces if WORD_START not in piece})


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, n_tokens, n_unknown`` per text; an unknown word is one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                lengths = Counter(machine.lengths((value.as_py() or "").split()))
                unknown = lengths[0]
                rows.append((sum(lengths.values()), sum(size * times for size, times in lengths.items()) + unknown, unknown))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([row[place] for row in rows], type=pa.int64()) for place in range(3)]], names=["id", "n_words", "n_tokens", "n_unknown"])

    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
