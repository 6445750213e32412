"""Encoding, packing and word-piece counts against public libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from conftest_llm import documents
from tokenizers import Tokenizer

from profilum.llm import bpe, packing, token_counts
from profilum.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("tests", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def wild():
    random.seed(1)
    return [
        "", "   ", "\n\n a", "a" * 5000, "ab" * 20_000, " " * 3000, "日本語テキスト🙂🙂" * 300, "'s't're 12345678 ½²", "<|endoftext|> x", None,
        "".join(random.choice("ab ") for _ in range(10_000)), "".join(random.choice("aé一🙂 \n0'.") for _ in range(10_000)),
    ]


def test_encoder_equals_library(library):
    texts = wild() + [text for _, text in documents("sf0.001")]
    coder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for _ in range(2):
        ids, begins = coder.encode(texts)
        for place, text in enumerate(texts):
            assert ids[begins[place] : begins[place + 1]].tolist() == library.encode_ordinary(text or "")


@pytest.mark.parametrize("limit", [0, 50])
def test_encoder_with_small_tables(library, limit, monkeypatch):
    """Texts beyond the batch limits, and a table of known pre-tokens that is emptied again and again."""
    monkeypatch.setattr(bpe, "KNOWN_PIECES", limit)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    texts = wild()
    ids, begins = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).encode(texts)
    assert [ids[low:high].tolist() for low, high in zip(begins, begins[1:])] == [library.encode_ordinary(text or "") for text in texts]


def test_any_rank_file():
    """Random ranks, where a merge can make an earlier pair possible, against one merge at a time."""
    random.seed(6)
    for _ in range(150):
        tokens = {bytes([byte]) for byte in range(256)} | {bytes(random.choice(b"abc") for _ in range(random.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens, key=lambda token: (len(token) > 1, random.random()))
        ranks = {token: rank for rank, token in enumerate(order)}
        merges = bpe.Merges(ranks)
        pieces = [bytes(random.choice(b"abc") for _ in range(random.randint(1, 30))) for _ in range(8)]
        ids, begins = merges.merge(pieces)
        for place, piece in enumerate(pieces):
            parts = [bytes([byte]) for byte in piece]
            while True:
                options = [(ranks[left + right], spot) for spot, (left, right) in enumerate(zip(parts, parts[1:])) if left + right in ranks]
                if not options:
                    break
                spot = min(options)[1]
                parts[spot : spot + 2] = [parts[spot] + parts[spot + 1]]
            assert ids[begins[place] : begins[place + 1]].tolist() == [ranks[part] for part in parts]


def test_bitmap_finds_the_first_rank():
    random.seed(2)
    queue, held = bpe.RankQueue(300_000), set()
    for _ in range(2000):
        if held and random.random() < 0.5:
            first = queue.first()
            assert first == min(held)
            queue.take(first)
            held.remove(first)
        else:
            rank = random.randrange(300_000)
            queue.push(rank, np.array([1]))
            held.add(rank)


def test_bpe_query(spark, library):
    found = {row.doc_id: row for row in QUERIES["op10_bpe"](spark, FOLDER).collect()}
    rows = documents("sf0.001")
    assert len(found) == len(rows)
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        own = found[key]
        assert (own.n_tokens, own.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert own.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_awkward_rows(awkward, empty, library):
    def run(frame):
        return bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS).collect()

    expected = [(row.doc_id, library.encode_ordinary(row.text or ""), (row.text or "").encode()) for row in awkward.collect()]
    assert sorted([(row.id, list(row.ids), bytes(row.decoded)) for row in run(awkward)], key=repr) == sorted(expected, key=repr)
    assert run(empty) == []


def test_unknown_ids_do_not_decode():
    with pytest.raises(ValueError):
        bpe.Decoder({b"a": 0, b"b": 2}).decode(np.array([0, 1]))


def check_packing(rows, pieces, tokenizer):
    ids = {}
    for key, text in rows:
        ids.setdefault(key, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4"))
    assert sum(piece.length for piece in pieces) == sum(len(own) for copies in ids.values() for own in copies)
    covered = {}
    for piece in pieces:
        checks = [zlib.crc32(own[piece.start : piece.start + piece.length].tobytes()) for own in ids[piece.id] if len(own) == piece.doc_tokens]
        assert piece.ids_crc32 in checks
        covered.setdefault((piece.id, piece.doc_tokens), []).append((piece.start, piece.length))
    for (key, total), parts in covered.items():
        copies = sum(len(own) == total for own in ids[key])
        assert sorted(place for start, length in parts for place in range(start, start + length)) == sorted([*range(total)] * copies)
    sequences = {}
    for piece in pieces:
        sequences.setdefault(piece.sequence_id, []).append((piece.offset, piece.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= packing.CAPACITY
    return sequences


def test_packing_query(spark, tokenizer):
    pieces = QUERIES["op8_packing"](spark, FOLDER).withColumnRenamed("doc_id", "id").collect()
    sequences = check_packing(documents("sf0.001"), pieces, tokenizer)
    filled = sum(length for parts in sequences.values() for _, length in parts)
    assert filled > 0.97 * packing.CAPACITY * len(sequences)


def test_packing_awkward_rows(awkward, empty, tokenizer):
    def run(frame):
        return packing.pack(packing.cut(frame, VOCABULARY, public_tokenizers.PATTERN)).collect()

    check_packing([(row.doc_id, row.text) for row in awkward.collect()], run(awkward), tokenizer)
    assert run(empty) == []


def test_groups_are_packed_apart(awkward, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    pieces = packing.pack(packing.cut(awkward, VOCABULARY, public_tokenizers.PATTERN, with_ids=True)).collect()
    check_packing([(row.doc_id, row.text) for row in awkward.collect()], pieces, tokenizer)
    assert all(zlib.crc32(np.array(piece.ids, dtype="<u4").tobytes()) == piece.ids_crc32 for piece in pieces)


def test_lowest_cost_with_room_is_chosen():
    chosen, offsets = packing.assign(np.array([6, 5, 4, 3, 2]), capacity=10)
    assert chosen.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 5, 6, 0]
    random.seed(9)
    lengths = np.array(sorted((random.randint(1, 2047) for _ in range(400)), reverse=True))
    chosen, offsets = packing.assign(lengths)
    costs, room = {}, {}
    for length, sequence, offset in zip(lengths.tolist(), chosen.tolist(), offsets.tolist()):
        options = [costs[other] for other in room if room[other] >= length]
        assert room.setdefault(sequence, 2048) == 2048 - offset >= length
        assert costs.setdefault(sequence, 0.0) <= min(options, default=np.inf) + 1e-9
        room[sequence] -= length
        costs[sequence] += float(packing.cost(np.array([length]))[0])


def test_very_long_white_space():
    ids = packing.token_ids(" " * 1_500_000, VOCABULARY, public_tokenizers.PATTERN)
    table = bpe.Decoder(bpe.read_ranks(RANKS))
    assert bytes(table.decode(ids.astype(np.int64))[0]) == b" " * 1_500_000


def test_added_tokens_are_one_id(spark, make):
    """The ids of a tokenizer left as it is loaded from its file."""
    loaded = Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [*wild(), end, end * 3, f"a{end}b", f"a  {end}  b\n {end}", f"<|endoftext{end}|>", "<|endoftext |>", f"one {end} two " * 2000, end.upper()]
    for text in texts:
        assert packing.token_ids(text, VOCABULARY, public_tokenizers.PATTERN).tolist() == loaded.encode(text or "", add_special_tokens=False).ids
    assert packing.token_ids(f"a{end}b", VOCABULARY, public_tokenizers.PATTERN).tolist()[1] == 50256
    rows = list(enumerate(texts))
    pieces = packing.pack(packing.cut(make(rows, "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN)).collect()
    check_packing(rows, pieces, loaded)


def greedy(word, starts, others):
    count = place = 0
    while place < len(word):
        known = others if place else starts
        end = next((end for end in range(len(word), place, -1) if word[place:end] in known), None)
        if end is None:
            return 0
        count, place = count + 1, end
    return count


def test_automaton_equals_greedy_cutting():
    random.seed(2)
    for _ in range(2000):
        starts, others = ({"".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(random.randint(0, 6))} for _ in range(2))
        machine = token_counts.Automaton(starts, others)
        for _ in range(20):
            word = "".join(random.choice("abc") for _ in range(random.randint(1, 9)))
            assert machine.pieces(word) == greedy(word, starts, others)


def test_token_counts(spark, awkward, empty):
    machine = token_counts.automaton(PIECES)
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {vocabulary.id_to_piece(place) for place in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(place) or vocabulary.is_unknown(place) or vocabulary.is_byte(place))}
    starts, others = {piece[1:] for piece in pieces if piece[0] == "▁"} - {""}, {piece for piece in pieces if "▁" not in piece}
    assert machine.pieces("the") == greedy("the", starts, others)
    for frame in (awkward, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        expected = []
        for row in frame.select("doc_id", "text").collect():
            sizes = [greedy(word, starts, others) if len(word) < 500 else machine.pieces(word) for word in (row.text or "").split()]
            expected.append((row.doc_id, len(sizes), sum(size or 1 for size in sizes), sizes.count(0)))
        assert sorted(map(tuple, token_counts.count_tokens(frame, PIECES).collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert QUERIES["op1_token_counts"](spark, FOLDER).columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
