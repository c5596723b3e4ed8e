import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import packing, pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdefgh the ing 's'll \n\n  éüñß.,!?$%▁▁ ①ﬁ日本語梦\x00\t<s></s><0x41>ABC123://=+-_(){};"


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def some_texts(seed, number, longest=60):
    chance = random.Random(seed)
    return ["".join(chance.choice(ALPHABET) for _ in range(chance.randint(0, longest))) for _ in range(number)]


def test_pieces_equal_the_library_on_random_texts(codec, library):
    for text in some_texts(1, 4000):
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_equal_the_library_on_joined_pieces(codec, library):
    chance, names = random.Random(2), list(codec.ids)
    for _ in range(3000):
        text = "".join(chance.choice(names) for _ in range(chance.randint(1, 8)))
        assert codec.encode(text) == library.encode(text)


def test_pieces_equal_the_library_on_runs(codec, library):
    for many in (1, 2, 3, 15, 16, 17, 33, 100):
        for text in (" " * many, " " * many + "x", "a" + " " * many + "b", "\n" * many, "a \n" * many, "▁" * many):
            assert codec.encode(text) == library.encode(text)
            assert codec.decode(library.encode(text)) == library.decode(library.encode(text))
    for text in ("a" * 50_000, "the" * 20_000, "é" * 10_000):
        assert codec.encode(text) == library.encode(text)


def test_pieces_equal_the_library_on_runs_of_marks(library):
    fresh = pieces.Codec(PIECES)
    for mark in ("😀", "★", "。", "█", "\u3000", "！", "…", "👩‍🚀"):
        for text in (mark * 5000, "word" + mark * 5000, f"a {mark * 5000} b{mark * 5000}\n", (mark + "x") * 3000):
            ids = library.encode(text)
            assert fresh.encode(text) == ids
            assert fresh.digest(text)[2] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    stored = [*fresh.words.new, *fresh.words.old]
    assert sum(map(len, stored)) < 1_000_000


def test_little_memory_gives_equal_results(library):
    small = pieces.Codec(PIECES)
    small.words = pieces.Memory(4)
    for text in some_texts(3, 200, 200):
        assert small.encode(text) == library.encode(text)


def test_piece_digests_of_odd_documents(odd_documents, no_documents, library):
    given = Counter()
    for row in odd_documents.select("doc_id", "text").collect():
        ids = library.encode(row["text"] or "")
        given[
            row["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(),
        ] += 1
    assert Counter(map(tuple, pieces.digests(odd_documents, PIECES).collect())) == given
    assert pieces.digests(no_documents, PIECES).collect() == []


def test_round_trip_through_tables(odd_documents, library):
    ids = pieces.encoded(odd_documents, PIECES)
    texts = Counter((r["doc_id"], library.decode(library.encode(r["text"] or ""))) for r in odd_documents.collect())
    assert Counter(map(tuple, pieces.decoded(ids, PIECES).collect())) == texts


def test_byte_ids_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    texts = some_texts(4, 3000) + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " " * 5000, "ab" * 20_000]
    for text in texts:
        assert packing.token_ids(text, BYTES) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("white", [" ", "\n"])
def test_byte_ids_of_very_long_gaps_equal_the_library(white):
    library, gap = Tokenizer.from_file(BYTES), white * 2_000_000
    for text in (f"one{gap}two", f"{gap}<|endoftext|>x\u3000{white}"):
        assert packing.token_ids(text, BYTES) == library.encode(text, add_special_tokens=False).ids


def test_byte_ids_around_the_length_of_a_long_run_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    for many in range(packing.LONG_RUN - 2, packing.LONG_RUN + 3):
        for text in (" " * many, "a" + " " * many + "b", "\n" * many + "<|endoftext|>"):
            assert packing.token_ids(text, BYTES) == library.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


def best_possible(sizes, capacity):
    """The fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)

    def fits(bins):
        loads = [0] * bins

        def place(at):
            if at == len(sizes):
                return True
            tried = set()
            for b in range(bins):
                if loads[b] not in tried and loads[b] + sizes[at] <= capacity:
                    tried.add(loads[b])
                    loads[b] += sizes[at]
                    if place(at + 1):
                        return True
                    loads[b] -= sizes[at]
            return False

        return place(0)

    bins = -(-sum(sizes) // capacity)
    while not fits(bins):
        bins += 1
    return bins


def test_plans_use_up_the_histogram_and_are_near_the_best():
    chance = random.Random(5)
    for _ in range(60):
        sizes = [chance.randint(1, 20) for _ in range(chance.randint(1, 14))]
        counts = np.bincount(sizes, minlength=21)
        plan = packing.plan(counts, 20)
        used = Counter()
        for configuration, times in plan.runs:
            assert sum(length * many for length, many in configuration.items()) <= 20
            for length, many in configuration.items():
                used[length] += many * times
        assert used == Counter(sizes)
        assert plan.sequences <= best_possible(sizes, 20) + 1


def test_large_plan_is_within_a_thousandth_of_the_bound():
    chance = np.random.default_rng(6)
    counts = np.bincount(np.minimum(1024, chance.lognormal(5.5, 1.2, 400_000).astype(int) + 1), minlength=1025)
    plan = packing.plan(counts, 1024)
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert plan.sequences <= 1.002 * bound


def test_pricing_is_a_knapsack():
    chance = random.Random(7)
    for _ in range(50):
        lengths = np.array(sorted(chance.sample(range(1, 30), 6), reverse=True))
        prices = np.array([chance.random() for _ in lengths])
        choice = packing.dearest(lengths, prices, 40)
        best = [0.0] * 41
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - n] + p for n, p in zip(lengths, prices) if n <= room)])
        room, total = 40, 0.0
        while choice[room] >= 0:
            total += prices[choice[room]]
            room -= lengths[choice[room]]
        assert total == pytest.approx(best[40])


def test_packed_odd_documents(odd_documents, no_documents):
    rows = packing.packed(odd_documents, BYTES, 64).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for row in rows:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
        by_document[row["doc_id"]].append(row)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    library = Tokenizer.from_file(BYTES)
    wanted, got = Counter(), Counter()
    for row in odd_documents.select("doc_id", "text").collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        for at, (start, length) in enumerate(packing.cut(len(ids), 64)):
            crc = crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            wanted[row["doc_id"], at, start, length, crc] += 1
    for row in rows:
        got[tuple(row)[:5]] += 1
    assert got == wanted
    assert packing.packed(no_documents, BYTES).collect() == []
