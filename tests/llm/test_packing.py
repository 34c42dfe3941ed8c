import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tracewright.llm import packing
from tracewright.llm.queries import tokenizer


def optimal(sizes, capacity):
    """Fewest bins, by exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best if sizes else 0


@pytest.mark.parametrize("seed", range(30))
def test_small_blocks_are_packed_optimally(seed):
    r = random.Random(seed)
    sizes = np.array([r.randint(3, 25) for _ in range(r.randint(1, 9))])
    sequence, offset = packing.pack_block(sizes, 30)
    for s in set(sequence.tolist()):
        own = sorted(zip(offset[sequence == s], sizes[sequence == s]))
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= 30
    assert len(set(sequence.tolist())) == optimal(sizes.tolist(), 30)


def test_completion_beats_best_fit():
    # best fit decreasing takes 4 sequences, three are enough
    counts = {60: 1, 50: 1, 30: 2, 20: 3, 40: 1}
    best = packing.bin_completion(counts, 90)
    assert sorted(x for b in best for x in b) == sorted(k for k, n in counts.items() for _ in range(n))
    assert len(best) == optimal([k for k, n in counts.items() for _ in range(n)], 90)


def test_large_block_is_near_the_bound():
    r = np.random.Generator(np.random.PCG64(1))
    sizes = r.integers(1, 1024, 20000)
    sequence, _ = packing.pack_block(sizes, 1024)
    used = len(np.unique(sequence))
    assert np.bincount(sequence, sizes).max() <= 1024
    assert used <= -(-sizes.sum() // 1024) * 1.01 + 1


def test_both_tokenizer_paths_agree():
    files = tokenizer()
    fast, plain = packing.load_tokenizer(**files), packing.load_tokenizer(files["path"], files["pattern"])
    r = random.Random(4)
    alphabet = ["a", "The", " ", "  ", "\n", "\t", "é", "日本", "12", "345", "!", "'s", "'LL", "<|endoftext|>", " ", "​", "🙂", "\r\n", "_", "\x00", "́", "x" * 50]
    texts = ["", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400))]
    assert fast(texts) == plain(texts)


def test_pieces_and_sequences(spark):
    texts = [None, "", "hello world", "hello world", "word " * 700, "éà " * 3000, "x"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "null id", "", 0), (2, "hello world", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")
    files = tokenizer()
    got = packing.assign(packing.pieces(df, files, 64), 64).collect()
    plain = packing.load_tokenizer(files["path"], files["pattern"])
    want = []
    for doc_id, text, *_ in rows:
        ids = [*plain([text or ""])[0], 2]
        first = len(ids) % 64 if len(ids) > 64 else 0
        starts = [0, *range(first, len(ids), 64)] if first else list(range(0, len(ids), 64))
        for k, start in enumerate(starts):
            own = ids[start : (starts + [len(ids)])[k + 1]]
            want.append((doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.assign(packing.pieces(df, tokenizer(), 64), 64).collect() == []


def test_a_filling_may_have_any_number_of_pieces():
    assert next(packing.fillings([(1, 2000)], 1023)) == (1,) * 1023
    assert set(packing.fillings([(5, 1), (3, 2), (1, 1)], 7)) == {(5, 1), (3, 3, 1)}


@pytest.mark.parametrize("seed", range(10))
def test_fillings_and_dominance_against_all_subsets(seed):
    r = random.Random(seed)
    sizes = [r.randint(2, 20) for _ in range(9)]
    room = r.randint(20, 40)
    fit = {tuple(sorted(c, reverse=True)) for n in range(10) for c in combinations(sizes, n) if sum(c) <= room}

    def full(c):
        rest = Counter(sizes) - Counter(c)
        return not any(sum(c) + x <= room for x in rest)

    got = list(packing.fillings(sorted(Counter(sizes).items(), reverse=True), room))
    assert len(got) == len(set(got)) and set(got) == {c for c in fit if full(c)}
    assert packing.dominates((9, 4), (5, 4, 4)) and not packing.dominates((8, 5), (9, 4)) and not packing.dominates((7, 7), (5, 5, 4))


def test_blocks_of_8_to_13_pieces_are_packed_optimally():
    r = random.Random(7)
    missed = 0
    for _ in range(1000):
        sizes = [r.randint(10, 60) for _ in range(r.randint(8, 13))]
        missed += len(packing.bin_completion(dict(Counter(sizes)), 100)) != optimal(sizes, 100)
    assert missed == 0


def test_ids_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "plain", ""]
    plain = Tokenizer.from_file(tokenizer()["path"])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.load_tokenizer(**tokenizer())(texts) == want and want[0] == [64, 220, 50256, 275]
