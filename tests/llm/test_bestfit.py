"""Best-fit packing: ids, whole pieces, exact complements, few sequences, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import bestfit
from cohortlens.llm.byte_bpe import ByteBpe
from cohortlens.llm.common import tokenizer_path
from cohortlens.llm.windows import Places

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return ByteBpe(f.read())


def test_ids_equal_the_tokenizer(tokenizer, vocabulary):
    rng = random.Random(1)
    texts = ["", " ", "a<|endoftext|><|endoftext|> b", "<|endoftext|>", "don't  stop\n\n", "\x00\x1c\x85 ", "日本 語 ½ ²", "a" + " " * 25_000 + "b",
             "x" + "\n " * 9_000, " " * 12_000, "é" + "　" * 11_000 + "<|endoftext|>" + "\t" * 20_000 + "z", "ab" * 30_000]
    pool = ["the", " ", "  ", "\n", "é", "'s", "'ll", "12", "!!", "漢字", " ", "​", "😀", "ing", "<|endoftext|>", "a", "_"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        assert vocabulary.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]
    tokenizer.encode_special_tokens = True
    for text in texts:
        plain = vocabulary.ids(text, plain=True)
        assert plain == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]
        assert b"".join(vocabulary.token_bytes[i] for i in plain) == text.encode()
    tokenizer.encode_special_tokens = False


def sequences(h, window):
    """Pieces of each sequence as (offset, length), placed one by one."""
    places, used = Places(bestfit.plan(h, window)), defaultdict(list)
    for length in np.flatnonzero(h):
        row, k = places.find(np.full(h[length], length), np.arange(h[length]))
        for r, i in zip(row, k):
            used[int(r[3] + i // r[2])].append((int(r[4] + i % r[2] * length), int(length)))
    return used


def checked(h, window):
    used = sequences(h, window)
    assert sum(map(len, used.values())) == h.sum()
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(used)


def best_fit_decreasing(h, window):
    rooms, n = np.zeros(window + 1, np.int64), 0
    for length in range(window, 0, -1):
        for _ in range(h[length]):
            fits = np.flatnonzero(rooms[length:])
            room = fits[0] + length if len(fits) else window
            n += not len(fits)
            rooms[room] -= len(fits) > 0
            rooms[room - length] += 1
    return n


def fewest(lengths, window):
    """The least number of sequences, by trying every placement."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        go(i + 1, rooms + [window - lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("histogram", [
    {}, {5: 1}, {64: 3}, {1: 500}, {32: 7, 30: 9}, {20: 40, 24: 39, 44: 11, 40: 35}, {33: 50, 31: 20, 16: 10, 15: 11}])
def test_places_every_piece_once(histogram):
    h = np.zeros(65, np.int64)
    for length, n in histogram.items():
        h[length] = n
    assert checked(h, 64) <= best_fit_decreasing(h, 64)


def test_small_cases_against_all_placements():
    rng = random.Random(5)
    extra = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        extra += checked(np.bincount(lengths, minlength=21), 20) - fewest(lengths, 20)
    assert extra <= 3


@pytest.mark.parametrize("hot", [0, 300, 777, 1025])
def test_few_sequences(hot):
    """As few as best-fit decreasing piece by piece, also when one length has half of all pieces."""
    h = np.bincount(np.random.default_rng(2).integers(1, 2049, 3000), minlength=2049)
    h[hot] += 3000 if hot else 0
    assert checked(h, 2048) <= best_fit_decreasing(h, 2048)


def test_index_finds_every_exact_filling():
    rng = np.random.default_rng(4)
    for _ in range(200):
        left = np.bincount(rng.integers(1, 30, 6), minlength=41)
        have, gap = np.repeat(np.arange(41), left).tolist(), int(rng.integers(1, 40))
        index = bestfit.Sums(left)
        for most in range(4):
            found = index.filling(gap, [], most)
            exists = any(sum(have[i] for i in range(len(have)) if m >> i & 1) == gap for m in range(1, 64) if bin(m).count("1") <= most)
            assert (found is not None) == exists
            if found:
                assert sum(found) == gap and (np.bincount(found, minlength=41) <= left).all() and len(found) <= most


def test_rows(spark, tokenizer):
    text = "many words of text " * 1500
    rows = [(1, text), (2, None), (3, ""), (None, "a b"), (1, text), (4, "one"), (5, "x<|endoftext|>y"), *[(i, "same length") for i in range(10, 60)]]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, part int, length string").repartition(5)
    out = bestfit.packed(frame).collect()
    want = []
    for doc, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) - 2048 * ((len(ids) - 1) // 2048)
        for i, s in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[s:first if i == 0 else s + 2048]
            want.append((doc, i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert bestfit.packed(frame.limit(0)).count() == 0
