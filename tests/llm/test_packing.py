"""Packing: exact ids, gapless sequences, little padding, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import packing
from cohortlens.llm.common import tokenizer_path
from cohortlens.llm.windows import Places

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    texts = ["", " ", "Don't STOP", "auß Straße École naïve", "<|endoftext|> a", "A<|x|>", "é a b", "x​y", "日本 語", "ΣΑΣ ς",
             "\x00\x1c", "it's'll'd''s", "12ab34", "***%%%", "İstanbul ǅ", "😀😀 ok", "á́"]
    pool = [*"abcdefgß é'.,-%1 \n", "THE", "ing", "'s", "'ll", "ü", "ø", "×", "÷", "µ"]
    texts += ["«¿Qué?» – “naïve” it’s €5…™", "a\x01b", "½ ª º µ²", "x" * 30_000, "x \n" * 9_000, " " * 20_000, "fiń fi\u0301n", "a\u00a0b\u00adc", "ABC\u212a"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    got = packing.Ids(PATH).of(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def placed(h, window=2048):
    """Parts of each sequence as (offset, length), from the plan's rows, and what comes out of each piece."""
    places, used, pieces = Places(packing.plan(h, window)), defaultdict(list), 0
    for length in np.flatnonzero(h):
        row, k = places.find(np.full(h[length], length), np.arange(h[length]))
        for (_, _, per, sequence, offset), i in zip(row.tolist(), k.tolist()):
            pieces += 1
            if per:
                used[sequence + i // per].append((offset + i % per * int(length), int(length)))
                continue
            at = sequence * window + offset + i * int(length)
            first = min(int(length), window - at % window)
            used[at // window].append((at % window, first))
            if first < length:
                used[at // window + 1].append((0, int(length) - first))
    assert pieces == h.sum() and sum(n for parts in used.values() for _, n in parts) == (np.arange(len(h)) * h).sum()
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(used) == list(range(len(used)))
    return len(used)


@pytest.mark.parametrize("histogram", [
    {}, {5: 1}, {2048: 3}, {1: 5000}, {1024: 7, 1000: 9}, {700: 40, 648: 39, 1348: 11, 1400: 35, 2000: 20, 48: 30}, {1025: 60, 3: 2}])
def test_plan_places_every_piece_once(histogram):
    h = np.zeros(2049, np.int64)
    for length, n in histogram.items():
        h[length] = n
    placed(h)


@pytest.mark.parametrize("share", [0, 0.34, 0.5])
@pytest.mark.parametrize("hot", [777, 1025, 1100, 1400])
def test_padding_stays_small(hot, share):
    """Also where a third or half of all pieces share a length that nothing completes."""
    h = np.bincount(np.random.default_rng(2).integers(1, 2049, 20_000), minlength=2049)
    h[hot] += int(20_000 * share / (1 - share))
    assert placed(h) * 2048 <= (np.arange(2049) * h).sum() * 1.005


def test_repeat_counts_solve_the_histogram():
    combos = packing.combinations(np.array([500, 600, 948, 1024]), 2048)
    truth = np.arange(len(combos)) * 10.0
    h = np.zeros(2049)
    for row, n in zip(combos, truth):
        np.add.at(h, row[row > 0], n)
    x = packing.repeat_counts(combos, h, steps=2000)
    back = np.zeros(2049)
    for row, n in zip(combos, x):
        np.add.at(back, row[row > 0], n)
    assert (x >= 0).all() and np.abs(back - h).max() < 0.5


def test_rows(spark, tokenizer):
    text = "many words of text " * 1500
    rows = [(1, text), (2, None), (3, ""), (None, "a b"), (1, text), (4, "one"), *[(i, "same length") for i in range(10, 60)],
            *[(i, "ab " * 1024) for i in range(100, 120)]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    out = packing.packed(frame).collect()
    size = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in out if r.doc_id == 1) == 2 * size
    assert [(r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 2] == [(0, 1, zlib.crc32((1).to_bytes(4, "little")))]
    assert sum(r.doc_id is None for r in out) == 1
    for doc, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == doc)
        assert all(r.doc_tokens == len(ids) for r in out if r.doc_id == doc)
        assert {c for _, _, c in at} == {zlib.crc32(ids[s:s + n].tobytes()) for s, n, _ in at}
        assert sum(n for _, n, _ in at) == len(ids) * sum(d == doc for d, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(frame.limit(0)).count() == 0
