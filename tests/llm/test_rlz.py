"""Substring deduplication against counting every window."""

import hashlib
import random
from collections import Counter

from cohortlens.llm import rlz


def _plain(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _check(spark, rows, window=35, **options):
    frame = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, block string").repartition(4)
    out = rlz.duplicate_spans(frame, window, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == _plain(rows, window)
    _check_factors(out, rows, window)
    return out


def _check_factors(out, rows, window):
    """Every factor stands at its reference too, which is another place; together they hold the removed words."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    places, words_of = {}, []
    for r in sorted(out, key=lambda r: (r.block, r.first_word)):
        # rows of one id are told apart by what they keep
        words = next(w for w in texts[r.doc_id] if len(w) == r.n_words and _same(w, r))
        places.setdefault(r.block, {}).update({r.first_word + k: w for k, w in enumerate(words)})
        words_of.append((r, words))
    for r, words in words_of:
        covered, before = set(), -1
        for f in r.factors:
            assert f.words >= window and f.first > before
            here = words[f.first:f.first + f.words]
            assert len(here) == f.words
            assert [places[f.ref_block].get(f.ref_word + k) for k in range(f.words)] == here
            assert (f.ref_block, f.ref_word) != (r.block, r.first_word + f.first)
            covered.update(range(f.first, f.first + f.words))
            before = f.first
        assert len(covered) == r.n_removed


def _same(words, row):
    gone = {k for f in row.factors for k in range(f.first, f.first + f.words)}
    return hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest() == row.kept_sha256


def _rows(seed, vocabulary, passages, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(rng.randint(window - 5, window * 2))] for _ in range(passages)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 2 * window))]
            if rng.random() < 0.5:
                p = rng.choice(shared)
                at = rng.randint(0, 6)
                text += p[at:len(p) - rng.randint(0, 6)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


def test_shared_passages(spark):
    _check(spark, _rows(1, 4000, 12, 35))


def test_small_vocabulary_and_small_blocks(spark):
    _check(spark, _rows(2, 3, 5, 8), window=8, seed_words=4, block_bytes=300)


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, None), (2, ""), (3, "a " * 200), (4, "short one"), (5, "ü " + text[:200]), (None, text + " end"),
            (6, "\x1c  word apart " * 30)]
    out = _check(spark, rows)
    assert all(r.kept_text is None or r.n_removed for r in out)
    assert rlz.duplicate_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    _check(spark, [(1, None), (2, "")])


def test_factors_join_neighbouring_starts():
    import numpy as np

    assert rlz.factors(np.array([3, 4, 5, 50]), 35) == [(3, 37), (50, 35)]
    assert rlz.factors(np.array([], int), 35) == []


def test_references_are_neighbours_and_factors_long(spark):
    """A passage that all documents hold is one factor each, and no place is the reference of all."""
    passage = " ".join(f"p{i}" for i in range(400))
    rows = [(i, f"{' '.join(f'd{i}x{k}' for k in range(50))} {passage} end{i}") for i in range(60)]
    out = _check(spark, rows, block_bytes=6000)
    assert all([(f.first, f.words) for f in r.factors] == [(50, 400)] for r in out)
    used = Counter((r.factors[0].ref_block, r.factors[0].ref_word) for r in out)
    assert len({r.block for r in out}) > 10 and max(used.values()) <= 3


def test_a_factor_ends_where_its_reference_ends(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words[:150])), (2, " ".join(words[100:300])), (3, " ".join(words))]
    out = {r.doc_id: r for r in _check(spark, rows)}
    assert len(out[3].factors) >= 2 and out[3].n_removed == 300


def test_repeats_within_a_text_and_beyond_a_block(spark):
    """A period refers to the one before it, as one factor; a text longer than a block is parsed whole."""
    out = _check(spark, [(1, "a b c " * 3000), (2, "x " * 40)], block_bytes=2000)
    long = next(r for r in out if r.doc_id == 1)
    assert len(long.factors) <= 4 and long.n_removed == 9000


def test_parse():
    import numpy as np

    starts = np.array([3, 4, 5, 6, 50])
    assert rlz.parsed(starts, np.array([1, 1, 2, 2, 2]), np.array([10, 11, 7, 8, 9]), 35) == [(3, 36, 1, 10), (5, 36, 2, 7), (50, 35, 2, 9)]
