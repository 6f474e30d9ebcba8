"""Context-tree weighting against a recursive model over all nodes, the base against counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import ctw


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def _line(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return b" ".join(words) + (b" \n" if words else b"\n")


def _steps(line, depth):
    for i, byte in enumerate(line):
        context = bytes(line[j] if j >= 0 else 0 for j in range(i - 1, i - 1 - depth, -1))
        node = 1
        for level in range(7, -1, -1):
            yield context, node, byte >> level & 1
            node = node * 2 + (byte >> level & 1)


class Plain:
    """Counts per (context, node); weights and predictions by recursion."""

    def __init__(self, lines, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for line in lines:
            for context, node, bit in _steps(line, depth):
                for d in range(depth + 1):
                    self.counts[context[:d], node][bit] += 1
                    if d:
                        self.children[context[:d - 1], node].add(context[:d])
        self.memo = {}

    def kt(self, context, node):
        a, b = self.counts[context, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weight(self, context, node):
        """Log of own estimate and of the weighted probability."""
        key = context, node
        if key not in self.memo:
            own = self.kt(context, node)
            if len(context) == self.depth:
                self.memo[key] = own, own
            else:
                below = sum(self.weight(c, node)[1] for c in self.children[key])
                self.memo[key] = own, np.logaddexp(own, below) - math.log(2)
        return self.memo[key]

    def predict(self, context, node, bit, d=0):
        key = context[:d], node
        if key not in self.counts:
            return 0.5
        a = self.counts[key]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == self.depth:
            return own
        kt, mixed = self.weight(*key)
        share = math.exp(kt - math.log(2) - mixed)
        return share * own + (1 - share) * self.predict(context, node, bit, d + 1)

    def score(self, line):
        return sum(math.log10(self.predict(c, n, b)) for c, n, b in _steps(line, self.depth))


def _rows(n=60):
    rng = random.Random(6)
    words = ["the", "of", "Then", "é", "another", "zebra", "x1", "***"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return rows + [(1000, None), (1001, " \t\n"), (None, "the unknown of"), (5, "again " * 40), (1002, "\x00 null")]


@pytest.mark.parametrize("depth", [2, 5])
def test_scores_by_recursion(spark, depth):
    rows = _rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    out = ctw.scores(frame, depth=depth, block_bytes=400).collect()
    assert len(out) == len(rows)
    model = Plain([_line(t) for i, t in rows if not _held(i)], depth)
    tokens = {t: _line(t).split() + [b"\n"] for _, t in rows}
    counts = Counter(w for i, t in rows if not _held(i) for w in tokens[t])
    n, v = sum(counts.values()), len(counts)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    for r in out:
        want = [(model.score(_line(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[t]),
                 len(tokens[t]), sum(w in counts for w in tokens[t])) for t in text[r.doc_id]]
        assert r.train_tokens == n and r.held_out == _held(r.doc_id)
        assert any(r.score == pytest.approx(s, rel=1e-5) and r.base_score == pytest.approx(b, rel=1e-9)
                   and (r.n_tokens, r.n_known) == (k, m) for s, b, k, m in want)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = ctw.Spelled([bytes(rng.integers(97, 101, 3000, dtype=np.uint8))])
    keys = np.concatenate([k for _, _, k in text.keys(3)])
    keys, counts = np.unique(keys, return_counts=True)
    levels, top = ctw.tree(keys, counts, 3)
    levels |= ctw.crown(*top)
    for context in (int(keys[5]) >> 8 << 8, 0x7A7A7A00):
        p = 10 ** ctw.log_probabilities(np.arange(256) + context, levels, 3)
        assert p.sum() == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(50) if _held(i))
    out = ctw.scores(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0)]
    assert out[0].score == pytest.approx(6 * 8 * math.log10(0.5))
    assert ctw.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
