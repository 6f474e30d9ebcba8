"""Tokenizer alignment against a definition by loops, and odd rows."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortlens.llm import crosstok
from cohortlens.llm.byte_bpe import byte_letters
from cohortlens.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def by_loops(rows):
    """Documents and pair counts straight from the definition, with the tokenizers themselves."""
    a_tool, b_tool, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_tool.encode_special_tokens = True
    documents, pairs = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a = [(i, bytes(letters[c] for c in a_tool.id_to_token(i))) for i in a_tool.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in b_tool.encode(text):
                piece = b_tool.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                while a:
                    x, y = [a.pop(0)], [b.pop(0)]
                    while (n := sum(len(t) for _, t in x)) != (m := sum(len(t) for _, t in y)):
                        (x if n < m else y).append((a if n < m else b).pop(0))
                    groups.append(([i for i, _ in x], [i for i, _ in y]))
        links = [(i, j) for x, y in groups for i in x for j in y]
        pairs.update(set(links))
        documents.append((doc, groups, links))
    best = Counter()
    for (i, _), n in pairs.items():
        best[i] = max(best[i], n)
    out = []
    for doc, groups, links in documents:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), written,
                    sum(pairs[p] == best[p[0]] for p in links), sum(pairs[p] for p in links)))
    return out, sorted((i, j, n) for (i, j), n in pairs.items())


def rows():
    rng = random.Random(7)
    pool = ["the", " ", "  ", "\n", "é", "'s", "12", "!!", "漢字", "\t", "ing", "straße", "😀", "a", "tion", "of the", "<s>", "<|endoftext|>", "<0x0A>", " ", "½"]
    texts = ["", None, " ", "\n", "a▁b", "▁", "<unk></s>", "\x00", "word " * 30, "é" * 50, "a" * 300, "漢" * 40, "é", "of of"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (3, "the end"), (3, "the end")]


@pytest.mark.parametrize("limits", [{}, {"step_chars": 40, "block_chars": 200}])
def test_equals_the_definition(spark, limits):
    data = rows()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, text string, block string, n_a int").repartition(4)
    got = crosstok.align(frame, **limits)
    want, pairs = by_loops(data)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted((tuple(r[c] for c in columns) for r in got.documents.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(tuple(r) for r in got.pairs.select("a", "b", "n_docs").collect()) == pairs


def test_wide_groups(monkeypatch):
    """Groups above the limit count equal ids first and give the same pairs."""
    with open(A, "rb") as a, open(B, "rb") as b:
        tool = crosstok.Aligner(a.read(), b.read())
    texts = [t for _, t in rows()]
    first = tool.step(texts)
    monkeypatch.setattr(crosstok, "WIDE_LINKS", 1)
    second = tool.step(texts)
    for x, y in zip(first, second):
        assert all((i == j).all() for i, j in zip(x, y)) if isinstance(x, tuple) else list(x) == list(y)


def test_digest_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "the cat"), (2, "")], "doc_id long, text string")
    written = {r.doc_id: r.groups for r in crosstok.align(frame).documents.collect()}
    hashed = {r.doc_id: r.groups for r in crosstok.align(frame, digest=True).documents.collect()}
    assert hashed == {1: hashlib.sha256(written[1].encode()).hexdigest(), 2: ""}
    nothing = crosstok.align(frame.limit(0))
    assert nothing.documents.count() == 0 and nothing.pairs.count() == 0


def test_a_long_text(spark):
    line = "of the straße 12 "
    frame = spark.createDataFrame([(1, line * 20_000), (2, line)], "doc_id long, text string")
    long, short = crosstok.align(frame).documents.orderBy("doc_id").collect()
    assert long.n_groups == long.groups.count(";") + 1
    assert long.n_links == 20_000 * (short.n_links - 1) + 1  # the space at the end is a group of its own
    assert long.groups.startswith(short.groups.rsplit(";", 1)[0])
