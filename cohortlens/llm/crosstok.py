"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Most tokens of one vocabulary meet a token of the other with the same bytes. The identity map
A-id -> B-id is made once from the two vocabulary files, and how many documents hold such a pair is
counted in vectors as long as vocabulary A. Only the pairs of other groups become rows that are shuffled.
"""

from __future__ import annotations

import hashlib
import pathlib
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import ByteBpe
from cohortlens.llm.common import arrow, stored, tokenizer_path

STEP_CHARS = 1 << 19  # texts aligned by one set of array operations
BLOCK_CHARS = 1 << 25  # texts whose pairs are numbered together
WIDE_LINKS = 4096  # links of a group above which its ids are counted before they are paired


class Pieces:
    """A sentencepiece model and the bytes of each of its pieces."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.token_bytes = []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.token_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.token_bytes.append(b"" if m.is_control(i) or m.is_unknown(i) else piece.replace("▁", " ").encode())


def identity_map(a: list[bytes], b: list[bytes], b_bytes: set[int]) -> np.ndarray:
    """For each id of A the id of B with the same bytes, an ordinary piece before a byte piece; -1 without one."""
    same: dict[bytes, int] = {}
    for i in sorted(range(len(b)), key=lambda i: (i in b_bytes, i)):
        same.setdefault(b[i], i)
    return np.array([same.get(t, -1) if t else -1 for t in a], np.int64)


class Aligner:
    """Both vocabularies and the identity map between them."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a, self.b = ByteBpe(byte_file), Pieces(piece_file)
        m = self.b.model
        self.width = m.get_piece_size()
        self.same = identity_map(self.a.token_bytes, self.b.token_bytes, {i for i in range(self.width) if m.is_byte(i)})
        self.a_size = np.array([len(t) for t in self.a.token_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b.token_bytes], np.int64)
        self.written = [f"{i}|{j}" for i, j in enumerate(self.same.tolist())]
        self.digits = [str(i) for i in range(max(self.a.size, self.width))]

    def tokens(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Ids of both tokenizers; none where a text is null or empty or B's bytes are others. A's merges keep every byte."""
        b_ids = self.b.model.encode([t or "" for t in texts], num_threads=1)
        out, bytes_of = [], self.b.token_bytes.__getitem__
        for t, b in zip(texts, b_ids):
            text = " " + (t or "")
            if t and b"".join(map(bytes_of, b)) == text.encode():
                out.append((self.a.ids(text, plain=True), b))
            else:
                out.append(([], []))
        return out

    def step(self, texts: list[str | None]) -> tuple:
        """Alignment of some texts.

        Per text ``n_a, n_b, n_groups, n_links`` and the written groups; then (text, A id, links) of all
        distinct identity pairs and (text, pair, links) of all other distinct pairs, both by text.
        """
        tokens = self.tokens(texts)
        n_a, n_b = np.array([len(a) for a, _ in tokens]), np.array([len(b) for _, b in tokens])
        a = np.fromiter(chain.from_iterable(t[0] for t in tokens), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(t[1] for t in tokens), np.int64, n_b.sum())
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        in_a = np.bincount(np.searchsorted(ends, a_end), minlength=len(ends))
        in_b = np.bincount(np.searchsorted(ends, b_end), minlength=len(ends))
        a_at, b_at = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b
        group_text = text_of_a[a_at] if len(ends) else np.zeros(0, np.int64)
        n_groups = np.bincount(group_text, minlength=len(texts))
        n_links = np.bincount(group_text, links, minlength=len(texts)).astype(np.int64)

        regular = links == 1
        regular[regular] = self.same[a[a_at[regular]]] == b[b_at[regular]]
        pair_text, pair_a, pair_b, pair_n = self._pairs(np.flatnonzero(~regular), a, b, a_at, b_at, in_a, in_b, group_text)
        identity = self.same[pair_a] == pair_b
        same = _summed([group_text[regular], pair_text[identity]], [a[a_at[regular]], pair_a[identity]],
                       [np.ones(int(regular.sum()), np.int64), pair_n[identity]], self.a.size)
        other = _summed([pair_text[~identity]], [pair_a[~identity] * self.width + pair_b[~identity]], [pair_n[~identity]],
                        self.a.size * self.width)
        return n_a, n_b, n_groups, n_links, self._written(a, b, a_at, in_a, in_b, regular, n_groups), same, other

    def _pairs(self, groups, a, b, a_at, b_at, in_a, in_b, group_text) -> tuple:
        """Linked id pairs of some groups: (text, A id, B id, links). Wide groups count equal ids first."""
        links = in_a[groups] * in_b[groups]
        few, wide = groups[links <= WIDE_LINKS], groups[links > WIDE_LINKS]
        links = links[links <= WIDE_LINKS]
        g = np.repeat(few, links)
        k = np.arange(len(g)) - np.repeat(np.cumsum(links) - links, links)
        parts = [(group_text[g], a[a_at[g] + k // in_b[g]], b[b_at[g] + k % in_b[g]], np.ones(len(g), np.int64))]
        for g in wide.tolist():
            x, nx = np.unique(a[a_at[g]:a_at[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[b_at[g]:b_at[g] + in_b[g]], return_counts=True)
            parts.append((np.full(len(x) * len(y), group_text[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _written(self, a, b, a_at, in_a, in_b, regular, n_groups) -> list[str]:
        groups = list(map(self.written.__getitem__, a[a_at].tolist()))
        a_text, b_text = ([self.digits[i] for i in ids[np.repeat(~regular, size)].tolist()] for ids, size in ((a, in_a), (b, in_b)))
        odd, i, j = np.flatnonzero(~regular), 0, 0
        for g, n, m in zip(odd.tolist(), in_a[odd].tolist(), in_b[odd].tolist()):
            groups[g] = f"{','.join(a_text[i:i + n])}|{','.join(b_text[j:j + m])}"
            i, j = i + n, j + m
        cuts = np.r_[0, np.cumsum(n_groups)].tolist()
        return [";".join(groups[s:e]) for s, e in zip(cuts, cuts[1:])]


def _summed(texts: list, keys: list, counts: list, width: int) -> tuple:
    """Counts summed by (text, key), sorted by both."""
    key = np.concatenate(texts) * width + np.concatenate(keys)
    found, at = np.unique(key, return_inverse=True)
    return found // width, found % width, np.bincount(at, np.concatenate(counts), minlength=len(found)).astype(np.int64)


@cache
def _aligner(byte_file: bytes, piece_file: bytes) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(byte_file, piece_file)


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row per document; ``pairs``: A id, B id and the number of documents that hold them linked."""

    documents: DataFrame
    pairs: DataFrame


_FIRST = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups", pa.string()), ("same", pa.binary()), ("other", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])


def align(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None, digest: bool = False,
          text_column: str = "text", id_column: str = "doc_id", step_chars: int = STEP_CHARS, block_chars: int = BLOCK_CHARS) -> Alignment:
    """Align the tokens of a byte-level BPE (A) and a sentencepiece model (B) over space + text.

    Groups end at byte offsets where tokens of both end; all A-B occurrences of a group are linked.
    ``documents`` has ``doc_id, n_a, n_b, n_groups, n_links, groups`` (written as ``a1,a2|b1;a3|b2``, or its
    sha256 with ``digest``), ``n_best`` (links whose pair is in as many documents as any pair of its A id; ties
    count) and ``count_sum`` (over links, the documents that hold the pair). ``pairs`` has ``a, b, n_docs``.

    The vocabulary files are read once by the driver and travel with the tasks. A task aligns blocks of ``block_chars``
    characters: a frequent irregular pair is one row per block, however many documents hold it, and each
    block asks once for the counts of its pairs. What reaches the driver is two vectors as long as vocabulary A.

    A text that is null, empty or not restored by one of the tokenizers has no tokens: zeros and an empty
    string. Equal rows are documents of their own; a null id stays null. Memory grows with the longest text.
    Other columns are not read. Empty table: no rows.
    """
    spark = docs.sparkSession
    files = [pathlib.Path(f or tokenizer_path(name)).read_bytes()
             for f, name in ((byte_file, "byte_bpe_50k.json"), (piece_file, "piece_bpe_32k.model"))]
    shared = spark.sparkContext.broadcast(files)

    def first(batches):
        tool = _aligner(*shared.value)
        task = TaskContext.get().partitionId()
        vector = np.zeros(tool.a.size, np.int64)
        held, number, chars = [], 0, 0

        def close():
            """The documents of a block, each with the places of its pairs in the block's list, then that list."""
            nonlocal number, chars
            block = (task << 24) + number
            found = np.unique(np.concatenate([h[8] for h in held])) if held else np.zeros(0, np.int64)
            count = np.zeros(len(found), np.int64)
            for h in held:
                place = np.searchsorted(found, h[8])
                count += np.bincount(place, minlength=len(found))
                cuts = np.searchsorted(h[7], np.arange(len(h[0]) + 1))
                other = [place[s:e].astype("<u4").tobytes() + h[9][s:e].astype("<u4").tobytes() for s, e in zip(cuts, cuts[1:])]
                n = len(h[0])
                yield arrow(_FIRST, block=[block] * n, doc_id=h[0], n_a=h[1], n_b=h[2], n_groups=h[3], n_links=h[4],
                            groups=h[5], same=h[6], other=other, pairs=[None] * n, held=[None] * n)
            if len(found):
                nothing = dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "same", "other"], [None])
                yield arrow(_FIRST, block=[block], pairs=[found], held=[count], **nothing)
            held.clear()
            number, chars = number + 1, 0

        def take(ids, texts):
            n_a, n_b, n_groups, n_links, written, (st, sa, sn), (ot, op, on) = tool.step(texts)
            np.add(vector, np.bincount(sa, minlength=len(vector)), out=vector)
            cuts = np.searchsorted(st, np.arange(len(ids) + 1))
            same = [sa[s:e].astype("<u4").tobytes() + sn[s:e].astype("<u4").tobytes() for s, e in zip(cuts, cuts[1:])]
            if digest:
                written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            held.append((ids, n_a, n_b, n_groups, n_links, written, same, ot, op, on))

        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= step_chars:
                    take(ids, texts)
                    ids, texts, chars, size = [], [], chars + size, 0
                    if chars >= block_chars:
                        yield from close()
            if ids:
                take(ids, texts)
                chars += size
        yield from close()
        if vector.any():
            nothing = dict.fromkeys([n for n in _FIRST.names if n != "held"], [None])
            yield arrow(_FIRST, held=[vector], **nothing)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    parts = stored(rows.mapInArrow(first, "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                          "groups string, same binary, other binary, pairs array<long>, held array<long>"), "crosstok")
    tool = _aligner(*files)
    width, size = tool.width, tool.a.size

    # Documents per identity pair, and per other pair.
    same = np.zeros(size, np.int64)
    for r in parts.where("block is null").select(F.posexplode("held").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).collect():
        same[r.a] = r.n
    asked = parts.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("n"))
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("n_docs")), "crosstok-pairs")
    best = same.copy()
    for r in counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n_docs").alias("n")).collect():
        best[r.a] = max(best[r.a], r.n)
    vectors = spark.sparkContext.broadcast((same, best))

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum", "other"]
    second = pa.schema([_FIRST.field(n) if n in _FIRST.names else pa.field(n, pa.int64()) for n in names])

    def identity_part(batches):
        same, best = vectors.value
        for b in batches:
            n_best, count_sum = [], []
            for data in b.column("same"):
                a, n = _halves(data.as_py())
                n_best.append(int(n[same[a] == best[a]].sum()))
                count_sum.append(int((same[a] * n).sum()))
            done = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            yield pa.RecordBatch.from_arrays([done.get(n, b.column(n) if n in b.schema.names else None) for n in names], schema=second)

    def other_part(key, docs, answers):
        _, best = vectors.value
        order = np.argsort(answers.column("place").to_numpy())
        n_docs, a = answers.column("n_docs").to_numpy()[order], answers.column("pair").to_numpy()[order] // width
        n_best, count_sum = docs.column("n_best").to_numpy().copy(), docs.column("count_sum").to_numpy().copy()
        for i, data in enumerate(docs.column("other")):
            place, n = _halves(data.as_py())
            n_best[i] += n[n_docs[place] == best[a[place]]].sum()
            count_sum[i] += (n_docs[place] * n).sum()
        return pa.table([pa.array(n_best) if c == "n_best" else pa.array(count_sum) if c == "count_sum" else docs.column(c)
                         for c in names[1:-1]], names=names[1:-1])

    docs_in = parts.where("n_a is not null").select(*[n for n in names if n in parts.columns], "same")
    kinds = {n: "binary" if n == "other" else "string" if n == "groups" else "long" for n in names}
    half = docs_in.mapInArrow(identity_part, ", ".join(f"{n} {kinds[n]}" for n in names))
    answers = asked.drop("n").join(counts, "pair")
    documents = half.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        other_part, ", ".join(f"{n} {kinds[n]}" for n in names[1:-1]))

    # Vector entries as rows: as many as vocabulary A has identity pairs.
    known = np.flatnonzero(same)
    regular = spark.createDataFrame(list(zip(known.tolist(), tool.same[known].tolist(), same[known].tolist())), "a long, b long, n_docs long")
    irregular = counts.select(F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"), "n_docs")
    return Alignment(documents, regular.unionByName(irregular))


def _halves(data: bytes) -> tuple:
    whole = np.frombuffer(data, "<u4").astype(np.int64)
    return whole[:len(whole) // 2], whole[len(whole) // 2:]
