"""Language-model scores by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortlens.llm import blocks
from cohortlens.llm.common import LOWER, stored

DEPTH = 5  # context bytes; with the byte itself a key has 48 bits
FOLDS = 5
SALT_BLOCKS = 256  # blocks whose questions to one bucket meet in one task
_STEP = 1 << 20  # bytes whose keys are held at a time
_END = b"\n"


def held(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 1


def small(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes, then all second ones and so on."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""


def opened(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def small_sorted(a: np.ndarray) -> bytes:
    return small(np.diff(a, prepend=0))


def opened_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, np.int64))


class Spelled:
    """Texts as the model reads them: lower-case words, a space after each, one end sign."""

    def __init__(self, parts: list[bytes]):
        lines, hashes = [], []
        end = xxh64_intdigest(_END)
        for p in parts:
            words = p.translate(LOWER).split()
            lines.append(b" ".join(words) + b" " + _END if words else _END)
            hashes.append(np.fromiter((*map(xxh64_intdigest, words), end), np.uint64, len(words) + 1))
        self.lines = lines
        self.tokens = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def keys(self, depth: int):
        """Runs of texts: yields first text, byte counts of the run's texts, and a key per byte.

        A key holds the bytes before (the nearest highest, none before the start as 0)
        and the byte itself lowest.
        """
        first = 0
        while first < len(self.lines):
            last, size = first, 0
            while last < len(self.lines) and (last == first or size + len(self.lines[last]) <= _STEP):
                size += len(self.lines[last])
                last += 1
            counts = np.array([len(x) for x in self.lines[first:last]], np.int64)
            data = np.frombuffer(b"".join(self.lines[first:last]), np.uint8).astype(np.int64)
            begins = np.cumsum(counts) - counts
            key = np.zeros(len(data), np.int64)
            for back in range(1, depth + 1):
                before = np.zeros(len(data), np.int64)
                before[back:] = data[:-back] if back < len(data) else 0
                for j in range(back):  # the first bytes of a text have no byte that far back
                    at = begins[counts > j] + j
                    before[at] = 0
                key = (key << 8) | before
            yield first, counts, (key << 8) | data
            first = last


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys, sorted, with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[at], *[np.add.reduceat(v[order], at) for v in values])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x > 0."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a bit sequence with these counts under the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


def bits(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the node that predicts bit ``level`` (context, bits before with a leading one), and the bit."""
    byte = keys & 255
    return (keys >> 8 << 8) | (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1


def leaves(keys: np.ndarray, counts: np.ndarray):
    """Node keys at full depth with counts of zeros and ones."""
    nodes, zeros, ones = [], [], []
    for level in range(8):
        node, bit = bits(keys, level)
        nodes.append(node)
        zeros.append(counts * (1 - bit))
        ones.append(counts * bit)
    return _summed(np.concatenate(nodes), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float))


def shorter(nodes: np.ndarray) -> np.ndarray:
    """Node keys with the farthest context byte dropped."""
    return (nodes >> 16 << 8) | (nodes & 255)


def weigh(zeros, ones, below):
    """Log weighted probability of nodes, and the share of their own estimate in it."""
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, below) - math.log(2)
    return mixed, np.exp(own - math.log(2) - mixed)


def tree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2):
    """Levels ``depth .. top`` as (nodes, zeros, ones, own share), and what level ``top - 1`` gets: (nodes, zeros, ones, log weights)."""
    nodes, zeros, ones = leaves(keys, counts)
    weight, levels = log_kt(zeros, ones), {depth: (nodes, zeros, ones, np.ones(len(nodes)))}
    for d in range(depth - 1, top - 1, -1):
        nodes, zeros, ones, below = _summed(shorter(nodes), zeros, ones, weight)
        weight, share = weigh(zeros, ones, below)
        levels[d] = (nodes, zeros, ones, share)
    return levels, _summed(shorter(nodes), zeros, ones, weight)


def crown(nodes, zeros, ones, below) -> dict:
    """Levels 1 and 0 from the sums that level 1 gets of the whole corpus."""
    weight, share = weigh(zeros, ones, below)
    out = {1: (nodes, zeros, ones, share)}
    nodes, zeros, ones, below = _summed(shorter(nodes), zeros, ones, weight)
    out[0] = (nodes, zeros, ones, weigh(zeros, ones, below)[1])
    return out


def log_probabilities(keys: np.ndarray, levels: dict, depth: int) -> np.ndarray:
    """log10 P(byte | context) of each key: per bit, the estimates of all depths mixed from the longest context up."""
    total = np.zeros(len(keys))
    for level in range(8):
        node, bit = bits(keys, level)
        p = np.full(len(keys), 0.5)
        for d in range(depth, -1, -1):
            at_depth = (node >> (8 + 8 * (depth - d)) << 8) | (node & 255)
            nodes, zeros, ones, share = levels[d]
            if not len(nodes):
                continue
            i = np.minimum(np.searchsorted(nodes, at_depth), len(nodes) - 1)
            seen = nodes[i] == at_depth
            own = (np.where(bit == 1, ones[i], zeros[i]) + 0.5) / (zeros[i] + ones[i] + 1)
            p = np.where(seen, share[i] * own + (1 - share[i]) * p, p if d < depth else 0.5)
        total += np.log10(p)
    return total


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([opened_sorted(k) for k in rows["keys"]])
    counts = np.concatenate([opened(c, np.int64) for c in rows["extra"]])
    return _summed(keys[counts > 0], counts[counts > 0])


def scores(docs: DataFrame, depth: int = DEPTH, folds: int = FOLDS, text_column: str = "text", id_column: str = "doc_id",
           block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` per row.

    Rows whose crc32(id as text) mod ``folds`` is not 1 train the model; all rows are scored
    with what training gathered. A text is its lower-case words, a space after each, and an
    end sign. Each of the 255 nodes of a byte's binary decomposition has a context tree over
    the ``depth`` bytes before. A node mixes its own Krichevsky-Trofimov estimate, half and
    half before any data, with its children's; the shares after training predict each bit.
    Base: unigrams with 0.5 added, one unknown word beside the vocabulary.

    Blocks of documents ask for their distinct words (by 64-bit hash) and distinct keys
    of context and byte. Keys are filed by the two nearest bytes, so that all deeper levels are
    local to a bucket; its blocks merge in salted groups first. Levels 1 and 0 need one
    sum over at most 65,280 nodes, which go to the driver.

    A null text is empty and has the end sign only; a null id counts as the empty text and trains.
    Repeated rows train and are scored as often. With nothing to train on every bit costs
    one bit. Texts of any length are read whole. Empty table: no rows.
    """
    if not 2 <= depth <= 6:
        raise ValueError("2 to 6 context bytes fit a key")
    n_buckets = blocks.bucket_count(docs, text_column)
    high = 8 * (depth - 1)  # bits of a key below its two nearest bytes

    def word_bucket(words):
        return (words >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64)

    def key_bucket(keys):
        return n_buckets + ((keys >> high) * 0x9E3779B1 >> 12) % n_buckets

    def distinct(text: Spelled, ids):
        train = np.array([not held(i, folds) for i in ids])
        w, n = _summed(text.words, np.repeat(train, text.tokens).astype(np.int64))
        keys, counts = [], []
        for first, sizes, key in text.keys(depth):
            k, c = np.unique(key * 2 + np.repeat(train[first:first + len(sizes)], sizes), return_counts=True)
            keys.append(k)
            counts.append(c)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return w, n, *_summed(keys >> 1, counts * (keys & 1))

    def ask(ids, parts):
        w, n, keys, counts = distinct(Spelled(parts), ids)
        out = [(b, w[at].tobytes(), small(n[at])) for b, at in blocks.pack(w, word_bucket(w))]
        return out + [(b, small_sorted(keys[at]), small(counts[at])) for b, at in blocks.pack(keys, key_bucket(keys))]

    table = blocks.in_blocks(docs, ask, "spelled", text_column, id_column, block_bytes)
    n_blocks = table.count()
    asked = table.select("block", F.explode("asked").alias("q")).select("block", "q.bucket", "q.keys", "q.extra")

    def count_words(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        counts = np.concatenate([opened(c, np.int64) for c in rows["extra"]])
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, back, counts)
        told = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
        out = rows[["block", "bucket"]].assign(told=[small(t) for t in told], vocabulary=0, tokens=0)
        out.iloc[0, 3:] = int((total > 0).sum()), int(total.sum())
        return out

    counted = stored(asked.where(F.col("bucket") < n_buckets).groupBy("bucket").applyInPandas(
        count_words, "block long, bucket int, told binary, vocabulary long, tokens long"), "words")
    size = counted.agg(F.sum("vocabulary"), F.sum("tokens")).first()
    vocabulary, tokens = size[0] or 0, size[1] or 0

    salts = max(1, math.ceil(n_blocks / SALT_BLOCKS))
    questions = asked.where(F.col("bucket") >= n_buckets).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        return pd.DataFrame([{"bucket": rows["bucket"].iat[0], "keys": small_sorted(keys), "extra": small(counts)}])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        top = list(zip(*tree(keys, counts, depth)[1])) if len(keys) else []
        return pd.DataFrame([{
            "of": rows["bucket"].iat[0], "keys": small_sorted(keys), "extra": small(counts),
            "top": [{"node": int(n), "zeros": z, "ones": o, "below": b} for n, z, o, b in top]}])

    merged = questions.groupBy("bucket", "salt").applyInPandas(merge, "bucket int, keys binary, extra binary")
    model = stored(merged.groupBy("bucket").applyInPandas(
        grow, "of int, keys binary, extra binary, top array<struct<node long, zeros double, ones double, below double>>"), "model")
    top = (model.select(F.explode("top").alias("t")).groupBy("t.node").agg(
        F.sum("t.zeros").alias("zeros"), F.sum("t.ones").alias("ones"), F.sum("t.below").alias("below")).toPandas())
    top = top.sort_values("node")
    upper = crown(*[top[c].to_numpy() for c in ("node", "zeros", "ones", "below")])

    def predict(key, rows: pd.DataFrame, trained: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"block": [], "bucket": [], "told": []})
        keys = [opened_sorted(k) for k in rows["keys"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        levels = tree(opened_sorted(trained["keys"].iat[0]), opened(trained["extra"].iat[0], np.int64), depth)[0]
        p = log_probabilities(every, levels | upper, depth).astype(np.float32)[back]
        told = np.split(p, np.cumsum([len(k) for k in keys])[:-1])
        return rows[["block", "bucket"]].assign(told=[small(t) for t in told])

    copies = model.select("of", "keys", "extra", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("copy")).toDF(
        "of", "keys", "extra", "copy")
    predicted = (questions.toDF("block", "bucket", "keys", "extra", "salt").groupBy("bucket", "salt")
                 .cogroup(copies.groupBy("of", "copy")).applyInPandas(predict, "block long, bucket int, told binary"))

    def finish(row, told):
        ids = blocks.doc_ids(row)
        text = Spelled(blocks.texts(row["data"], row["sizes"]))
        w, _, keys, _ = distinct(text, ids)
        counts, logs = np.zeros(len(w), np.int64), np.zeros(len(keys))
        for b, at in blocks.pack(w, word_bucket(w)):
            counts[at] = opened(told[b], np.int64)
        for b, at in blocks.pack(keys, key_bucket(keys)):
            logs[at] = opened(told[b], np.float32)
        begins = np.cumsum(text.tokens) - text.tokens
        c = counts[np.searchsorted(w, text.words)]
        score = np.concatenate([
            np.add.reduceat(logs[np.searchsorted(keys, key)], np.cumsum(sizes) - sizes) for _, sizes, key in text.keys(depth)])
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "held_out": [held(i, folds) for i in ids], "n_tokens": text.tokens,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), begins), "logs": np.add.reduceat(np.log10(c + 0.5), begins),
            "score": score, "n_bytes": [len(x) for x in text.lines]})

    answers = counted.select("block", "bucket", "told").union(predicted)
    out = blocks.resolved(table, answers, ["ids", "sizes", "data"], finish,
                          "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long")
    unit = math.log10(tokens + 0.5 * (vocabulary + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                      (F.col("logs") - F.col("n_tokens") * unit).alias("base_score"), "score", "n_bytes",
                      (-F.col("score") / F.col("n_bytes") * math.log2(10)).alias("bits_per_byte"))
