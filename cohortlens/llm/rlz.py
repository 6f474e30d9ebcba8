"""Substring deduplication: documents are factored against an index of all reference blocks.

Every block of documents is a reference for the others and for itself. The index names, for a window of words, the
nearest earlier place where it stands too (the nearest later one for the first of all). A document is parsed greedily:
a factor starts at the first window that has a reference and goes on word by word as long as the reference does;
where another reference takes over, the next factor starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from cohortlens.llm import blocks
from cohortlens.llm.common import stored

WINDOW, SEED_WORDS = 35, 16
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers of two rolling hashes


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """64-bit hash of every n consecutive words, from prefix sums of word * base**i."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words))[:-1], dtype=np.uint64)))
    back = _powers(pow(base, -1, 1 << 64), len(words))[:len(words) - n + 1]
    return _mixed((sums[n:] - sums[:-n]) * back)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    span, low = 1, x
    while span * 2 <= n:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = n - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


class Words:
    """Word hashes of some texts in one row, and where windows may start."""

    def __init__(self, parts: list[bytes], window: int):
        rows = []
        for p in parts:
            words = p.split()
            rows.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        self.counts = np.array([len(r) for r in rows], dtype=np.int64)
        self.hashes = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        n = max(len(self.hashes) - window + 1, 0)
        ends = np.repeat(self.ends, self.counts)[:n]
        self.valid = np.arange(n) + window <= ends

    def seeds(self, window: int, seed_words: int) -> np.ndarray:
        """Of each valid window the smallest hash of its seeds: equal windows have equal seeds."""
        grams = rolling(self.hashes, seed_words, _B1)
        return sliding_min(grams, window - seed_words + 1)[self.valid] if len(self.valid) else grams[:0]

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.hashes, window, _B1)[self.valid], rolling(self.hashes, window, _B2)[self.valid]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _questions(keys: np.ndarray, bucket: np.ndarray, twice: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    return [(b, keys[at].tobytes(), np.packbits(twice[at]).tobytes()) for b, at in blocks.pack(keys, bucket)]


def repeated(_: int, keys: list[bytes], twice: list[bytes]) -> list[bytes]:
    """For each block's keys one bit: does the key occur twice in that block, or in another block."""
    arrays = [np.frombuffer(k, np.uint64) for k in keys]
    every, back = np.unique(np.concatenate(arrays), return_inverse=True)
    counts = np.bincount(back, minlength=len(every))
    ends = np.cumsum([len(a) for a in arrays])
    at = [back[e - len(a):e] for a, e in zip(arrays, ends)]
    for where, bits in zip(at, twice):
        counts[where[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)]] += 1
    return [np.packbits(counts[where] > 1).tobytes() for where in at]


def _told(bucket: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
    """Answers in the order of the keys that were asked."""
    out = np.zeros(len(bucket), bool)
    for b, at in blocks.pack(bucket, bucket):
        out[at] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(at)).astype(bool)
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that the bytes which small numbers leave empty compress away."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _places(keys: np.ndarray, bucket: np.ndarray, twice: np.ndarray, places: np.ndarray, block: int) -> list[tuple[int, bytes, bytes]]:
    """Questions that also say where in which block each key stands first."""
    head = np.array([block], np.int64).tobytes()
    return [(b, keys[at].tobytes(), head + np.packbits(twice[at]).tobytes() + _planes(places[at]))
            for b, at in blocks.pack(keys, bucket)]


def referred(_: int, keys: list[bytes], extras: list[bytes]) -> list[bytes]:
    """For each block's keys: whether each has a reference, and which.

    That is the first place in the nearest earlier block that holds the key; for the earliest block its own
    second place, which it finds itself, or else the first place in the next block. So blocks refer to
    their neighbours, and not all to one.
    """
    arrays = [np.frombuffer(k, np.uint64) for k in keys]
    sizes = np.array([len(a) for a in arrays])
    numbers = np.array([int.from_bytes(x[:8], "little", signed=True) for x in extras])
    cuts = [8 + -(-n // 8) for n in sizes.tolist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x[8:c], np.uint8), count=n) for x, c, n in zip(extras, cuts, sizes.tolist())]).astype(bool)
    places = np.concatenate([_from_planes(x[c:]) for x, c in zip(extras, cuts)])
    every, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
    order = np.lexsort((numbers[owner], every))
    same = every[order][1:] == every[order][:-1]
    earlier, later = np.r_[False, same], np.r_[same, False]
    at = np.where(earlier, np.r_[0, order[:-1]], np.where(later & ~twice[order], np.r_[order[1:], 0], order))
    reference = np.empty(len(every), np.int64)
    reference[order] = at
    has = np.empty(len(every), bool)
    has[order] = earlier | later | twice[order]
    out, end = [], 0
    for n in sizes.tolist():
        mine, known = reference[end:end + n], has[end:end + n]
        which = mine[known]
        named, at = np.unique(numbers[owner[which]], return_inverse=True)
        out.append(len(named).to_bytes(4, "little") + named.astype("<i8").tobytes() + np.packbits(known).tobytes()
                   + _planes(at) + _planes(places[which]))
        end += n
    return out


def _referred(bucket: np.ndarray, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has a reference, its block, its place) in the order of the keys that were asked."""
    has, block, place = np.zeros(len(bucket), bool), np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    for b, at in blocks.pack(bucket, bucket):
        data = told[b]
        bits = 4 + 8 * int.from_bytes(data[:4], "little")
        named, rest = np.frombuffer(data[4:bits], "<i8"), bits + -(-len(at) // 8)
        known = np.unpackbits(np.frombuffer(data[bits:rest], np.uint8), count=len(at)).astype(bool)
        n = int(known.sum())
        has[at] = known
        block[at[known]] = named[_from_planes(data[rest:rest + 4 * n])]
        place[at[known]] = _from_planes(data[rest + 4 * n:])
    return has, block, place


def _apart(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) pairs: position of one of each, the pair of each row, and how often each occurs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    back = np.empty(len(a), np.int64)
    back[order] = group
    return order[new], back, np.bincount(group, minlength=int(new.sum()))


def factors(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Words that windows starting here cover, as (first, words)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(run[0]), int(run[-1] - run[0]) + window) for run in np.split(starts, cut)]


def parsed(starts: np.ndarray, block: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document into factors (first word, words, block and word of the reference).

    Every window start has its reference; a factor goes on while the next window's reference is the next word of the
    same one. The next factor starts at the first window that the one before does not hold whole, so that
    two references that follow each other overlap by less than a window.
    """
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(block) != 0) | (np.diff(place - starts) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(starts)] - 1
    return list(zip(starts[first].tolist(), (starts[last] - starts[first] + window).tolist(), block[first].tolist(), place[first].tolist()))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, text_column: str = "text",
                    id_column: str = "doc_id", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256, factors, block, first_word`` per row of ``docs``.

    A word is removed if a window of ``window`` words that covers it starts anywhere else too, in any document or
    the same one. ``factors`` are the parse: first word and words in the document, and the block and the word
    in it where the same words stand. A document lies in ``block`` from ``first_word`` on.
    ``kept_text`` is null for rows that lose nothing.

    Each block of documents is indexed by one seed per window, the smallest hash among
    its runs of ``seed_words`` words, and the index is spread over buckets. (1) Every
    block asks for its seeds; windows whose seed occurs nowhere else have no reference. (2) The
    others ask by a hash of 64 bits, filed by the bits of a second hash, and say where they stand; the
    answer names a reference for each. (3) The greedy parse follows the references. Each window that a factor
    starts with is judged by itself, so the factors' boundaries are exact and together they hold exactly the
    words to remove.

    Null and empty texts have no words. Rows that repeat are references of each
    other. Texts shorter than a window lose nothing. A text longer than a block is a block of its own, parsed whole.
    Columns other than id and text are not read. Empty table: no rows.
    """
    n_buckets = blocks.bucket_count(docs, text_column)

    def ask_seeds(ids, parts):
        words = Words(parts, window)
        seeds = words.seeds(window, seed_words)
        # a seed is repeated within the block if it stands at two places; the same place serves neighbouring windows
        grams = rolling(words.hashes, seed_words, _B1)
        keys = np.unique(seeds)
        order = np.sort(grams[np.isin(grams, keys, kind="sort")]) if len(keys) else grams[:0]
        twice = np.zeros(len(keys), bool)
        if len(keys):
            twice = np.searchsorted(order, keys, side="right") - np.searchsorted(order, keys) > 1
        return _questions(keys, _bucket(_mixed(keys), n_buckets), twice)  # mixed again: minima are small numbers

    first = blocks.in_blocks(docs, ask_seeds, "blocks", text_column, id_column, block_bytes)

    def suspects(row, told):
        parts = blocks.texts(row["data"], row["sizes"])
        words = Words(parts, window)
        seeds = words.seeds(window, seed_words)
        keys, back = np.unique(seeds, return_inverse=True)
        hit = np.zeros(len(words.valid), bool)
        hit[words.valid] = _told(_bucket(_mixed(keys), n_buckets), told)[back] if len(keys) else False
        sums = np.concatenate(([0], np.cumsum(hit)))
        touched = sums[np.minimum(words.ends, len(hit))] > sums[np.minimum(words.begins, len(hit))]
        clean = [None if t else hashlib.sha256(b" ".join(p.split())).hexdigest() for p, t in zip(parts, touched)]
        one, two = (h[hit[words.valid]] for h in words.windows(window))
        place, _, often = _apart(one, two)
        kept = [p for p, t in zip(parts, touched) if t]
        inside = [hit[b:e] for b, e, t in zip(words.begins, words.ends, touched) if t]
        # the flags of a document's words; the last ones of the block can start no window
        flags = np.concatenate([np.pad(f, (0, int(c) - len(f))) for f, c in zip(inside, words.counts[touched])]) if kept else hit[:0]
        asked = _places(one[place], _bucket(two[place], n_buckets), often > 1, np.flatnonzero(hit)[place], int(row["block"]))
        return pd.DataFrame([{
            "block": row["block"], "ids": row["ids"], "begins": words.begins.tolist(), "n_words": words.counts.tolist(), "clean": clean,
            "sizes": [len(p) for p in kept], "data": blocks.squeeze(kept), "flags": np.packbits(flags).tobytes(),
            "asked": [{"bucket": b, "keys": k, "extra": x} for b, k, x in asked]}])

    second = stored(blocks.resolved(
        first, blocks.answered(first, repeated), ["ids", "sizes", "data"], suspects,
        "block long, ids array<string>, begins array<long>, n_words array<long>, clean array<string>, sizes array<long>, data binary, flags binary, "
        f"asked {blocks.ASKED_DDL}"), "suspects")

    def parse(row, told):
        parts = blocks.texts(row["data"], row["sizes"])
        words = Words(parts, window)
        flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(words.hashes)).astype(bool)
        hit = flags[:len(words.valid)] & words.valid
        one, two = (h[hit[words.valid]] for h in words.windows(window))
        place, back, _ = _apart(one, two)
        at_block = np.repeat([b for b, sha in zip(row["begins"], row["clean"]) if sha is None], words.counts).astype(np.int64)
        at_block += np.arange(len(words.hashes)) - np.repeat(words.begins, words.counts)  # of each word
        hits = np.flatnonzero(hit)
        found = np.zeros(len(words.hashes), bool)
        ref_block, ref_word = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes), np.int64)
        if len(place):
            has, far_block, far_word = _referred(_bucket(two[place], n_buckets), told)
            here, where = at_block[hits], np.arange(len(hits))
            # windows of this block in order of their key, then of their place
            order = np.argsort(back, kind="stable")
            again = np.r_[False, back[order][1:] == back[order][:-1]]
            before, after = np.full(len(hits), -1), np.full(len(hits), -1)
            before[order[again]] = order[np.flatnonzero(again) - 1]
            after[order[np.flatnonzero(again) - 1]] = order[again]
            own = before >= 0
            to_block = np.where(own, row["block"], far_block[back])
            to_word = np.where(own, here[before], far_word[back])
            second = ~own & (to_block == row["block"]) & (after >= 0)  # the first of all: its own second place
            to_word[second] = here[after[where[second]]]
            found[hits], ref_block[hits], ref_word[hits] = has[back], to_block, to_word
        out, at = [], 0
        for doc, n, sha, first_word in zip(blocks.doc_ids(row), row["n_words"], row["clean"], row["begins"]):
            if sha is not None:
                out.append((doc, n, 0, None, sha, [], row["block"], first_word))
                continue
            b, e = words.begins[at], words.ends[at]
            starts = np.flatnonzero(found[b:e])
            spans = factors(starts, window)
            parted, keep, end = parts[at].split(), [], 0
            for s, length in spans:
                keep += parted[end:max(s, end)]
                end = max(end, s + length)
            keep += parted[end:]
            text = b" ".join(keep)
            parse_ = parsed(starts, ref_block[b:e][starts], ref_word[b:e][starts], window)
            out.append((doc, n, len(parted) - len(keep), text.decode("utf-8", "replace") if spans else None,
                        hashlib.sha256(text).hexdigest(),
                        [dict(zip(("first", "words", "ref_block", "ref_word"), f)) for f in parse_], row["block"], first_word))
            at += 1
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "factors", "block", "first_word"])

    return blocks.resolved(
        second, blocks.answered(second, referred), ["ids", "begins", "n_words", "clean", "sizes", "data", "flags"], parse,
        "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, "
        "factors array<struct<first long, words long, ref_block long, ref_word long>>, block long, first_word long")
