"""SimHash near-duplicates: word shingle fingerprints linked by a pigeonring filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortlens.llm.common import LOWER, arrow, raw
from cohortlens.llm.components import components
from cohortlens.session import checkpoint

SEGMENTS, WIDTH = 4, 16  # of a 64-bit fingerprint
CHUNK = 50_000  # shingles counted at once


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes."""
    parts = raw(text).translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxh64_intdigest(b" ".join(parts), seed)], dtype=np.uint64)
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(parts) - words + 1
        hashes = np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[words - 1:].tolist())),
                             np.uint64, n)
    counts = np.zeros(64, dtype=np.int64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), CHUNK):
        counts += np.unpackbits(octets[at:at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(octets)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, text_column: str = "text", id_column: str = "doc_id",
                 seed: int = 42) -> DataFrame:
    """``doc_id, fp`` per row; a null text counts as empty, no words give fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            yield arrow(schema, doc_id=b.column(0), fp=[fingerprint(t.as_py(), words, seed) for t in b.column(1)])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def chained(x: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Whether the differences x pass the pigeonring chain that begins at segment ``start``.

    The first l segments of the chain may differ in l * budget / 4 bits at most, for
    each l; the last length is the full Hamming check.
    """
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for length in range(1, SEGMENTS + 1):
        shift = (((start + length - 1) % SEGMENTS) * WIDTH).astype(np.uint64)
        total += np.bitwise_count((x >> shift) & np.uint64(0xFFFF)).astype(np.int64)
        ok &= total * SEGMENTS <= length * budget
    return ok


def _tree(fps: np.ndarray, start: int, budget: int) -> list[tuple[int, int]]:
    """Edges that span the linked groups of one run, without listing all pairs."""
    rest, edges = fps.copy(), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = chained(rest ^ at, np.full(len(rest), start), budget)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                edges.extend((at, f) for f in found)
    return edges


def _linked(keys: np.ndarray, fps: np.ndarray, budget: int):
    """Edges within runs of equal keys; the low two bits of a key name the first segment."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    two = begin[size == 2]
    x = fps[two] ^ fps[two + 1]
    two = two[chained(x, keys[two] & 3, budget)]
    a, b = [fps[two]], [fps[two + 1]]
    for at, n in zip(begin[size > 2], size[size > 2]):
        if edges := _tree(fps[at:at + n], int(keys[at] & 3), budget):
            u, v = zip(*edges)
            a.append(np.array(u, np.uint64))
            b.append(np.array(v, np.uint64))
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def linked(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints ``fp`` within ``distance`` bits (at most 3).

    Four 16-bit segments stand in a ring. By the pigeonring principle a pair within
    3 bits has a start whose first segment is equal and whose first two segments
    differ in at most one bit. So each fingerprint is filed under the start, the
    equal segment and the next segment with one bit blanked: 31 bits of content, 64
    keys. Rows of a key meet in a sorted partition; longer chains prune the pairs,
    the longest chain is the Hamming check. Within a key only a spanning tree of the
    links is kept, never all pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the ring of four segments holds for 0 to 3 bits")
    seg = [F.shiftrightunsigned("fp", i * WIDTH).bitwiseAND(F.lit(0xFFFF)) for i in range(SEGMENTS)]
    keys = F.array(*[
        F.shiftleft(seg[i], 22) + F.shiftleft(seg[(i + 1) % SEGMENTS].bitwiseAND(F.lit(0xFFFF ^ (1 << bit))), 6)
        + F.lit(bit * 4 + i) for i in range(SEGMENTS) for bit in range(WIDTH)])
    filed = distinct.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        k, f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.concatenate((k, batch.column(1).to_numpy()))
            f = np.concatenate((f, batch.column(0).to_numpy().view(np.uint64)))
            if not len(k):
                continue
            whole = np.searchsorted(k, k[-1])
            if whole:
                a, b = _linked(k[:whole], f[:whole], distance)
                k, f = k[whole:], f[whole:]
                yield arrow(schema, a=a, b=b)
        if len(k):
            a, b = _linked(k, f, distance)
            yield arrow(schema, a=a, b=b)

    pairs = filed.mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, text_column: str = "text",
                    id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; the component is the smallest id reachable.

    Equal fingerprints are one node, however many rows have it. Rows without words
    share fingerprint 0. A null id is kept and never the smallest; a component of
    null ids only is null. Repeated rows come back as often as they came. Other
    columns of ``docs`` play no part.
    """
    rows = checkpoint(fingerprints(docs, words, text_column, id_column, seed))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(distinct.select("fp"), distance)).withColumnRenamed("id", "fp")
    node = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    node = checkpoint(node)
    lowest = node.groupBy("root").agg(F.min("first").alias("component_id"))
    found = node.join(lowest, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")
