"""Documents in blocks, and questions that blocks put to key buckets.

Operators that look up very many keys per document (word counts, repeated
windows) would send a row per key through a join. Here a block of documents
sends one row per bucket, its distinct keys packed in order; the bucket answers
with one packed row in the same order. A key occurs once per block at most, so a
key that a third of all documents hold costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import raw, stored

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text whose keys one bucket holds on average
LEAST_BUCKETS = 64

# Ids are kept as text: a list of numbers with a null among them would turn into floats on its way to Python.
BLOCK_DDL = "block long, ids array<string>, sizes array<long>, data binary"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def bucket_count(docs: DataFrame, text_column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two that follows the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    return 1 << max(LEAST_BUCKETS.bit_length() - 1, int(np.ceil(np.log2(max(total / bucket_bytes, 1)))))


def squeeze(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def texts(data: bytes, sizes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64)).tolist()
    return [whole[s:e] for s, e in zip([0, *ends], ends)]


def doc_ids(row) -> list[int | None]:
    return [None if i is None else int(i) for i in row["ids"]]


def in_blocks(docs: DataFrame, ask: Callable[[list, list[bytes]], list[tuple[int, bytes, bytes]]], what: str,
              text_column: str = "text", id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A stored table of blocks, each with the questions ``(bucket, keys, extra)`` that ``ask(ids, texts)`` gives for it.

    Blocks follow the input's own partitions, without a shuffle; a text longer than
    a block is a block of its own. Block numbers are fixed because the table is
    written before anything reads them.
    """
    schema = pa.schema([*_BLOCK, ("asked", ASKED)])

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def block(ids, parts):
            asked = [{"bucket": b, "keys": k, "extra": x} for b, k, x in ask(ids, parts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([[None if i is None else str(i) for i in ids]], pa.list_(pa.string())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([squeeze(parts)], pa.binary()), pa.array([asked], ASKED)], schema=schema)

        ids, parts, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = raw(text.as_py())
                if size and size + len(data) > block_bytes:
                    yield block(ids, parts)
                    ids, parts, size = [], [], 0
                    number += 1
                ids.append(doc)
                parts.append(data)
                size += len(data)
        if ids:
            yield block(ids, parts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"{BLOCK_DDL}, asked {ASKED_DDL}"), what)


ASKED = pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]))
ASKED_DDL = "array<struct<bucket int, keys binary, extra binary>>"


def answered(blocks: DataFrame, answer: Callable[[int, list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """``block, bucket, told``: each bucket's answer to each block's question.

    ``answer(bucket, keys, extras)`` gets the packed questions of all blocks to one
    bucket and gives one answer for each, in the same order.
    """
    asked = blocks.select("block", F.explode("asked").alias("q")).select("block", "q.bucket", "q.keys", "q.extra")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        told = answer(int(rows["bucket"].iat[0]), rows["keys"].tolist(), rows["extra"].tolist())
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "told": told})

    return asked.groupBy("bucket").applyInPandas(run, "block long, bucket int, told binary")


def resolved(blocks: DataFrame, answers: DataFrame, columns: list[str], finish: Callable[..., Iterator[pd.DataFrame]],
             schema: str | T.StructType) -> DataFrame:
    """``finish(block row, {bucket: told})`` for every block, with the answers to its questions."""
    left = blocks.select("block", *columns)
    right = answers.toDF("of", "bucket", "told")

    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return finish(block.iloc[0], dict(zip(told["bucket"].tolist(), told["told"].tolist())))

    return left.groupBy("block").cogroup(right.groupBy("of")).applyInPandas(run, schema)


def pack(keys: np.ndarray, bucket: np.ndarray, *values: np.ndarray):
    """Keys and values grouped by bucket: yields ``bucket, positions``; positions keep the order of keys within a bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for positions in np.split(order, cuts):
        if len(positions):
            yield int(bucket[positions[0]]), positions
