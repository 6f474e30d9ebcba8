"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import checkpoint_dir

# A word is a run of bytes other than these; bytes.split() cuts at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a frame once into the cluster's shared folder and read it back.

    Later jobs read the files, so a lost executor costs no recomputation and
    values that depend on task layout stay fixed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cohortlens-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def raw(text: str | None) -> bytes:
    """The bytes of a text; a null text is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def held_out(id_column: str, folds: int):
    """Whether the crc32 of the id as text leaves remainder 1; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds) == 1


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: the installed module, or the folder it is kept in."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
