"""Fingerprints of file tables that read changed files only.

A manifest keeps, per file of a table, its length, its time and what its rows contribute to the table's fingerprint. A
lookup lists the files; only those that the manifest does not know as they are now are read. The fingerprint is the
sum over the present files and equals ``cache.table_fingerprint`` of the whole table.
"""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import FeatureTable
from cohortlens.sources.cache import row_mark, table_fingerprint
from cohortlens.sources.tables import open_table

FILE_FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")
SCHEMA = "layout string, file string, length long, time long, rows long, mark decimal(38,0)"
FILES_AT_ONCE = 10_000  # paths handed to one scan


def _plain(uri: str) -> str:
    """One spelling for the paths that a listing and a scan give."""
    return re.sub(r"^file:/+", "file:/", uri)


def list_files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """path -> (length, time) of the data files below a folder, or of a file; nothing is opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, base = {}, at.toUri().getPath().rstrip("/")
    listing = files.listFiles(at, True)
    while listing.hasNext():
        status = listing.next()
        below = status.getPath().toUri().getPath()[len(base):].split("/")
        if not any(part.startswith(("_", ".")) and "=" not in part for part in below):
            found[_plain(status.getPath().toUri().toString())] = (status.getLen(), status.getModificationTime())
    return found


def _known(spark: SparkSession, manifest: str, layout: str) -> dict:
    at = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.schema(SCHEMA).parquet(manifest).filter(F.col("layout") == layout).collect()  # one row per file
    return {(r["file"], r["length"], r["time"]): (r["rows"], r["mark"]) for r in rows}


def _measured(spark: SparkSession, table: FeatureTable, files: list, columns: list) -> DataFrame:
    """(file, rows, mark) of some files; partition columns come from the folders' names."""
    reader = spark.read.format(table.format).options(**table.options)
    if "basePath" not in table.options and len(files) and not table.source.rstrip("/").endswith(tuple(f.rsplit("/", 1)[-1] for f in files)):
        reader = reader.option("basePath", table.source)
    df = reader.schema(open_table(spark, table).schema).load(files)
    return df.select(F.col("_metadata.file_path").alias("file"), row_mark(df, columns).alias("mark")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("mark").alias("mark"))


def table_mark(spark: SparkSession, table: FeatureTable, manifest: str) -> str:
    """``rows-fingerprint`` of the table's present contents, by way of the manifest folder.

    A table that is not a path of files has none; it is read whole.
    """
    opened = open_table(spark, table)
    if callable(table.source) or not table.source or table.format not in FILE_FORMATS:
        return "-".join(map(str, table_fingerprint(opened).first()))
    columns = sorted(opened.columns)
    layout = hashlib.sha256(repr((table.name, table.source, table.format, sorted(table.options.items()), opened.schema.json())).encode()).hexdigest()
    present = list_files(spark, table.source)
    known = _known(spark, manifest, layout)
    unknown = [f for f, (length, time) in present.items() if (f, length, time) not in known and length > 0]
    for at in range(0, len(unknown), FILES_AT_ONCE):
        some = unknown[at:at + FILES_AT_ONCE]
        measured = {_plain(r["file"]): (r["rows"], r["mark"]) for r in _measured(spark, table, some, columns).collect()}  # one row per file
        rows = [(layout, f, *present[f], *measured.get(f, (0, Decimal(0)))) for f in some]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(manifest)
        known |= {(f, length, time): (n, mark) for _, f, length, time, n, mark in rows}
    found = [known.get((f, *state), (0, Decimal(0))) for f, state in present.items()]
    return f"{sum(n for n, _ in found)}-{sum(int(mark) for _, mark in found)}"
