"""Mergeable states kept up to date from a stream, and streaming prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.histogram import BINS, bin_counts, finish_bins
from cohortlens.operators.moments import merge_moments, moment_states
from cohortlens.plans.federation import merge_summary


def _batch_path(path: str, kind: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{kind}/batch={batch_id}"


def stream_states(
    stream: DataFrame, path: str, variables: list, by=(), ranges: dict | None = None, bins: int = BINS,
    checkpoint_location: str | None = None, once: bool = True,
) -> StreamingQuery:
    """Write the moment states with rank sketches (and bin counts for given ``ranges``) of each micro-batch.

    A batch owns one folder and replaces it, so a replayed batch does not count
    twice. Readers merge the folders.
    """
    by = list(by)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            states = moment_states(batch, variables, by, sketches=True)
            states.write.mode("overwrite").parquet(_batch_path(path, "moments", batch_id))
            if ranges:
                bin_counts(batch, ranges, by, bins).write.mode("overwrite").parquet(
                    _batch_path(path, "bins", batch_id))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(save).option(
        "checkpointLocation", checkpoint_location or f"{path.rstrip('/')}/_progress"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _finished(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """number -> folder of the ``name=number`` folders whose writing came to an end."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        key, _, number = status.getPath().getName().partition("=")
        if key == name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(number)] = status.getPath().toString()
    return found


def _in_use(spark: SparkSession, path: str, kind: str, last: int | None = None) -> tuple:
    """(the newest finished merged set, the finished batches behind it) as number -> folder; up to ``last``."""
    base = f"{path.rstrip('/')}/{kind}"
    merged = _finished(spark, f"{base}-merged", "upto")
    newest = {max(merged): merged[max(merged)]} if merged else {}
    batches = _finished(spark, base, "batch")
    return newest, {n: f for n, f in sorted(batches.items()) if n > max(newest, default=-1) and (last is None or n <= last)}


def _merged_batches(spark: SparkSession, path: str, kind: str, last: int | None = None) -> DataFrame:
    """The newest merged states and the batches after them. Folders that a run left unfinished are not read."""
    newest, batches = _in_use(spark, path, kind, last)
    if not newest and not batches:
        raise ValueError(f"no finished batch of {kind} in {path}")
    return spark.read.parquet(*newest.values(), *batches.values())


def compact_states(spark: SparkSession, path: str, by=()) -> None:
    """Merge all batches but the newest, which a restart may write again, into one set of states.

    Readers go from the merged states, so what they read no longer grows with the number of batches. The
    merged set is a folder of its own and counts once it is finished: a run that dies at any point leaves
    the old one in use. What the set before this one had replaced is deleted, so that a reader who began with
    that set still finds its files.
    """
    for kind in ("moments", "bins"):
        base = f"{path.rstrip('/')}/{kind}"
        newest, batches = _in_use(spark, path, kind)
        done = sorted(batches)[:-1]
        if not done:
            continue
        rows = _merged_batches(spark, path, kind, done[-1])
        if kind == "moments":
            merged = merge_moments(rows, list(by))
        else:
            merged = rows.groupBy(*by, "variable", "bin").agg(F.sum("n").alias("n"))
        merged.coalesce(1).write.mode("overwrite").parquet(f"{base}-merged/upto={done[-1]}")
        before = max(newest, default=-1)
        old = [f for n, f in _finished(spark, base, "batch").items() if n <= before]
        old += [f for n, f in _finished(spark, f"{base}-merged", "upto").items() if n < before]
        for folder in old:
            files, at = _files(spark, folder)
            files.delete(at, True)


def read_stream_summary(spark: SparkSession, path: str, by=()) -> DataFrame:
    """Summary over everything the stream has delivered so far; quartiles within ``sketches.rank_error``."""
    return merge_summary(_merged_batches(spark, path, "moments"), list(by))


def read_stream_histogram(spark: SparkSession, path: str, ranges: dict, by=(), bins: int = BINS) -> DataFrame:
    counts = _merged_batches(spark, path, "bins")
    summed = counts.groupBy(*by, "variable", "bin").agg(F.sum("n").alias("n"))
    return finish_bins(summed, ranges, list(by), bins)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """A folder of parquet files read as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def predict_stream(model, stream: DataFrame, output: str = "prediction") -> DataFrame:
    """Score a stream with a model whose prediction is a Column expression."""
    return model.predict(stream, output)
