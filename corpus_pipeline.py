"""The corpus pipeline: stages over ``documents``, each calling one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import mixing, packing, pii, quality, simhash
from cohortlens.llm.common import stored


def _own(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged like others.

    Rows that repeat are judged alike, a score of just 0.5 stays, other columns come back as they are. Empty table: no rows.
    """
    model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _own(docs, "_score")
    return quality.scored(docs, model, score_column=score).where(F.col(score) >= 0.5).select(*docs.columns)


def _numbered(docs: DataFrame, row: str, what: str) -> DataFrame:
    """The rows with a key of their own, stored so that every later read sees the same keys."""
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), what)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the one with the smallest id, null ids last. Rows are judged each by itself.

    Null and empty texts are one group; among rows of one id the first stored stays. Empty table: no rows.
    """
    row = _own(docs, "_row")
    rows = _numbered(docs, row, "simhash-rows")
    groups = simhash.near_duplicates(rows.select(F.col(row).alias("_row"), "text"), words=3, distance=3, id_column="_row")
    ids = rows.select(F.col(row).alias("_row"), "doc_id")
    ranked = (groups.select(F.col("doc_id").alias("_key"), "component_id").join(ids, F.col("_key") == F.col("_row"))
              .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")))
    first = ranked.select(F.col("first._row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the kind in brackets; ``n_chars`` follows the text.

    A null text stays null with its ``n_chars``; rows that repeat, null ids and other columns come back as they
    are. Empty table: no rows.
    """
    hidden = pii.redacted(docs)
    return hidden.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once or twice. Each row has its own number of times.

    A null source is one of its own; null and empty texts have no words and are left out; rows that repeat an id or
    have none are rows of their own, in the order of their keys where finish times tie. Empty table: no rows.
    """
    row, times, copy = _own(docs, "_row"), _own(docs, "_times"), _own(docs, "_copy")
    rows = _numbered(docs, row, "mixing-rows")
    sized = rows.select("doc_id", "source", mixing.word_count("text").alias("_words"), F.col(row).alias("_row"))
    taken = mixing.mix(sized, "_words", row_column="_row").where("times > 0").select(F.col("_row").alias(row), F.col("times").alias(times))
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in windows of 2048 tokens, one row per piece.

    A null or empty text is its end id alone; rows that repeat or have no id are packed each; only id and text are
    read. Empty table: no rows.
    """
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("simhash", keep_one_copy),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Learned scores, regular expressions with checksums and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
