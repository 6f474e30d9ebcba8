"""Mining queries answered from the result cache where it knows them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import MiningQuery
from cohortlens.plans.mining import run_mining
from cohortlens.session import checkpoint, small_rows
from cohortlens.sources import cache as C
from cohortlens.sources.manifest import table_mark
from cohortlens.sources.tables import Catalog

RESULT_ROWS = 100_000
CACHE_SCHEMA = ", ".join(f"{c} {'timestamp' if c in ('created_at', 'last_used') else 'string'}" for c in C.CACHE_COLUMNS)


@dataclass
class CachedResult:
    """A result as one JSON document per row, and whether the cache had it or took it."""

    data: DataFrame
    from_cache: bool
    stored: bool = True


def query_document(query: MiningQuery) -> str:
    """The query as the JSON document that is the cache's key."""
    def codes(names):
        return [{"code": n} for n in names]

    given = sorted(query.algorithm.parameters.items())
    return json.dumps({
        "algorithm": {"code": query.algorithm.code, "parameters": [{"code": k, "value": str(v)} for k, v in given]},
        "covariables": codes(query.covariables), "datasets": codes(query.datasets),
        "filters": None if query.filters is None else repr(query.filters), "grouping": codes(query.grouping),
        "user": {"code": query.user}, "variables": codes(query.variables)})


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries stored at ``path``; none before the first is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def cached_mining(
    spark: SparkSession, catalog: Catalog, query: MiningQuery, path: str, node: str = "local"
) -> CachedResult:
    """The cache's answer for this query and the table's present contents, or a new run that is then stored.

    A changed table has another fingerprint, so its old entries no longer match; of a table of files only
    changed ones are read for it, so a hit reads none. Results beyond the cache's limits of rows and weight
    are handed back as they are and not stored.
    """
    table = catalog.describe(query.target_table)
    mark = table_mark(spark, table, f"{path.rstrip('/')}-manifest")
    asked = spark.createDataFrame(
        [(node, table.name, query_document(query), mark)], "node string, table_name string, query string, table_contents_hash string")
    entries = open_cache(spark, path)
    found = C.cache_get(entries, asked)[0].select("data").limit(1).collect()
    if found:
        return CachedResult(_rows(spark, found[0]["data"]), True)
    rows = checkpoint(run_mining(spark, catalog, query).data)
    result = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    # documents are longer than rows, and weighing takes longer than making them: both only where they can be stored
    if rows.count() > RESULT_ROWS or result.agg(F.coalesce(F.sum(C.json_weight(F.col("row"))), F.lit(0))).first()[0] > C.MAX_WEIGHT:
        return CachedResult(result, False, False)
    document = "[" + ",".join(r["row"] for r in small_rows(result, RESULT_ROWS, "rows of a cached result")) + "]"
    entry = asked.withColumn("timestamp", F.current_timestamp()).withColumn("data", F.lit(document)).withColumn(
        "shape", F.lit("json")).withColumn("function", F.lit(query.algorithm.code))
    C.append_to_cache(entries, entry, path)
    return CachedResult(_rows(spark, document), False)


def prefill(spark: SparkSession, catalog: Catalog, queries: list, path: str) -> int:
    """Run and store the queries that the cache lacks; the number stored."""
    results = [cached_mining(spark, catalog, q, path) for q in queries]
    return sum(r.stored and not r.from_cache for r in results)


def _rows(spark: SparkSession, document: str) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r),) for r in json.loads(document)], "row string")
