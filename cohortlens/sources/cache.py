"""A cache of query results as a table, with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of what is cached and for how long.
MAX_COLUMNS = 30
MAX_WEIGHT = 1_000_000
MAX_ENTRIES = 10_000
MAX_IDLE_DAYS = 10
SYSTEM_USER = "system"

KEY = ["node", "table_name", "query"]
# The stored layout, which entries written before must keep fitting.
CACHE_COLUMNS = [
    "node", "table_name", "table_contents_hash", "query", "created_at", "last_used", "data", "shape", "function",
]

_CODES = "array<struct<code:string>>"
_QUERY_SCHEMA = (
    f"algorithm struct<code:string,parameters:array<struct<code:string,value:string>>>, covariables {_CODES}, "
    f"datasets {_CODES}, filters string, grouping {_CODES}, user struct<code:string>, variables {_CODES}"
)


def read_query(query: Column) -> Column:
    """struct(width, text): the number of columns a query names, and its canonical JSON.

    The canonical form names the system user instead of the caller. The parsed
    document goes through a one-element array, so that it is parsed once.
    """
    def canonical(q):
        width = sum((F.greatest(F.size(q[c]), F.lit(0)) for c in ("covariables", "grouping")),
                    F.greatest(F.size(q["variables"]), F.lit(0)))
        names = ["algorithm", "covariables", "datasets", "filters", "grouping"]
        text = F.to_json(F.struct(
            *[q[c].alias(c) for c in names], F.struct(F.lit(SYSTEM_USER).alias("code")).alias("user"),
            q["variables"].alias("variables")))
        return F.struct(width.alias("width"), text.alias("text"))

    return F.get(F.transform(F.array(F.from_json(query, _QUERY_SCHEMA)), canonical), F.lit(0))


def _cacheable(query: Column) -> Column:
    """Canonical JSON, or null for a query over too many columns."""
    q = read_query(query)
    return F.get(F.transform(F.array(q), lambda r: F.when(r["width"] <= MAX_COLUMNS, r["text"])), F.lit(0))


def json_weight(document: Column) -> Column:
    """Weight of a JSON text: the length of its string values, 1 per number or boolean, 0 for null."""
    plain = F.regexp_replace(document, r"\\(u[0-9a-fA-F]{4}|.)", "x")  # an escape is one character
    values = F.regexp_replace(plain, r'"[^"]*"\s*:', "")  # keys weigh nothing
    strings = F.regexp_extract_all(values, F.lit(r'"([^"]*)"'), F.lit(1))
    others = F.regexp_extract_all(F.regexp_replace(values, r'"[^"]*"', ""), F.lit(r"true|false|[-+.0-9eE]+"), F.lit(0))
    return F.aggregate(strings, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)) + F.size(others)


def cache_entries(results: DataFrame) -> DataFrame:
    """Results that may be cached, one per key: the first created one.

    ``results`` has node, table_name, query, timestamp, data, shape, function.
    """
    kept = (
        results.filter(F.col("table_name").isNotNull())
        .filter(json_weight(F.col("data")) <= MAX_WEIGHT)
        .withColumn("query", _cacheable(F.col("query"))).filter(F.col("query").isNotNull())
    )
    hash_ = F.col("table_contents_hash") if "table_contents_hash" in results.columns else F.lit("")
    payload = F.struct(
        hash_.alias("table_contents_hash"), F.col("timestamp").alias("created_at"), "data", "shape", "function"
    )
    first = kept.groupBy(*KEY).agg(F.min_by(payload, F.struct("timestamp", "data")).alias("e"))
    return first.select("node", "table_name", "query", "e.*")


def cache_fresh(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The entries to append to the cache; keys it already has keep their entry."""
    fresh = cache_entries(results).join(cache.select(*KEY), KEY, "left_anti")
    return fresh.withColumn("last_used", F.col("created_at")).select(*CACHE_COLUMNS)


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with new entries; an entry that exists stays as it is."""
    return cache.select(*CACHE_COLUMNS).unionByName(cache_fresh(cache, results))


def append_to_cache(cache: DataFrame, results: DataFrame, path: str) -> None:
    """Store new entries next to those at ``path``, which ``cache`` was read from."""
    cache_fresh(cache, results).write.mode("append").parquet(path)


def cache_get(cache: DataFrame, queries: DataFrame, now: Column | None = None) -> tuple:
    """(hits, touched cache): results under the caller's own query, and updated use times.

    ``queries`` has node, table_name, query and, to insist on it, table_contents_hash.
    """
    now = F.current_timestamp() if now is None else now
    asked = queries.withColumn("own_query", F.col("query")).withColumn("query", _cacheable(F.col("query")))
    asked = asked.filter(F.col("query").isNotNull())
    keys = [*KEY, "table_contents_hash"] if "table_contents_hash" in queries.columns else KEY
    hits = cache.join(asked.select(*keys, "own_query"), keys).select(
        "node", "table_name", F.col("own_query").alias("query"), "created_at", "data", "shape", "function"
    )
    used = asked.select(*keys).distinct().withColumn("_used", F.lit(True))
    touched = cache.join(used, keys, "left").withColumn(
        "last_used", F.when(F.col("_used"), now).otherwise(F.col("last_used"))
    ).select(*CACHE_COLUMNS)
    return hits, touched


def cache_retain(
    cache: DataFrame, max_entries: int = MAX_ENTRIES, max_idle_days: int = MAX_IDLE_DAYS,
    fingerprints: DataFrame | None = None,
) -> DataFrame:
    """Drop entries out of use, entries of changed tables, and all but the last used ones.

    ``fingerprints`` (table_name, table_contents_hash) names the current contents.
    """
    idle = F.col("last_used") - F.col("created_at")
    kept = cache.filter(idle <= F.make_dt_interval(days=F.lit(max_idle_days)))
    if fingerprints is not None:
        current = fingerprints.select("table_name", F.col("table_contents_hash").alias("_now"))
        kept = kept.join(current, "table_name", "left").filter(
            F.col("_now").isNull() | (F.col("_now") == F.col("table_contents_hash"))
        ).select(*cache.columns)
    # the limit is the operator itself; sort + limit runs as a distributed top-n
    return kept.orderBy(F.desc("last_used"), *KEY).limit(max_entries)


def cache_reset(cache: DataFrame) -> DataFrame:
    return cache.filter(F.lit(False))


def row_mark(df: DataFrame, columns: list) -> Column:
    """A row's contribution to the fingerprint of its table."""
    plain = [
        F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))
        else F.col(f"`{c}`") for c in columns
    ]
    return F.xxhash64(*plain).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): equal for equal contents in any row order."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_mark(df, sorted(df.columns))), F.lit(0)).cast("string").alias("fingerprint"),
    )
