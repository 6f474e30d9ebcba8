"""Job results, the result cache, stored states and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens.operators import regression
from cohortlens.plans import federation
from cohortlens.queries import query, rounded, table
from cohortlens.session import checkpoint_dir
from cohortlens.sources import cache, results
from cohortlens.streaming import states


def _folder(spark, name: str) -> str:
    """A fresh folder in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortlens-{name}-{uuid.uuid4().hex}"


def _job_rows(spark, d):
    """Each event is a job result; its type decides the shape, some data are broken."""
    e = table(spark, d, "events")
    shape = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "json")
             .when(F.col("event_type") == "view", "pfa").otherwise("text"))
    data = F.when(F.col("value") < 5, F.lit("{broken")).otherwise(F.col("props"))
    return e.select(
        F.col("event_id").cast("string").alias("job_id"), F.repeat(F.lit("node-"), F.lit(8)).alias("node"),
        F.col("ts").alias("timestamp"), shape.alias("shape"), F.repeat("event_type", F.lit(60)).alias("function"),
        data.alias("data"), F.when(F.col("event_type") == "error", F.repeat(F.lit("failed "), F.lit(40))).alias("error"))


_SHAPE_SQL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'json' WHEN 'view' THEN 'pfa' ELSE 'text' END"""


@query("job_results", f"""
SELECT CAST(event_id AS VARCHAR) AS job_id, left(repeat('node-', 8), 32) AS node, shape, left(repeat(event_type, 60), 255) AS function,
  CASE WHEN shape = 'error' OR (value < 5 AND shape IN ('json', 'pfa')) THEN 'error' WHEN shape = 'json' THEN 'json'
   WHEN shape = 'pfa' THEN 'model' ELSE 'other' END AS kind,
  CASE WHEN shape = 'error' THEN left(repeat('failed ', 40), 255) WHEN value < 5 AND shape IN ('json', 'pfa') THEN
   'job ' || event_id || ': the output of ' || left(repeat(event_type, 60), 255) || ' is no readable JSON' END AS error
FROM (SELECT *, {_SHAPE_SQL} AS shape FROM events)""")
def job_results(spark, d):
    path = _folder(spark, "results")
    results.write_job_results(_job_rows(spark, d), path)
    return results.read_job_results(spark.read.parquet(path)).select(
        "job_id", "node", "shape", "function", "kind", "error")


@query("model_cells", """
SELECT event_id, '{"cells":{"score":' || CAST(event_id AS VARCHAR) || '},"name":"' || event_type || '"}' AS with_cell,
  '{"cells":{},"name":"' || event_type || '"}' AS without_cell FROM events""")
def model_cells(spark, d):
    e = table(spark, d, "events")
    doc = F.to_json(F.struct(F.col("event_type").alias("name"), F.create_map().cast("map<string,string>").alias("cells")))
    e = e.select("event_id", doc.alias("doc"))
    e = e.withColumn("with_cell", results.inject_cell(F.col("doc"), "score", F.col("event_id").cast("string")))
    return e.select("event_id", "with_cell", results.remove_cell(F.col("with_cell"), "score").alias("without_cell"))


def _query_json(user):
    """A query over one variable, asked by a user."""
    def code(c):
        return F.struct(c.alias("code"))

    none = F.array().cast("array<struct<code:string>>")
    return F.to_json(F.struct(
        F.array(code(F.col("event_type"))).alias("variables"), none.alias("covariables"), none.alias("grouping"),
        F.struct(F.lit("statisticsSummary").alias("code")).alias("algorithm"), code(user).alias("user")))


_NORMAL_SQL = """'{"algorithm":{"code":"statisticsSummary"},"covariables":[],"grouping":[],"user":{"code":"system"},"variables":[{"code":"' || event_type || '"}]}'"""


def _answers(spark, d):
    """Every event is an answered query of its user."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("site-"), F.col("user_id").cast("string")).alias("node"), F.lit("events").alias("table_name"),
        _query_json(F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("timestamp"),
        F.to_json(F.struct("event_id", "value")).alias("data"), F.lit("json").alias("shape"),
        F.lit("statisticsSummary").alias("function"))


_HALF = "2024-01-15 00:00:00"
_CACHE_SQL = f"""(SELECT node, query, min(ts) AS created_at, arg_min(event_id, ts) AS event_id FROM
  (SELECT 'site-' || user_id AS node, {_NORMAL_SQL} AS query, ts, event_id FROM events) GROUP BY ALL)"""


def _cache(spark, d):
    """A cache filled in two goes, so that the second one meets the first one's entries."""
    answers = _answers(spark, d)
    early, late = answers.filter(F.col("timestamp") < _HALF), answers.filter(F.col("timestamp") >= _HALF)
    empty = cache.cache_entries(answers).withColumn("last_used", F.col("created_at")).select(
        *cache.CACHE_COLUMNS).filter(F.lit(False))
    return cache.cache_put(cache.cache_put(empty, early), late)


@query("cache_put", f"SELECT node, query, created_at, CAST(event_id AS VARCHAR) AS event_id FROM {_CACHE_SQL}")
def cache_put(spark, d):
    return _cache(spark, d).select("node", "query", "created_at", F.get_json_object("data", "$.event_id").alias("event_id"))


@query("cache_get", f"""
SELECT a.node, CAST(c.event_id AS VARCHAR) AS event_id, a.user_id AS asked_by, count(*) AS n FROM
 (SELECT 'site-' || user_id AS node, CAST(user_id AS VARCHAR) AS user_id, {_NORMAL_SQL} AS query FROM events) a
 JOIN {_CACHE_SQL} c ON a.node = c.node AND a.query = c.query GROUP BY ALL""")
def cache_get(spark, d):
    hits, _ = cache.cache_get(_cache(spark, d), _answers(spark, d).select("node", "table_name", "query"))
    return hits.groupBy(
        "node", F.get_json_object("data", "$.event_id").alias("event_id"),
        F.get_json_object("query", "$.user.code").alias("asked_by")).agg(F.count(F.lit(1)).alias("n"))


_NOW = "2024-01-20 00:00:00"


@query("cache_touch", f"""
SELECT node, query, CASE WHEN contains(query, '"code":"click"') THEN TIMESTAMP '{_NOW}' ELSE created_at END AS last_used FROM {_CACHE_SQL}""")
def cache_touch(spark, d):
    asked = _answers(spark, d).filter(F.col("query").contains('"code":"click"')).select("node", "table_name", "query")
    _, touched = cache.cache_get(_cache(spark, d), asked, F.lit(_NOW).cast("timestamp_ntz"))
    return touched.select("node", "query", "last_used")


# every event is an entry last used its value in hours later; tables are the event types
@query("cache_retain", """
SELECT node, last_used FROM (SELECT event_id, 'n' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS node, event_type, ts, ts + to_seconds(CAST(round(value * 3600) AS BIGINT)) AS last_used FROM events)
WHERE last_used - ts <= INTERVAL 10 DAY AND event_type <> 'error' ORDER BY last_used DESC, node LIMIT 1000""")
def cache_retain(spark, d):
    e = table(spark, d, "events")
    entries = e.select(
        F.concat(F.lit("n"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("node"),
        F.col("event_type").alias("table_name"), F.lit("old").alias("table_contents_hash"), F.lit("{}").alias("query"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_interval(secs=F.round(F.col("value") * 3600))).alias("last_used"),
        F.col("props").alias("data"), F.lit("json").alias("shape"), F.lit("f").alias("function"))
    now = e.select(F.col("event_type").alias("table_name")).distinct().withColumn(
        "table_contents_hash", F.when(F.col("table_name") == "error", "new").otherwise("old"))
    return cache.cache_retain(entries, 1000, 10, now).select("node", "last_used")


@query("cache_reset", "SELECT count(*) > 0 AS filled_before, CAST(0 AS BIGINT) AS entries_after FROM events")
def cache_reset(spark, d):
    entries = _cache(spark, d)
    left = cache.cache_reset(entries).count()
    return entries.agg((F.count("*") > 0).alias("filled_before"), F.lit(left).cast("bigint").alias("entries_after"))


@query("table_fingerprint")
def table_fingerprint(spark, d):
    return cache.table_fingerprint(table(spark, d, "lineitem"))


@query("stored_states", """
SELECT 'o_totalprice' AS variable, count(*) AS "count", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
  min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def stored_states(spark, d):
    """One stored job per order status; the reduce step picks two of them by id."""
    path = _folder(spark, "states")
    orders = table(spark, d, "orders")
    for status in ("F", "O", "P"):
        part = orders.filter(F.col("o_orderstatus") == status)
        federation.write_states(federation.partial_summary(part, ["o_totalprice"], "o_orderpriority"),
                                path, "statisticsSummary", f"job{status}")
    merged = federation.merge_summary(federation.read_states(spark, path, "statisticsSummary", ["jobF", "jobO"]))
    return rounded(merged.select("variable", "count", "mean", "std", "min", "max"), 4)


def _event_stream(spark, d):
    return states.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


@query("stream_summary", """
SELECT event_type, 'value' AS variable, count(*) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def stream_summary(spark, d):
    path = _folder(spark, "stream")
    states.stream_states(_event_stream(spark, d), path, ["value"], ["event_type"]).awaitTermination()
    out = states.read_stream_summary(spark, path, ["event_type"])
    return rounded(out.select("event_type", "variable", "count", "mean", "std", "min", "max"))


@query("stream_histogram", """
SELECT CAST(b AS INTEGER) AS bin, count(value) AS "count" FROM range(20) t(b)
LEFT JOIN events ON least(floor(value / 5.0), 19) = b GROUP BY 1""")
def stream_histogram(spark, d):
    path = _folder(spark, "stream")
    ranges = {"value": (0.0, 100.0)}
    states.stream_states(_event_stream(spark, d), path, ["value"], ranges=ranges).awaitTermination()
    return states.read_stream_histogram(spark, path, ranges).select("bin", "count")


@query("stream_predict", """
WITH m AS (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events)
SELECT event_id, round(a + b * user_id, 6) AS prediction FROM events, m""")
def stream_predict(spark, d):
    model = regression.fit_linear(table(spark, d, "events"), "value", ["user_id"])
    path = _folder(spark, "predictions")
    scored = states.predict_stream(model, _event_stream(spark, d)).select("event_id", "prediction")
    scored.writeStream.format("parquet").option("checkpointLocation", f"{path}/_progress").trigger(
        availableNow=True).start(f"{path}/rows").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/rows"))
